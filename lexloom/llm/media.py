"""Media columns: Netpbm and BMP to numpy and back, area resizing, NPY tiles and difference hashes.

Decoders read binary PBM, PGM and PPM (P4, P5, P6), their plain forms (P1, P2, P3), and uncompressed BMP of 8, 24
and 32 bits. Resizing averages exact areas from an integral image, so a fractional pixel border counts in part.

:func:`store_texts` keeps a text losslessly as pixels: its UTF-8 bytes, padded with 255 to a positive multiple of
576, are rows of 192 RGB samples, in a PPM when the number of rows is odd and in a 24-bit BMP when it is even. The
images are written as a table in shared storage; features and tiles come from what is read back.

Defined results: a null text counts as empty (one row of padding); media that cannot be decoded give null features;
repeated rows give equal results; a clashing output column is replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import shared_folder

BLOCK = 576
WIDTH = BLOCK // 3
TILE = 32
HASH_COLS, HASH_ROWS = 9, 8


def decode(data: bytes) -> np.ndarray:
    """Rows x columns x channels, uint8 or uint16."""
    if data[:2] == b"BM":
        return _decode_bmp(data)
    if data[:1] == b"P" and data[1:2] in b"123456" and len(data) > 2:
        return _decode_netpbm(data)
    raise ValueError("neither Netpbm nor BMP")


def _header_numbers(data: bytes, count: int) -> tuple[list[int], int]:
    """The numbers of a Netpbm header, comments skipped, and the offset after one closing white space."""
    at, found = 2, []
    while len(found) < count:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("bad Netpbm header")
        found.append(int(data[at:end]))
        at = end
    return found, at + 1


def _decode_netpbm(data: bytes) -> np.ndarray:
    kind = data[1] - ord("0")
    bitmap, channels = kind in (1, 4), 3 if kind in (3, 6) else 1
    numbers, at = _header_numbers(data, 2 if bitmap else 3)
    width, height = numbers[:2]
    most = 1 if bitmap else numbers[2]
    if not 0 < most < 65536:
        raise ValueError("bad maximum value")
    n = width * height * channels
    if kind == 1:
        body = b"".join(line.split(b"#")[0] for line in data[at:].splitlines())
        flat = np.frombuffer(b"".join(body.split()), np.uint8)[:n] - ord("0")
    elif kind in (2, 3):
        body = b" ".join(line.split(b"#")[0] for line in data[at:].splitlines())
        flat = np.array(body.split()[:n], dtype=np.uint8 if most < 256 else np.uint16)
    elif kind == 4:
        row = (width + 7) // 8
        bits = np.unpackbits(np.frombuffer(data, np.uint8, row * height, at).reshape(height, row), axis=1)
        flat = bits[:, :width].ravel()
    else:
        flat = np.frombuffer(data, np.uint8 if most < 256 else ">u2", n, at)
    if len(flat) < n:
        raise ValueError("too few samples")
    image = flat.reshape(height, width, channels)
    return (1 - image) * np.uint8(255) if bitmap else image


def encode_ppm(image: np.ndarray) -> bytes:
    height, width, _ = image.shape
    return b"P6\n%d %d\n255\n" % (width, height) + np.ascontiguousarray(image, np.uint8).tobytes()


def _decode_bmp(data: bytes) -> np.ndarray:
    offset, header, width, height, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed or bits not in (8, 24, 32) or header < 40 or width <= 0:
        raise ValueError("only uncompressed BMP of 8, 24 or 32 bits")
    rows, pitch = abs(height), (width * bits // 8 + 3) // 4 * 4
    body = np.frombuffer(data, np.uint8, rows * pitch, offset).reshape(rows, pitch)[:, : width * bits // 8]
    if bits == 8:
        used = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.zeros((256, 4), np.uint8)
        palette[:used] = np.frombuffer(data, np.uint8, used * 4, 14 + header).reshape(used, 4)
        image = palette[body][:, :, 2::-1]
    else:
        image = body.reshape(rows, width, bits // 8)[:, :, 2::-1]
    return image[::-1] if height > 0 else image


def encode_bmp(image: np.ndarray) -> bytes:
    """24 bits, rows from the bottom up."""
    height, width, _ = image.shape
    pad = -width * 3 % 4
    body = np.zeros((height, width * 3 + pad), np.uint8)
    body[:, : width * 3] = image[::-1, :, ::-1].reshape(height, width * 3)
    head = struct.pack("<2sIHHI", b"BM", 54 + body.size, 0, 0, 54)
    return head + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, body.size, 2835, 2835, 0, 0) + body.tobytes()


def grey(image: np.ndarray) -> np.ndarray:
    """Luma in thousandths, as integers so that every machine gets the same."""
    if image.shape[2] < 3:
        return image[:, :, 0].astype(np.int64) * 1000
    return image[:, :, :3].astype(np.int64) @ np.array([299, 587, 114])


def area_resize(plane: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Mean over exact areas, by bilinear reads of the integral image at the fractional borders."""
    integral = np.zeros((plane.shape[0] + 1, plane.shape[1] + 1))
    integral[1:, 1:] = plane.cumsum(0).cumsum(1)

    def along(table: np.ndarray, n: int) -> np.ndarray:
        size = table.shape[0] - 1
        edge = np.arange(n + 1) * size / n
        low = np.minimum(edge.astype(np.int64), size - 1)
        part = (edge - low).reshape(-1, *[1] * (table.ndim - 1))
        return np.diff(table[low] * (1 - part) + table[low + 1] * part, axis=0)

    sums = along(along(integral, rows).T, cols).T
    return sums * (rows * cols) / (plane.shape[0] * plane.shape[1])


def difference_hash(plane: np.ndarray) -> str:
    small = area_resize(plane, HASH_ROWS, HASH_COLS)
    bits = small[:, 1:] > small[:, :-1] + 1e-6
    return np.packbits(bits.ravel()).tobytes().hex()


def npy_tile(plane: np.ndarray, side: int = TILE) -> bytes:
    """A side x side uint8 tile in NPY form."""
    tile = np.clip(np.rint(area_resize(plane, side, side) / 1000), 0, 255).astype(np.uint8)
    out = io.BytesIO()
    np.lib.format.write_array(out, tile, version=(1, 0), allow_pickle=False)
    return out.getvalue()


def store_text(text: str | None) -> bytes:
    data = (text or "").encode("utf-8", "surrogatepass")
    rows = max(1, -(-len(data) // BLOCK))
    image = np.frombuffer(data.ljust(rows * BLOCK, b"\xff"), np.uint8).reshape(rows, WIDTH, 3)
    return encode_ppm(image) if rows % 2 else encode_bmp(image)


def _mapped(df: DataFrame, drop: set[str], new: dict[str, str], make) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):  # media are large: few rows at a time
                part = batch.slice(at, 64)
                kept = [(n, c) for n, c in zip(part.schema.names, part.columns, strict=True) if n not in drop]
                more = make(part)
                yield pa.RecordBatch.from_arrays([*(c for _, c in kept), *more.values()], [*(n for n, _ in kept), *more])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in drop]
    return df.mapInArrow(run, ", ".join([*fields, *(f"`{n}` {t}" for n, t in new.items())]))


def store_texts(df: DataFrame, text: str = "text", output: str = "media") -> DataFrame:
    """The input with ``text`` replaced by the image that holds its bytes."""
    make = lambda b: {output: pa.array([store_text(t.as_py()) for t in b.column(text)], pa.binary())}
    return _mapped(df, {text, output}, {output: "binary"}, make)


def tiles(df: DataFrame, media: str = "media", side: int = TILE) -> DataFrame:
    """The input plus ``width``, ``height``, ``npy`` (an NPY tile) and ``dhash``; nulls where decoding fails."""

    def make(b):
        out = {"width": [], "height": [], "npy": [], "dhash": []}
        for x in b.column(media):
            try:
                image = decode(x.as_py() or b"")
                plane = grey(image)
                row = (image.shape[1], image.shape[0], npy_tile(plane, side), difference_hash(plane))
            except (ValueError, struct.error, IndexError):
                row = (None,) * 4
            for name, value in zip(out, row, strict=True):
                out[name].append(value)
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.string())
        return {n: pa.array(v, k) for (n, v), k in zip(out.items(), kinds, strict=True)}

    return _mapped(df, {"width", "height", "npy", "dhash"}, {"width": "int", "height": "int", "npy": "binary", "dhash": "string"}, make)


def at_rest(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in shared storage, read back."""
    out = f"{shared_folder(df.sparkSession)}/media-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(out)
    return df.sparkSession.read.schema(df.schema).parquet(out)


def read_payloads(df: DataFrame, media: str = "media") -> DataFrame:
    """From stored texts: digests of the payload and of the stored form, the features and the NPY tile, without the media."""
    new = {"payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string", "npy": "binary"}

    def make(b):
        rows = []
        for x in b.column(media):
            stored = x.as_py()
            image = decode(stored)
            payload = np.ascontiguousarray(image).tobytes()
            plane = grey(image)
            tile = npy_tile(plane)
            feature = f"{difference_hash(plane)}:{hashlib.sha256(tile).hexdigest()[:16]}"
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, tile))
        columns = list(zip(*rows, strict=True)) or [()] * len(new)
        kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        return {n: pa.array(c, kinds[k]) for (n, k), c in zip(new.items(), columns, strict=True)}

    return _mapped(df, {media, *new}, new, make)


def digest(docs: DataFrame) -> DataFrame:
    size = F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long")
    return read_payloads(at_rest(store_texts(docs.select("doc_id", size.alias("n_bytes"), "text"))))
