"""Image references: which ones a document keeps, decided on a table of image features."""

from __future__ import annotations

import hashlib
import posixpath
import struct
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexloom.functions import fixed
from lexloom.functions.text import let, resolve_image_path, rx


def image_refs(text: Column) -> Column:
    """Array of ``token, ref, context`` in order; the context is what stands around the reference."""
    token = r"!\[[^\]]*\]\(([^)]+)\)"

    def placed(pieces: Column) -> Column:
        tokens = F.regexp_extract_all(text, F.lit(token), F.lit(0))
        refs = F.regexp_extract_all(text, F.lit(token), F.lit(1))

        def one(t: Column, i: Column) -> Column:
            before = F.aggregate(F.slice(pieces, 1, i + 1), F.lit(0), lambda a, x: a + F.length(x)) + F.aggregate(
                F.slice(tokens, 1, i), F.lit(0), lambda a, x: a + F.length(x)
            )
            start = F.greatest(before - fixed.IMAGE_CONTEXT, F.lit(0))
            context = F.substring(text, start + 1, before + fixed.IMAGE_CONTEXT - start)
            return F.struct(t.alias("token"), F.get(refs, i).alias("ref"), context.alias("context"))

        return F.transform(tokens, one)

    return let(F.split(text, token, -1), placed)


def _candidate_batches(ref: str, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[], [], []]
            for name, top in zip(batch.column(ref).to_pylist(), batch.column(folder).to_pylist(), strict=True):
                for column, form in zip(columns, (None, "NFC", "NFD"), strict=True):
                    told = name if name is None or form is None else unicodedata.normalize(form, name)
                    column.append(None if told is None else posixpath.normpath(posixpath.join(top or "", told)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(c, pa.string()) for c in columns)], ["row", "c0", "c1", "c2"])

    return run


def locate(refs: DataFrame, files: DataFrame, ref: str = "ref", path: str = "path", folder: str = "folder") -> DataFrame:
    """References with the ``file`` they mean, null where there is none.

    The decoded reference is taken relative to the document's ``folder`` and must name a stored path exactly: as it
    is, else in composed, else in decomposed form. Case, accents and folders count.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in refs.columns)).alias("row")
    named = refs.select(row, resolve_image_path(F.col(f"`{ref}`")).alias("ref"), F.col(f"`{folder}`").alias("folder"))
    kind = named.schema["row"].dataType.simpleString()
    out = named.mapInArrow(_candidate_batches("ref", "folder"), f"row {kind}, c0 string, c1 string, c2 string")
    known = files.select(F.col(f"`{path}`").alias("file")).distinct()
    for n in range(3):
        out = out.join(known.withColumnRenamed("file", f"f{n}"), F.col(f"c{n}") == F.col(f"f{n}"), "left")
    return out.select(*(F.col("row").getField(c).alias(c) for c in refs.columns), F.coalesce("f0", "f1", "f2").alias("file"))


def decode_png(data: bytes) -> np.ndarray:
    """Rows x columns x channels of a non-interlaced PNG of 8 bits a sample; a palette becomes its colours."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, packed, palette, head = 8, [], None, None
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        at += size + 12
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(body)
    if head is None or head[2] != 8 or head[6]:
        raise ValueError("only plain PNG of 8 bits a sample")
    width, height, depth = head[0], head[1], {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[head[3]]
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, 1 + width * depth)
    out = np.zeros((height, width * depth), np.uint8)
    above = np.zeros(width * depth, np.uint8)
    for y in range(height):
        above = out[y] = _unfiltered(int(lines[y, 0]), lines[y, 1:], above, depth)
    image = out.reshape(height, width, depth)
    return palette[image[:, :, 0]] if head[3] == 3 and palette is not None else image


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, depth: int) -> np.ndarray:
    if kind == 0:
        return line
    if kind == 1:
        return line.reshape(-1, depth).cumsum(0, dtype=np.uint8).reshape(-1)
    if kind == 2:
        return line + above
    raw, up, out = line.tolist(), above.tolist(), [0] * len(line)
    for x, value in enumerate(raw):
        left = out[x - depth] if x >= depth else 0
        if kind == 3:
            guess = (left + up[x]) // 2
        else:
            corner = up[x - depth] if x >= depth else 0
            guess = min((left, up[x], corner), key=lambda v: abs(left + up[x] - corner - v))
        out[x] = (value + guess) & 255
    return np.array(out, np.uint8)


def image_features(files: DataFrame, decode: Callable[[bytes], np.ndarray] = decode_png, path: str = "path", content: str = "content") -> DataFrame:
    """``path, width, height, md5`` (of the samples) and ``variance`` (sample variance of the grey values).

    Null features where decoding fails; ``decode`` gives rows x columns x channels of 8 bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column("content"):
                try:
                    image = decode(data.as_py() or b"")
                    rows.append((image.shape[1], image.shape[0], hashlib.md5(np.ascontiguousarray(image).tobytes()).hexdigest(), _variance(image)))
                except (ValueError, KeyError, IndexError, struct.error, zlib.error):
                    rows.append((None,) * 4)
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.float64())
            made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("path"), *made], ["path", "width", "height", "md5", "variance"])

    told = files.select(F.col(f"`{path}`").alias("path"), F.col(f"`{content}`").alias("content"))
    return told.mapInArrow(run, "path string, width int, height int, md5 string, variance double")


def _variance(image: np.ndarray) -> float | None:
    """Of grey values in the usual luma, in 16-bit fixed point."""
    x = image.astype(np.int64)
    grey = x[:, :, 0] if x.shape[2] < 3 else (x[:, :, 0] * 19595 + x[:, :, 1] * 38470 + x[:, :, 2] * 7471 + 0x8000) >> 16
    return float(grey.var(ddof=1)) if grey.size > 1 else None


def has_context(context: Column) -> Column:
    return context.rlike(rx(fixed.IMAGE_CONTEXT_WORDS))


def filter_images(features: DataFrame, doc: str = "doc_id", pos: str = "pos") -> DataFrame:
    """Adds ``remove_reason`` (null: kept) to rows with ``width, height, md5, variance, has_context``.

    In order: too small in both directions; the same pixels as an earlier image that was not too small; nearly
    uniform; small and without a word that announces it. Where all would go, the largest few may stay.
    """
    small = (F.col("width") < fixed.IMAGE_SIDE) & (F.col("height") < fixed.IMAGE_SIDE)
    area = F.col("width").cast("long") * F.col("height")
    nth = F.row_number().over(W.partitionBy(doc, "md5", "__small").orderBy(pos))
    reason = (
        F.when(F.col("__small"), "too_small")
        .when(nth > 1, "duplicate_hash")
        .when(F.coalesce("variance", F.lit(float("inf"))) < fixed.IMAGE_VARIANCE, "low_variance")
        .when(~F.col("has_context") & (area < fixed.IMAGE_FREE_AREA), "no_semantic_context")
    )
    judged = features.withColumn("__small", small).withColumn("__reason", reason).withColumn("__area", area)
    lost = F.bool_and(F.col("__reason").isNotNull()).over(W.partitionBy(doc))
    place = F.row_number().over(W.partitionBy(doc).orderBy(F.col("__area").desc(), pos))
    spared = F.col("__lost") & (F.col("__area") >= fixed.IMAGE_FALLBACK_AREA) & (F.col("__place") <= fixed.IMAGE_FALLBACK_KEEP)
    out = judged.withColumn("__lost", lost).withColumn("__place", place)
    out = out.withColumn("remove_reason", F.when(~spared, F.col("__reason")))
    return out.drop("__small", "__reason", "__area", "__lost", "__place")


def remove_refs(text: Column, tokens: Column) -> Column:
    """Every occurrence of each token goes, also where a kept image shares it."""
    return F.aggregate(tokens, text, lambda t, x: F.replace(t, x, F.lit("")))
