"""WARC archives compressed record by record with an embedded Zstandard dictionary.

An archive is one byte string: a skippable frame (magic 0x184D2A5D) that holds a dictionary built from records of
the archive, then one frame per record, each compressed with that dictionary, so that any record can be read alone.
Archives are rows of a table, written through Spark to shared storage, so any file system will do and a lost
executor only repeats its own archives; :func:`export_archives` writes them out as ``.warc.zst`` files.

Records of equal payloads of at least ``min_payload`` bytes: the one with the smallest page_id is a response, the
others are revisits that name it and carry no payload.

Defined results: a null html is an empty payload; a null url leaves out WARC-Target-URI; a null page_id leaves out
the page header, never counts as the smallest unless its whole group is null, and such a group is all responses;
rows that share the smallest page_id of a group are all responses; extra columns are ignored; an empty table gives
no archives.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import durable

MAGIC = 0x184D2A5D
MIN_PAYLOAD = 100
#: Limits of one archive, so that a task holds little: bytes before compression, and records.
ARCHIVE_BYTES, ARCHIVE_RECORDS = 8 << 20, 4096
DICTIONARY_BYTES, SAMPLE_BYTES = 16 << 10, 512 << 10
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None, row: str = "") -> str:
    return f"urn:uuid:{uuid.UUID(int=page_id % (1 << 64)) if page_id is not None else uuid.uuid5(uuid.NAMESPACE_URL, row)}"


def page_of(record: str) -> int:
    n = uuid.UUID(record.removeprefix("urn:uuid:")).int
    return n - (1 << 64) if n >> 63 else n


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; the HTTP head inside keeps the full payload's length for revisits too."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{record_id(page_id, digest)}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._')}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if revisit:
        head += [f"WARC-Refers-To: <{record_id(refers_to)}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The page's facts, from what the record holds."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    stated = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != stated):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    page = fields.get("X-Page-ID")
    refers = fields.get("WARC-Refers-To")
    return {
        "page_id": None if page is None else int(page),
        "payload_bytes": length,
        "payload_digest": stated,
        "record_type": kind,
        "refers_to": None if refers is None else page_of(refers.strip("<>")),
        "payload": payload if kind == "response" else None,
    }


def _dictionary(records: list[bytes]):
    """Built from records spread over the archive; raw content where they are too few to train on."""
    import zstandard

    step = max(1, sum(map(len, records)) // SAMPLE_BYTES)
    sample = records[::step]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample, k=256, d=8, f=16, accel=4, level=LEVEL)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(sample)[:DICTIONARY_BYTES].ljust(8, b"\0"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def pack(records: list[bytes]) -> bytes:
    """One archive."""
    import zstandard

    words = _dictionary(records)
    press = zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_content_size=True)
    data = words.as_bytes()
    return b"".join([struct.pack("<II", MAGIC, len(data)), data, *(press.compress(r) for r in records)])


def unpack(archive: bytes) -> Iterator[bytes]:
    """The records, frame after frame, with the dictionary found in the leading skippable frame."""
    import zstandard

    magic, size = struct.unpack_from("<II", archive)
    if magic != MAGIC:
        raise ValueError("no dictionary frame")
    plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(archive[8 : 8 + size]))
    rest = memoryview(archive)[8 + size :]
    while len(rest):
        frame = plain.decompressobj()
        yield frame.decompress(rest[: _frame_length(rest)])
        rest = rest[_frame_length(rest) :]


def _frame_length(frame: memoryview) -> int:
    """Of one frame, walked by its block headers."""
    import zstandard

    head = zstandard.frame_header_size(frame)
    checksum = frame[4] >> 2 & 1
    at = head
    while True:
        block = int.from_bytes(frame[at : at + 3], "little")
        last, kind, size = block & 1, block >> 1 & 3, block >> 3
        at += 3 + (1 if kind == 1 else size)
        if last:
            return at + 4 * checksum


def _archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[bytes] = []
    size = 0

    def flush() -> pa.RecordBatch:
        data = pack(held)
        name = hashlib.sha256(data).hexdigest()
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(held)], pa.int64()), pa.array([data], pa.binary())], ["archive", "n_records", "data"])

    for batch in batches:
        for page, url, html, digest, refers in zip(*(batch.column(n) for n in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
            made = record(page.as_py(), url.as_py(), (html.as_py() or "").encode("utf-8", "surrogatepass"), digest.as_py(), refers.as_py())
            if held and (size + len(made) > ARCHIVE_BYTES or len(held) >= ARCHIVE_RECORDS):
                yield flush()
                held, size = [], 0
            held.append(made)
            size += len(made)
    if held:
        yield flush()


def with_revisits(pages: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """``page_id, url, html, digest, refers_to`` (null for responses).

    Only digests with several records take part in the join; that table is finished first, so its size is known
    when the join is planned and it is broadcast only when it is small.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    told = pages.select("page_id", "url", html.alias("html"), F.sha2(html, 256).alias("digest"))
    sized = told.filter(F.octet_length("html") >= min_payload).groupBy("digest")
    several = durable(sized.agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("digest", "first"))
    if several.isEmpty():
        return told.withColumn("refers_to", F.lit(None).cast("long"))
    other = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    joined = told.join(several, "digest", "left")
    return joined.select("page_id", "url", "html", "digest", other.cast("long").alias("refers_to"))


def write_archives(pages: DataFrame, min_payload: int = MIN_PAYLOAD) -> DataFrame:
    """``archive`` (name), ``n_records``, ``data``: the finished archives in shared storage."""
    made = with_revisits(pages, min_payload).mapInArrow(_archives, "archive string, n_records long, data binary")
    return durable(made)


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """A row per record; ``payload`` (null for revisits) only if asked for."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data"):
                rows = []
                for raw in unpack(data.as_py()):
                    rows.append(parse(raw))
                    if len(rows) == 512:
                        yield _rows(rows)
                        rows = []
                if rows:
                    yield _rows(rows)

    def _rows(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, pa.string())) for n in names], names)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return archives.select("data").mapInArrow(run, schema + ", payload binary" * payloads)


def export_archives(archives: DataFrame, uri: str) -> int:
    """Write each archive as ``<name>.warc.zst`` under ``uri`` with Hadoop's file systems, one at a time."""
    context = archives.sparkSession.sparkContext
    jvm, count = context._jvm, 0
    folder = jvm.org.apache.hadoop.fs.Path(uri)
    store = folder.getFileSystem(context._jsc.hadoopConfiguration())
    for row in archives.select("archive", "data").toLocalIterator():
        out = store.create(jvm.org.apache.hadoop.fs.Path(folder, f"{row['archive']}.warc.zst"), True)
        try:
            out.write(bytearray(row["data"]))
        finally:
            out.close()
        count += 1
    return count


def digest(pages: DataFrame) -> DataFrame:
    return read_archives(write_archives(pages.select("page_id", "url", "html")), payloads=False)


ORACLE = """
    WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
    m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
    SELECT page_id, payload_bytes, payload_digest,
        CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
    FROM m
    """
