"""Fill-in-middle transformation over run-length encoded character classes.

A text's UTF-8 bytes are stored as maximal runs of one character class, the class being the width of its code points:
per run the class, the units (code points) before it and the bytes before it. A cut after u units lies in the run
found by binary search, at its byte offset plus (u - units before) times the width. No text is decoded and nothing
is stored per character; a text of plain ASCII is one run.

Texts, cuts and forms follow the contract of :func:`plan`; the three pieces are slices of the bytes, and
:func:`restore` rebuilds the text from output and form alone. No marker can arise across a border: markers begin with
``<``, which they hold nowhere else, and texts that contain one stay plain.

Defined results: null and empty texts are plain with n = 0; a null doc_id is hashed as an empty number; repeated rows
give repeated rows; texts of any length are read in blocks; :func:`transform` keeps all columns of the input, whatever their names;
an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import packed, unpacked

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Percent of texts that are cut, and of these the percent in the order suffix, prefix, middle.
CUT, SPM = 90, 20
SEED = "1:"
BLOCK = 1 << 20
#: Width of the code point that a byte begins; 0 for continuation bytes.
_WIDTH = np.array([1] * 128 + [0] * 64 + [2] * 32 + [3] * 16 + [4] * 16, np.uint8)


@dataclass
class Runs:
    """Maximal runs: width, units before and bytes before each; and the units of the whole text."""

    widths: list[int] = field(default_factory=list)
    units: list[int] = field(default_factory=list)
    bytes: list[int] = field(default_factory=list)
    n: int = 0

    def offset(self, unit: int) -> int:
        """The byte at which the unit begins."""
        if not self.widths:
            return 0
        k = bisect_right(self.units, unit) - 1
        return self.bytes[k] + (unit - self.units[k]) * self.widths[k]


def runs_of(data: bytes, block: int = BLOCK) -> Runs:
    out = Runs()
    last, raw = 0, np.frombuffer(data, np.uint8)
    for at in range(0, len(raw), block):
        width = _WIDTH[raw[at : at + block]]
        begins = np.flatnonzero(width)
        width = width[begins]
        if not len(width):
            continue
        change = np.flatnonzero(width[1:] != width[:-1]) + 1
        if width[0] != last:
            change = np.concatenate(([0], change))
        out.widths += width[change].tolist()
        out.units += (change + out.n).tolist()
        out.bytes += (begins[change] + at).tolist()
        out.n += len(width)
        last = int(width[-1])
    return out


def plan(data: bytes, n: int, h: list[int], cut: int = CUT, spm: int = SPM) -> tuple[str, int, int]:
    """Form and the two cuts, in units."""
    if not n or h[2] % 100 >= cut or any(mark in data for mark in (PREFIX, SUFFIX, MIDDLE)):
        return "plain", 0, 0
    a, b = h[0] % (n + 1), h[1] % (n + 1)
    return ("spm" if h[3] % 100 < spm else "psm"), min(a, b), max(a, b)


def arrange(data: bytes, runs: Runs, form: str, first: int, second: int) -> bytes:
    if form == "plain":
        return data
    a, b = runs.offset(first), runs.offset(second)
    pieces = (PREFIX, data[:a], SUFFIX, data[b:]) if form == "psm" else (SUFFIX, data[b:], PREFIX, data[:a])
    return b"".join((*pieces, MIDDLE, data[a:b]))


def restore(output: bytes, form: str) -> bytes:
    """The text of an output."""
    if form == "plain":
        return output
    head, between = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    at = output.index(between, len(head))
    end = output.index(MIDDLE, at + len(between))
    one, two, middle = output[len(head) : at], output[at + len(between) : end], output[end + len(MIDDLE) :]
    return b"".join((one, middle, two) if form == "psm" else (two, middle, one))


KINDS = {"n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64()}
FIELDS = "n long, form string, prefix_chars long, middle_chars long"


def _transformed(column: pa.Array, hashes: pa.Array, cut: int, spm: int) -> Iterator[tuple[bytes, tuple, bytes]]:
    for text, h in zip(column, hashes.to_pylist(), strict=True):
        data = text.as_buffer().to_pybytes() if text.is_valid else b""
        runs = runs_of(data)
        form, a, b = plan(data, runs.n, [int(h[8 * i : 8 * i + 8], 16) for i in range(4)], cut, spm)
        chars = (None, None) if form == "plain" else (a, b - a)
        yield data, (runs.n, form, *chars), arrange(data, runs, form, a, b)


def _hash(doc_id: str):
    return F.sha2(F.concat(F.lit(SEED), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))).cast("binary"), 256)


def transform(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", cut: int = CUT, spm: int = SPM) -> DataFrame:
    """``row`` (the input with the text replaced by its output) and ``fim`` (n, form, prefix_chars, middle_chars)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            facts, outputs = [], []
            for _, told, output in _transformed(batch.column("t"), batch.column("h"), cut, spm):
                facts.append(told)
                outputs.append(output.decode("utf-8", "surrogatepass"))
            columns = [pa.array(c, k) for c, k in zip(zip(*facts, strict=True) if facts else [()] * 4, KINDS.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(outputs, pa.string()), *columns], ["row", "t", *KINDS])

    told = packed(docs, t=F.col(f"`{text}`"), h=_hash(doc_id))
    out = told.mapInArrow(run, f"row {told.schema['row'].dataType.simpleString()}, t string, {FIELDS}")
    columns = [(F.col("t") if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns]
    return out.select(F.struct(*columns).alias("row"), F.struct(*KINDS).alias("fim"))


def filled(docs: DataFrame, text: str = "text", **parameters) -> DataFrame:
    """The input with every text in its training form."""
    return unpacked(transform(docs, text, **parameters), docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            rows = [(*told, sha(output), sha(restore(output, told[1]))) for _, told, output in _transformed(batch.column("text"), batch.column("h"), CUT, SPM)]
            kinds = {**KINDS, "output_sha256": pa.string(), "restored_sha256": pa.string()}
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * len(kinds), kinds.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *kinds])

    told = docs.select("doc_id", "text", _hash("doc_id").alias("h"))
    return told.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {FIELDS}, output_sha256 string, restored_sha256 string")


ORACLE = f"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('{SEED}' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), numbers AS (
  SELECT *, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM hashed
), planned AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {CUT} THEN 'plain'
         WHEN h4 % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form
  FROM numbers
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t
    WHEN 'psm' THEN '<P>' || substr(t, 1, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
    ELSE '<S>' || substr(t, b + 1) || '<P>' || substr(t, 1, a) || '<M>' || substr(t, a + 1, b - a) END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM planned
"""
