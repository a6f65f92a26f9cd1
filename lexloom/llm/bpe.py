"""Byte-level BPE through a sentencepiece model written straight from a rank file.

The 256 byte values map one to one to the 256 Braille characters, so any byte string is text without white space
or control characters. Each vocabulary entry becomes a piece of such characters with score ``-rank``: merging the
adjacent pair with the best score, leftmost first, is then merging the pair of lowest rank. Normalisation is the
identity, ids equal ranks, and decoding maps ids back to bytes. Pre-tokens that are entries themselves take their
id directly, as rank-based encoders do.

Defined results: null and empty texts give no tokens; lone surrogates are encoded as U+FFFD, as UTF-8 has no form
for them; repeated rows get equal results; extra columns are kept by :func:`encode`; an empty table gives an
empty table.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Code point of the character for byte 0.
BYTE_BASE = 0x2800
#: Distinct pre-tokens remembered per Python worker.
CACHE_ENTRIES = 400_000


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _message(field: int, payload: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(payload)) + payload


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def mapped(data: bytes) -> str:
    return "".join(chr(BYTE_BASE + b) for b in data)


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece ModelProto: pieces, trainer (BPE, no extra ids) and identity normaliser."""
    by_rank = sorted(ranks, key=ranks.__getitem__)
    if [ranks[x] for x in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must be 0, 1, 2, ... without gaps")
    normal, unknown = 1, 2
    out = [
        _message(1, _message(1, mapped(x).encode()) + _varint(2 << 3 | 5) + struct.pack("<f", -float(r)) + _number(3, normal))
        for r, x in enumerate(by_rank)
    ]
    out.append(_message(1, _message(1, b"<unk>") + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _number(3, unknown)))
    size, none = len(by_rank) + 1, (1 << 64) - 1
    bpe = 2
    trainer = _number(3, bpe) + _number(4, size) + _number(24, 0) + _number(40, len(by_rank)) + _number(41, none) + _number(42, none) + _number(43, none)
    normaliser = _message(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join([*out, _message(2, trainer), _message(3, normaliser)])


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class Codec:
    """Encoder and decoder of one vocabulary; one per Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        self.ranks = ranks
        self.pieces: list[bytes] = sorted(ranks, key=ranks.__getitem__)
        self.split = regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        self.cache: dict[str, tuple[int, ...]] = {}

    def pre_token(self, word: str) -> tuple[int, ...]:
        data = word.encode("utf-8")
        rank = self.ranks.get(data)
        ids = (rank,) if rank is not None else tuple(self.model.encode(mapped(data)))
        if len(self.cache) >= CACHE_ENTRIES:
            self.cache.clear()
        self.cache[word] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        try:
            text.encode("utf-8")
        except UnicodeEncodeError:
            text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
        known, make = self.cache.get, self.pre_token
        ids: list[int] = []
        for word in self.split(text):
            ids += known(word) or make(word)
        return ids

    def decode(self, ids: list[int]) -> bytes:
        pieces = self.pieces
        return b"".join([pieces[i] for i in ids])


@lru_cache(maxsize=4)
def codec(ranks_path: str, pattern: str) -> Codec:
    with open(ranks_path, "rb") as f:
        return Codec(read_ranks(f.read()), pattern)


def public_vocabulary() -> tuple[str, str]:
    """Path and pattern of the multilingual rank file that is installed beside Python on every machine."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def _with(batches: Iterator[pa.RecordBatch], drop: set[str], make) -> Iterator[pa.RecordBatch]:
    """Each batch without the columns of ``drop`` and with those that ``make`` gives; small slices bound memory."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            kept = [(n, c) for n, c in zip(part.schema.names, part.columns, strict=True) if n not in drop]
            more = make(part)
            yield pa.RecordBatch.from_arrays([*(c for _, c in kept), *more.values()], [*(n for n, _ in kept), *more])


def encode(df: DataFrame, text: str = "text", output: str = "ids", vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """The input plus ``output``, the token ids of ``text`` as an array of ints."""
    path, pattern = vocabulary or public_vocabulary()

    def run(batches):
        tokens = codec(path, pattern)
        yield from _with(batches, {output}, lambda b: {output: pa.array([tokens.encode(t.as_py()) for t in b.column(text)], pa.list_(pa.int32()))})

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != output]
    return df.mapInArrow(run, ", ".join([*fields, f"`{output}` array<int>"]))


def decode(df: DataFrame, ids: str = "ids", output: str = "bytes", vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """The input plus ``output``, the bytes that ``ids`` stand for; null ids give null."""
    path, pattern = vocabulary or public_vocabulary()

    def run(batches):
        tokens = codec(path, pattern)

        def make(b):
            lists = b.column(ids).to_pylist()
            return {output: pa.array([None if x is None else tokens.decode(x) for x in lists], pa.binary())}

        yield from _with(batches, {output}, make)

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != output]
    return df.mapInArrow(run, ", ".join([*fields, f"`{output}` binary"]))


def digest(docs: DataFrame, vocabulary: tuple[str, str] | None = None, kept: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Encode, decode from the ids, and digest both; ids never leave the worker that made them."""
    path, pattern = vocabulary or public_vocabulary()

    def run(batches):
        tokens = codec(path, pattern)

        def make(b):
            counts, of_ids, of_bytes = [], [], []
            for t in b.column("__text"):
                ids = tokens.encode(t.as_py())
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(tokens.decode(ids)).hexdigest())
            return {"n_tokens": pa.array(counts, pa.int64()), "ids_sha256": pa.array(of_ids), "decoded_sha256": pa.array(of_bytes)}

        yield from _with(batches, {"__text"}, make)

    rows = docs.select(*(F.col(f"`{c}`") for c in kept), F.col("text").alias("__text"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text"]
    return rows.mapInArrow(run, ", ".join([*fields, "n_tokens long", "ids_sha256 string", "decoded_sha256 string"]))
