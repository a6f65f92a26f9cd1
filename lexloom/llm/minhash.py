"""MinHash near-duplicates by fast similarity sketching.

1. *Sets.* A document's set holds 64-bit hashes of its distinct word shingles (the whole sequence where words are
   few). Documents of one set are one node, told by 128 bits of the sorted set.
2. *Sketches.* Of ``BANDS * ROWS`` coordinates. In round i every element draws a coordinate and a value in
   [i, i + 1); a coordinate keeps its least value. After as many rounds as there are coordinates, round by round one
   fixed coordinate takes all elements, so none stays empty; a document whose coordinates are full stops, as later
   values are larger. Two coordinates agree with the probability of the Jaccard similarity, and their number is
   concentrated as that of independent draws.
3. *Banding.* ``ROWS`` coordinates make a band; nodes that share a band are candidates. At a similarity of 0.8 a pair
   shares none of 28 bands with a probability of 4e-7, less above it.
4. *Families.* Inside bands, candidates whose sketches (four bits a coordinate) agree in so few coordinates that a true
   link would do so with a probability of ``MISS`` are told apart; components of the others are families.
5. *Exact verification.* Families meet with their full sets, and intersections are counted exactly.

Steps 4 and 5 search groups with :func:`lexloom.llm.groups.group_links`: no all pairs, no group in one task.

Defined results: null and empty texts and texts without words have n_shingles 0, are linked with nothing and kept;
null doc_ids are kept and count only where a component has no other; repeated rows share set and component; texts of any
length are hashed whole; extra columns pass through :func:`drop_near_duplicates`; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, partial
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import LOWER, SPACE, UPPER, durable, packed, unpacked, written
from lexloom.llm.components import connected_components
from lexloom.llm.groups import Measure, group_links, spread_join

SHINGLE, PERCENT, BANDS, ROWS = 4, 80, 28, 4
COORDINATES = BANDS * ROWS
SEED = 42
#: Probability with which a pair at the threshold may be told apart by its sketches.
MISS = 1e-7
#: Rows of a chunk of sketches, and shingles of a chunk of sets.
SKETCH_CAP, SET_CAP = 4096, 1 << 18
#: Wanted texts up to which their hashes are broadcast (16 bytes each), and shingles that are sketched together.
MANY_TEXTS, AT_ONCE = 1_000_000, 1 << 20
SALTS = 16

_LOWER_TABLE = bytes.maketrans(UPPER.encode(), LOWER.encode())
_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that scatters every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Vocabulary(dict):
    """Hashes of words, kept while they are few."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 1 << 18:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word, SEED)
        return value


def shingles(text: bytes, vocabulary: Vocabulary, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted set of a text's shingle hashes."""
    words = text.translate(_LOWER_TABLE).split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(vocabulary.__getitem__, words), np.uint64, len(words))
    size = min(shingle, len(words))
    n = len(words) - size + 1
    out = np.full(n, size, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = mix((out ^ hashes[k : k + n]) * _STEP + np.uint64(k))
    return np.unique(out)


def sketches(sets: list[np.ndarray], coordinates: int = COORDINATES) -> np.ndarray:
    """Rows of coordinates of non-empty sets: round in the top bits, hashed value below."""
    rounds = 2 * coordinates
    shift = np.uint64(64 - int(rounds).bit_length())
    full = np.full((len(sets), coordinates), np.iinfo(np.uint64).max, np.uint64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    cells = full.reshape(-1)
    with np.errstate(over="ignore"):
        for i in range(rounds):
            x = mix(flat ^ mix(np.uint64(i + 1) * _STEP))
            value = (np.uint64(i) << shift) | (x & ((np.uint64(1) << shift) - np.uint64(1)))
            # The coordinate comes from the top 32 bits of another scattering, the value from x.
            place = ((mix(x) >> np.uint64(32)) * np.uint64(coordinates) >> np.uint64(32)).astype(np.int64) if i < coordinates else i - coordinates
            np.minimum.at(cells, owner * coordinates + place, value)
            open_ = (full == np.iinfo(np.uint64).max).any(axis=1)
            if not open_.any():
                break
            if (keep := open_[owner]).mean() < 0.9:
                flat, owner = flat[keep], owner[keep]
    return full


def bands(sketch: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key per band, as signed longs."""
    parts = sketch.reshape(len(sketch), -1, rows)
    with np.errstate(over="ignore"):
        out = mix(np.arange(1, parts.shape[1] + 1, dtype=np.uint64) * _STEP)[None, :].repeat(len(sketch), 0)
        for k in range(rows):
            out = mix((out ^ parts[:, :, k]) * _STEP)
    return out.view(np.int64)


def nibbles(sketch: np.ndarray) -> np.ndarray:
    """Four bits of each coordinate, two a byte."""
    low = (mix(sketch) & np.uint64(15)).astype(np.uint8)
    return low[:, ::2] | (low[:, 1::2] << 4)


@lru_cache(maxsize=64)
def least_agreement(coordinates: int = COORDINATES, percent: int = PERCENT, miss: float = MISS) -> int:
    """Agreements of four-bit coordinates that a pair at the threshold falls below with probability ``miss`` at most."""
    p = percent / 100 + (1 - percent / 100) / 16
    below = 0.0
    for k in range(coordinates + 1):
        below += comb(coordinates, k) * p**k * (1 - p) ** (coordinates - k)
        if below > miss:
            return k
    return coordinates


_ZERO_NIBBLES = np.array([(b & 15 == 0) + (b >> 4 == 0) for b in range(256)], np.uint8)


class SketchMeasure(Measure):
    """Whether two sketches may belong to a link."""

    def __init__(self, payloads: list[bytes], sizes: np.ndarray, percent: int = PERCENT, least: int = 0):
        self.rows = np.frombuffer(b"".join(payloads), np.uint8).reshape(len(payloads), -1)
        self.sizes, self.percent, self.least = sizes, percent, least

    def _sized(self, i, j) -> np.ndarray:
        a, b = self.sizes[i], self.sizes[j]
        return 100 * np.minimum(a, b) >= self.percent * np.maximum(a, b)

    def pairs(self, i, j):
        return self._sized(i, j) & (_ZERO_NIBBLES[self.rows[i] ^ self.rows[j]].sum(axis=1) >= self.least)

    def against(self, x, others):
        return self.pairs(others, x)


class SetMeasure(Measure):
    """Whether the full sets are linked."""

    def __init__(self, payloads: list[bytes], sizes: np.ndarray, percent: int = PERCENT):
        self.flat = np.frombuffer(b"".join(payloads), np.uint64)
        self.sizes, self.percent = sizes, percent
        self.starts = np.concatenate(([0], np.cumsum(sizes)))
        self.postings: tuple | None = None

    def _linked(self, common, i, j):
        return 100 * common >= self.percent * (self.sizes[i] + self.sizes[j] - common)

    def _set(self, x: int) -> np.ndarray:
        return self.flat[self.starts[x] : self.starts[x + 1]]

    def pairs(self, i, j):
        out = np.zeros(len(i), bool)
        a, b = self.sizes[i], self.sizes[j]
        for k in np.flatnonzero(100 * np.minimum(a, b) >= self.percent * np.maximum(a, b)).tolist():
            both = np.concatenate((self._set(i[k]), self._set(j[k])))
            both.sort()
            out[k] = self._linked(np.count_nonzero(both[1:] == both[:-1]), i[k], j[k])
        return out

    def against(self, x, others):
        if self.postings is None:  # rows of each shingle, by the shingle's place in order
            order = np.argsort(self.flat, kind="stable")
            ordered = self.flat[order]
            begins = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
            place = np.empty(len(order), np.int64)
            place[order] = np.repeat(np.arange(len(begins)), np.diff(np.concatenate((begins, [len(order)]))))
            rows = np.repeat(np.arange(len(self.sizes)), self.sizes)[order]
            self.postings = place, np.concatenate((begins, [len(order)])), rows
        place, begins, rows = self.postings
        at = place[self.starts[x] : self.starts[x + 1]]
        held = [rows[a:b] for a, b in zip(begins[at].tolist(), begins[at + 1].tolist(), strict=True)]
        common = np.bincount(np.concatenate(held), minlength=len(self.sizes))
        return self._linked(common[others], others, x)


def _digest_of(s: np.ndarray) -> tuple[int, int]:
    import xxhash

    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)


def _bytes_of(value) -> bytes:
    return value.as_buffer().to_pybytes() if value.is_valid else b""


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    vocabulary = Vocabulary()
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            sets, total, begin = [], 0, at
            while at < batch.num_rows and (total < AT_ONCE or not sets):
                sets.append(shingles(_bytes_of(batch.column("t")[at]), vocabulary))
                total += len(sets[-1])
                at += 1
            filled = [s for s in sets if len(s)]
            made = sketches(filled) if filled else np.empty((0, COORDINATES), np.uint64)
            keys, marks = iter(bands(made).tolist()), iter(nibbles(made))
            rows = [(len(s), *_digest_of(s), next(keys), next(marks).tobytes()) if len(s) else (0, None, None, None, None) for s in sets]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            made_columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            part = batch.slice(begin, at - begin)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("th"), *made_columns], ["doc_id", "th", "n", "d1", "d2", "keys", "marks"])


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Full sets of wanted texts; a text that only shares the hash of the wanted one is left out."""
    vocabulary = Vocabulary()
    for batch in batches:
        rows, size = [], 0
        for t, node, key, d1, d2 in zip(batch.column("t"), *(batch.column(n).to_pylist() for n in ("node", "key", "d1", "d2")), strict=True):
            s = shingles(_bytes_of(t), vocabulary)
            if _digest_of(s) == (d1, d2):
                rows.append((key, node, len(s), s.tobytes()))
                size += len(s)
            if size > AT_ONCE:
                yield _sets(rows)
                rows, size = [], 0
        yield _sets(rows)


def _sets(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["key", "node", "size", "payload"])


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias("th"), F.col(f"`{text}`").alias("t"))


def sketched(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id, th, n, d1, d2, keys, marks`` per row: set size, digest of the set, band keys, four-bit sketch."""
    kind = docs.schema[doc_id].dataType.simpleString()
    return _keyed(docs, text, doc_id).mapInArrow(_sketch_batches, f"doc_id {kind}, th long, n long, d1 long, d2 long, keys array<long>, marks binary")


def families(nodes: DataFrame, percent: int = PERCENT, cap: int = SKETCH_CAP) -> DataFrame:
    """``(node, root)`` of nodes that a link may join with another one: components of like sketches in bands."""
    placed = nodes.select(F.explode("keys").alias("key"), "node")
    # Keys that several nodes hold, each with its number of nodes.
    held = durable(placed.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"))
    shared = spread_join(placed, held, ["key"], "m").select("key", "node")
    members = written(shared.join(nodes.select("node", F.col("n").alias("size"), F.col("marks").alias("payload")), "node"))
    measure = partial(SketchMeasure, percent=percent, least=least_agreement(COORDINATES, percent, MISS))
    return durable(connected_components(group_links(members, measure, cap)))


def links(docs: DataFrame, nodes: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT, sketch_cap: int = SKETCH_CAP, set_cap: int = SET_CAP) -> DataFrame:
    """``(u, v)``: exact links that span every component, between nodes of :func:`sketched` sets."""
    like = families(nodes, percent, sketch_cap)
    wanted = durable(like.join(nodes, "node").select("node", F.col("root").alias("key"), F.col("rep_id").alias("own_i"), F.col("rep_th").alias("th"), "d1", "d2"))
    count = wanted.count()
    texts = _keyed(docs, text, doc_id).join(F.broadcast(wanted) if count <= MANY_TEXTS else wanted, "th").filter(F.col("doc_id").eqNullSafe(F.col("own_i")))
    sets = written(texts.select("t", "node", "key", "d1", "d2").mapInArrow(_set_batches, "key long, node long, size long, payload binary"))
    if sets.count() > count:  # repeated rows of one text and id
        sets = written(sets.dropDuplicates(["node"]))
    return group_links(sets, partial(SetMeasure, percent=percent), set_cap, F.col("size"))


def components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT, sketch_cap: int = SKETCH_CAP, set_cap: int = SET_CAP) -> DataFrame:
    """``doc_id, th, n, group, component_id`` per row; rows of one component share the group, null for empty sets."""
    rows = written(sketched(docs, text, doc_id))
    full = rows.filter("n > 0")
    nodes = full.groupBy("d1", "d2").agg(
        F.min("n").alias("n"), F.min("doc_id").alias("rep_id"), F.coalesce(F.min_by("th", "doc_id"), F.min("th")).alias("rep_th"),
        F.count("*").alias("copies"), F.first("keys").alias("keys"), F.first("marks").alias("marks"),
    )
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()))  # numbers stand once they are written
    stars = durable(connected_components(links(docs, nodes, text, doc_id, percent, sketch_cap, set_cap)))
    linked = durable(stars.join(nodes.select("node", "rep_id"), "node"))
    # Nodes of one root are dealt over SALTS tasks.
    least = linked.groupBy("root").agg(F.min("rep_id").alias("least")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    named = linked.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(least, ["root", "salt"]).select("node", "root", "least")
    labels = nodes.select("node", "d1", "d2", "copies", "rep_id").join(named, "node", "left")
    own = F.when(F.col("root").isNull(), F.col("rep_id")).otherwise(F.col("least"))
    labels = durable(labels.select("d1", "d2", "copies", F.coalesce("root", "node").alias("group"), own.alias("component_id")))
    out = spread_join(full.select("doc_id", "th", "n", "d1", "d2"), labels, ["d1", "d2"], "copies").select("doc_id", "th", "n", "group", "component_id")
    alone = rows.filter("n = 0").select("doc_id", "th", "n", F.lit(None).cast("long").alias("group"), F.col("doc_id").alias("component_id"))
    return out.unionAll(alone)


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", percent: int = PERCENT) -> DataFrame:
    """One row of each component stays: that with the smallest doc_id (one of them, should it repeat)."""
    found = components(docs, text, doc_id, percent).filter("group is not null").filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = found.groupBy("group").agg(F.min(F.struct("doc_id", "th")).alias("x")).select(F.col("x.doc_id").alias("own_i"), F.col("x.th").alias("own_t"))
    empty = F.trim(F.translate(F.coalesce(F.col(f"`{text}`"), F.lit("")), SPACE[1:], " " * 5)) == ""
    keyed = packed(docs, i=F.col(f"`{doc_id}`"), t=F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))), e=empty)
    kept = keyed.filter("not e").join(first, F.col("i").eqNullSafe(F.col("own_i")) & (F.col("t") == F.col("own_t"))).dropDuplicates(["own_i", "own_t"])
    return unpacked(kept.select("row"), docs.columns).unionAll(unpacked(keyed.filter("e").select("row"), docs.columns))


def digest(docs: DataFrame) -> DataFrame:
    found = components(docs.select("doc_id", "text"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


#: All pairs that share a shingle, counted.
ORACLE = f"""
WITH RECURSIVE split AS (
  SELECT row_number() OVER () AS rid, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), sets AS MATERIALIZED (
  SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' ')))) END AS s
  FROM split
), nodes AS MATERIALIZED (
  SELECT row_number() OVER () AS node, md5(array_to_string(s, '|')) AS h, any_value(s) AS s, min(doc_id) AS least, len(any_value(s)) AS n FROM sets WHERE len(s) > 0 GROUP BY md5(array_to_string(s, '|'))
), held AS MATERIALIZED (
  SELECT node, n, unnest(s) AS x FROM nodes
), pairs AS (
  SELECT a.node AS u, b.node AS v, any_value(a.n) AS nu, any_value(b.n) AS nv, count(*) AS c FROM held a JOIN held b ON a.x = b.x AND a.node < b.node GROUP BY a.node, b.node
), near AS MATERIALIZED (
  SELECT u, v FROM pairs WHERE 100 * c >= {PERCENT} * (nu + nv - c)
), edges AS MATERIALIZED (
  SELECT u, v FROM near UNION ALL SELECT v, u FROM near
), reach(a, b) AS (
  SELECT node, node FROM nodes UNION SELECT r.a, e.v FROM reach r JOIN edges e ON r.b = e.u
), least AS (
  SELECT n.h, min(m.least) AS least FROM reach JOIN nodes n ON n.node = a JOIN nodes m ON m.node = b GROUP BY n.h
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE l.least END AS component_id,
  s.doc_id IS NOT DISTINCT FROM (CASE WHEN len(s.s) = 0 THEN s.doc_id ELSE l.least END) AS kept
FROM sets s LEFT JOIN least l ON l.h = md5(array_to_string(s.s, '|'))
"""
