"""SimHash near-duplicates through a segment-popcount embedding.

A fingerprint's 64 bits are cut into 32 segments of two bits; the per-segment bit counts form a point of
{0, 1, 2}^32. The Manhattan distance of two points never exceeds the Hamming distance of their fingerprints.
The 32 coordinates are dealt into ``limit + agree`` subspaces: points within Manhattan distance ``limit`` agree on at
least ``agree`` subspaces entirely, so the cells of a unit grid over every choice of ``agree`` subspaces hold every
link (a range join without misses). Within a cell the Manhattan bound prunes and the exact Hamming distance decides.
Any ``agree`` finds the same links; a larger one makes more and emptier cells, and :func:`grid_for` picks it by the
number of points, so that a point meets a bounded number of chance neighbours.

Distinct fingerprints are the nodes, so copies cost nothing. A cell yields a spanning forest of its links, never
all pairs. In cells above ``cell_rows`` points every point first links to the pivots near it; what this joins is then
compared only with what it leaves out, in chunks that separate tasks visit (see :func:`_by_pivots`).

Defined results: null and empty texts and texts without words have fingerprint zero and link like any other;
null doc_ids are kept and count only when a whole component has no other; repeated rows share fingerprint and
component; extra columns pass through :func:`drop_near_duplicates`; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import LOWER, UPPER, durable, packed, unpacked
from lexloom.llm.components import connected_components

SHINGLE = 4
LIMIT = 4
SEED = 42
CELL_ROWS = 4096
SALTS, PIVOTS = 16, 64

_LOWER_TABLE = bytes.maketrans(UPPER.encode(), LOWER.encode())


def fingerprint_of(text: str | None, shingle: int = SHINGLE) -> int:
    """The signed 64-bit fingerprint of one text."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER_TABLE).split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = np.array([digest(joined, SEED)], dtype=np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):  # in blocks, so a very long text needs little memory
        block = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = pa.array([fingerprint_of(t.as_py()) for t in batch.column("__text")], pa.int64())
        kept = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "__text"]
        yield pa.RecordBatch.from_arrays([*(c for _, c in kept), prints], [*(n for n, _ in kept), "fp"])


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, th, fp)`` per row; ``th`` is a hash of the text that tells rows of one id apart."""
    told = docs.select(F.col(doc_id).alias("doc_id"), text_hash(text).alias("th"), F.col(text).alias("__text"))
    return told.mapInArrow(_fingerprint_batches, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, th long, fp long")


def text_hash(text: str = "text"):
    return F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))


def embed(fp):
    """Per-segment bit counts, packed: the two-bit field i holds the number of ones of segment i.

    The sum of two bits is written with logic only, since a carry-free form cannot overflow."""
    even = F.lit(0x5555555555555555)
    a, b = fp.bitwiseAND(even), F.shiftrightunsigned(fp, 1).bitwiseAND(even)
    return F.shiftleft(a.bitwiseAND(b), 1).bitwiseOR(a.bitwiseXOR(b))


def subspace_masks(limit: int, agree: int = 2) -> list[int]:
    """Masks of the packed coordinates of every choice of ``agree`` subspaces, as signed longs."""
    groups = [sum(3 << (2 * i) for i in range(32) if i % (limit + agree) == g) for g in range(limit + agree)]
    masks = [sum(chosen) for chosen in combinations(groups, agree)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def grid_for(points: int, limit: int, neighbours: int = 256) -> int:
    """The least ``agree`` at which a point shares cells with about ``neighbours`` random others at most.

    Two random two-bit counts are equal with probability 3/8.
    """
    for agree in range(2, 8):
        chance = comb(limit + agree, agree) * (3 / 8) ** (32 * agree / (limit + agree))
        if points * chance <= neighbours:
            break
    return agree


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int16)


def _manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of packed points: a field differs by 1 for xor 01 or 11 and by 2 for xor 10."""
    even = np.uint64(0x5555555555555555)
    x = a ^ b
    low, high = x & even, (x >> np.uint64(1)) & even
    return _popcount(low) + 2 * _popcount(high) - 2 * _popcount(low & high)


def _embed_array(fp: np.ndarray) -> np.ndarray:
    even = np.uint64(0x5555555555555555)
    return (fp & even) + ((fp >> np.uint64(1)) & even)


def _near(points: np.ndarray, prints: np.ndarray, i, j, limit: int) -> np.ndarray:
    """For an index array i and an array or one index j: which pairs pass the bound and then the exact test."""
    near = _manhattan(points[i], points[j]) <= limit
    if near.any():
        near[near] = _popcount((prints[i] ^ prints[j])[near]) <= limit
    return near


def _walk(points: np.ndarray, prints: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Breadth-first search over one large cell: each point is linked once, so dense cells end quickly."""
    left = np.arange(len(prints))
    us, vs = [], []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = _near(points, prints, left, at, limit)
            found = left[near]
            if len(found):
                left = left[~near]
                queue += found.tolist()
                us.append(np.full(len(found), at))
                vs.append(found)
    join = lambda parts: np.concatenate(parts) if parts else np.empty(0, np.int64)
    return join(us), join(vs)


def _forest(u: np.ndarray, v: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    out = []
    for a, b in zip(u.tolist(), v.tolist(), strict=True):
        ra, rb = top(a), top(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
            out.append((a, b))
    return out


def _links_in(cells: np.ndarray, prints: np.ndarray, limit: int, small: int = 64) -> list[tuple[int, int]]:
    """Spanning links of rows sorted so that each cell is one run; cells: the run's number per row."""
    if len(prints) < 2:
        return []
    unsigned = prints.view(np.uint64)
    points = _embed_array(unsigned)
    starts = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
    sizes = np.diff(np.concatenate((starts, [len(cells)])))
    size_of = np.repeat(sizes, sizes)
    us, vs = [], []
    in_small = np.flatnonzero(size_of <= small)
    run = cells
    for step in range(1, int(min(small, sizes.max()))):
        i = in_small[in_small + step < len(run)]
        i = i[run[i] == run[i + step]]
        if not len(i):
            break
        near = _near(points, unsigned, i, i + step, limit)
        us.append(prints[i[near]])
        vs.append(prints[i[near] + step])
        in_small = i
    for s, n in zip(starts[sizes > small].tolist(), sizes[sizes > small].tolist(), strict=True):
        u, v = _walk(points[s : s + n], unsigned[s : s + n], limit)
        us.append(prints[s + u])
        vs.append(prints[s + v])
    if not us:
        return []
    return _forest(np.concatenate(us), np.concatenate(vs))


def _link_batches(limit: int):
    """Over batches sorted by cell: whole cells are searched, the last one waits for the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def search(rows: np.ndarray) -> pa.RecordBatch:
            change = (rows[1:, :4] != rows[:-1, :4]).any(axis=1)
            cells = np.concatenate(([0], np.cumsum(change)))
            links = _links_in(cells, np.ascontiguousarray(rows[:, 4]), limit)
            u, v = zip(*links, strict=True) if links else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for batch in batches:
            rows = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("k", "cell", "a", "b", "fp")], axis=1)
            if not len(rows):
                continue
            if held and (held[-1][-1, :4] == rows[-1, :4]).all():  # still inside one cell
                held.append(rows)
                continue
            rows = np.concatenate([*held, rows])
            last = int(np.flatnonzero((rows[:, :4] != rows[-1, :4]).any(axis=1))[-1]) + 1 if (rows[:, :4] != rows[-1, :4]).any() else 0
            held = [rows[last:]]
            if last:
                yield search(rows[:last])
        if held:
            yield search(np.concatenate(held))

    return run


def links(prints: DataFrame, limit: int = LIMIT, cell_rows: int = CELL_ROWS, agree: int | None = None) -> DataFrame:
    """``(u, v)``: links between distinct fingerprints ``fp`` that span every component."""
    masks = subspace_masks(limit, agree or grid_for(prints.count(), limit))
    point = prints.select("fp", embed(F.col("fp")).alias("p"))
    cells = F.array(*(F.struct(F.lit(k).alias("k"), F.col("p").bitwiseAND(F.lit(m)).alias("cell")) for k, m in enumerate(masks)))
    placed = point.select("fp", F.explode(cells).alias("c")).select("c.k", "c.cell", "fp")
    large = durable(placed.groupBy("k", "cell").agg(F.count("*").alias("n")).filter(F.col("n") > cell_rows))
    search = lambda rows: rows.repartition("k", "cell", "a", "b").sortWithinPartitions("k", "cell", "a", "b").mapInArrow(_link_batches(limit), "u long, v long")
    alone = [F.lit(0).alias("a"), F.lit(0).alias("b"), "fp"]
    if large.isEmpty():
        return search(placed.select("k", "cell", *alone))
    sized = placed.join(large, ["k", "cell"], "left")
    spokes, rest = _by_pivots(sized.filter("n is not null"), limit, cell_rows)
    return search(sized.filter("n is null").select("k", "cell", *alone).unionAll(rest)).unionAll(spokes)


def _by_pivots(members: DataFrame, limit: int, cell_rows: int) -> tuple[DataFrame, DataFrame]:
    """Of large cells ``(k, cell, fp, n)``: links to pivots, and rows whose chunks are still to be searched.

    About ``PIVOTS`` prints of a cell are pivots, and every print links to those near it. Prints that this joins need
    no comparing: of each cell the largest class found so far is compared only with what is outside it, in chunks that
    meet chunk by chunk, so no link between classes is lost and a dense cell costs about as much as it has rows.
    """
    members = durable(members)
    every = F.ceil(F.col("n") / PIVOTS)
    pivots = members.filter(F.pmod(F.xxhash64("fp", "k"), every) == 0).groupBy("k", "cell").agg(F.sort_array(F.collect_list("fp")).alias("pivots"))
    near = F.filter("pivots", lambda p: F.bit_count(F.col("fp").bitwiseXOR(p)) <= limit)
    spread = members.join(pivots, ["k", "cell"]).select("fp", near.alias("near")).filter(F.size("near") > 0)
    first = F.get("near", F.lit(0))
    joined = spread.filter(F.size("near") > 1).select(first.alias("u"), F.explode(F.slice("near", F.lit(2), F.size("near"))).alias("v")).distinct()
    spokes = durable(spread.select(F.col("fp").alias("u"), first.alias("v")).filter("u <> v").distinct().unionAll(joined))
    roots = durable(connected_components(spokes))
    classed = members.join(roots, F.col("fp") == F.col("node"), "left").select("k", "cell", "fp", "n", F.coalesce("root", "fp").alias("root"))
    largest = classed.groupBy("k", "cell", "n", "root").agg(F.count("*").alias("m")).groupBy("k", "cell", "n").agg(F.max(F.struct("m", "root")).alias("top"))
    half = cell_rows / 2
    largest = largest.select("k", "cell", F.col("top.root").alias("top"), F.ceil((F.col("n") - F.col("top.m")) / half).cast("int").alias("outside"), F.ceil(F.col("top.m") / half).cast("int").alias("inside"))
    told = classed.join(largest.filter("outside > 0"), ["k", "cell"])
    is_top, h = F.col("root") == F.col("top"), F.xxhash64("fp", "cell")
    own = F.when(is_top, F.col("outside") + F.pmod(h, F.col("inside"))).otherwise(F.pmod(h, F.col("outside"))).cast("int")
    last = F.when(is_top, F.col("outside") - 1).otherwise(F.col("outside") + F.col("inside") - 1)
    pairs = told.select("k", "cell", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), last)).alias("other"))
    return spokes, pairs.select("k", "cell", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp")


def components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", limit: int = LIMIT) -> DataFrame:
    """``(doc_id, th, fp, root, component_id)`` per row of the input."""
    rows = durable(fingerprints(docs, text, doc_id))
    nodes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    stars = durable(connected_components(links(nodes.select("fp"), limit)))
    linked = durable(stars.join(nodes, F.col("node") == F.col("fp")).select("fp", "root", "least"))
    # Only prints with links have a root to ask; those of one root are dealt over SALTS tasks.
    named = linked.groupBy("root").agg(F.min("least").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = linked.select("fp", "root", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int").alias("salt"))
    told = salted.join(named, ["root", "salt"]).select("fp", "root", "component_id")
    labels = nodes.join(told, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("component_id")).alias("component_id"))
    return rows.join(labels, "fp").select("doc_id", "th", "fp", "root", "component_id")


def drop_near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", limit: int = LIMIT) -> DataFrame:
    """One row of each component stays: that with the smallest doc_id (one of them, should it repeat)."""
    found = components(docs, text, doc_id, limit).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    equal = found.groupBy("root", "doc_id", "th").agg(F.count("*").alias("n"))
    first = durable(equal.groupBy("root").agg(F.min(F.struct("doc_id", "th", "n")).alias("x")))
    repeats = not first.filter("x.n > 1").isEmpty()
    first = first.select(F.col("x.doc_id").alias("own_i"), F.col("x.th").alias("own_t"))
    keyed = packed(docs, i=F.col(f"`{doc_id}`"), t=text_hash(text))
    kept = keyed.join(first, F.col("i").eqNullSafe(F.col("own_i")) & (F.col("t") == F.col("own_t")))
    if repeats:  # else every chosen row is alone, and the texts need no second shuffle
        kept = kept.dropDuplicates(["own_i", "own_t"])
    return unpacked(kept, docs.columns)


def digest(docs: DataFrame) -> DataFrame:
    found = components(docs.select("doc_id", "text"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", hexed.alias("fingerprint"), "component_id")
