"""All links inside groups of any size, without all pairs of a group.

:func:`group_links` takes ``(key, node, size, payload)`` and a measure (see :class:`Measure`) and returns links between
near members of equal keys that span every component of such links. Members of a group that fits a task are searched
breadth-first, each being linked once, so a dense group costs about as much as it has members. A larger group is dealt
over chunks that all hold the same few pivots; the largest class that this joins is then compared only with what it
leaves out, chunk by chunk. No link between classes is lost, and no task gets more than about two chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import durable
from lexloom.llm.components import connected_components

PIVOTS = 16
#: Keys with more than this share of all rows are at most so many, and their facts are broadcast.
HEAVY = 1000


class Measure:
    """Nearness of the members of a block; made from their payloads and sizes."""

    def __init__(self, payloads: list[bytes], sizes: np.ndarray):
        raise NotImplementedError

    def pairs(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which of the pairs are near."""
        raise NotImplementedError

    def against(self, x: int, others: np.ndarray) -> np.ndarray:
        """Which of the others are near x."""
        raise NotImplementedError


def spread_join(rows: DataFrame, facts: DataFrame, keys: list[str], counted: str, how: str = "inner") -> DataFrame:
    """``rows`` with the facts of their keys, one row a key, whose ``counted`` is the number of rows that hold it.

    Keys with over a thousandth of all rows are a thousand at most: their facts are broadcast, so that their rows stay
    where they are. The other keys are joined by shuffle. ``how`` is inner or left.
    """
    total = facts.agg(F.sum(counted)).first()[0] or 0
    heavy = facts.filter(F.col(counted) > max(1, total // HEAVY))
    if heavy.isEmpty():
        return rows.join(facts, keys, how)
    near = rows.join(F.broadcast(heavy), keys)
    rest = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(facts.filter(F.col(counted) <= max(1, total // HEAVY)), keys, how)
    return near.unionByName(rest)


def _walk(measure: Measure, n: int) -> tuple[list[int], list[int]]:
    left = np.arange(n)
    us, vs = [], []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = measure.against(at, left)
            found = left[near].tolist()
            if found:
                left = left[~near]
                queue += found
                us += [at] * len(found)
                vs += found
    return us, vs


def links_of_runs(kind: Callable[..., Measure], runs: np.ndarray, nodes: np.ndarray, sizes: np.ndarray, payloads: list[bytes], small: int = 16) -> tuple[list[int], list[int]]:
    """Links inside each run of equal numbers; short runs are compared together, at growing distance."""
    starts = np.flatnonzero(np.concatenate(([True], runs[1:] != runs[:-1])))
    lengths = np.diff(np.concatenate((starts, [len(runs)])))
    us, vs = [], []
    short = np.flatnonzero((np.repeat(lengths, lengths) <= small) & (np.repeat(lengths, lengths) > 1))
    if len(short):
        measure = kind([payloads[k] for k in short], sizes[short])
        run, i = runs[short], np.arange(len(short))
        for step in range(1, small):
            i = i[i + step < len(short)]
            i = i[run[i] == run[i + step]]
            if not len(i):
                break
            near = measure.pairs(i, i + step)
            us += nodes[short[i[near]]].tolist()
            vs += nodes[short[i[near] + step]].tolist()
    for s, n in zip(starts[lengths > small].tolist(), lengths[lengths > small].tolist(), strict=True):
        u, v = _walk(kind(payloads[s : s + n], sizes[s : s + n]), n)
        us += nodes[s + np.array(u, np.int64)].tolist()
        vs += nodes[s + np.array(v, np.int64)].tolist()
    return us, vs


def _search(kind: Callable[..., Measure]):
    """Over batches sorted by (key, a, b): whole runs are searched, the last one waits for the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, list[bytes]]] = []

        def search(rows: np.ndarray, payloads: list[bytes]) -> pa.RecordBatch:
            change = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
            u, v = links_of_runs(kind, np.concatenate(([0], np.cumsum(change))), rows[:, 3], rows[:, 4], payloads)
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("key", "a", "b", "node", "size")], axis=1)
            payloads = batch.column("payload").to_pylist()
            if held and (held[-1][0][-1, :3] == rows[-1, :3]).all():  # still inside one run
                held.append((rows, payloads))
                continue
            rows = np.concatenate([*(r for r, _ in held), rows])
            payloads = [p for _, ps in held for p in ps] + payloads
            other = np.flatnonzero((rows[:, :3] != rows[-1, :3]).any(axis=1))
            last = int(other[-1]) + 1 if len(other) else 0
            held = [(rows[last:], payloads[last:])]
            if last:
                yield search(rows[:last], payloads[:last])
        if held:
            yield search(np.concatenate([r for r, _ in held]), [p for _, ps in held for p in ps])

    return run


def group_links(members: DataFrame, kind: Callable[..., Measure], cap: int, weight: Column | None = None) -> DataFrame:
    """``(u, v)`` for ``members(key, node, size, payload)``; ``cap`` bounds the weight of a task's chunk."""
    w = F.lit(1).cast("long") if weight is None else weight.cast("long")
    columns = ["key", "a", "b", "node", "size", "payload"]
    zero = [F.lit(0).alias("a"), F.lit(0).alias("b")]
    search = lambda rows: rows.select(*columns).repartition("key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(_search(kind), "u long, v long")
    large = durable(members.groupBy("key").agg(F.count("*").alias("m"), F.sum(w).alias("w")).filter(F.col("w") > cap))
    if large.isEmpty():
        return search(members.select("*", *zero))
    slim = durable(spread_join(members.select("key", "node", w.alias("own_w")), large, ["key"], "m"))
    told = spread_join(members, large, ["key"], "m", "left")
    chunks = F.ceil(F.col("w") / cap).cast("int")
    h = F.xxhash64("node", "key")
    own = F.pmod(h, chunks).cast("int")
    is_pivot = F.pmod(F.xxhash64("key", "node"), F.ceil(F.col("m") / PIVOTS)) == 0
    at = F.when(F.col("w").isNull(), F.array(F.lit(0))).when(is_pivot, F.sequence(F.lit(0), chunks - 1)).otherwise(F.array(own))
    first = told.select("key", "node", "size", "payload", F.explode(at).alias("a")).withColumn("b", F.col("a"))
    roots = durable(connected_components(search(first)))
    near = roots.filter("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))  # they span the same
    classed = durable(slim.join(roots, "node", "left").select("key", "node", "own_w", "w", F.coalesce("root", "node").alias("root")))
    classes = classed.groupBy("key", "w", "root").agg(F.sum("own_w").alias("part"), F.count("*").alias("rows"))
    half = cap / 2
    top = classes.groupBy("key", "w").agg(F.max(F.struct("part", "root")).alias("top"), F.sum("rows").alias("m"))
    top = durable(top.select("key", "m", F.col("top.root").alias("top"), F.ceil((F.col("w") - F.col("top.part")) / half).cast("int").alias("outside"), F.ceil(F.col("top.part") / half).cast("int").alias("inside")).filter("outside > 0"))
    if top.isEmpty():
        return near
    h = F.xxhash64("node", F.lit(7), "key")
    is_top = F.col("root") == F.col("top")
    mine = F.when(is_top, F.col("outside") + F.pmod(h, F.col("inside"))).otherwise(F.pmod(h, F.col("outside"))).cast("int")
    last = F.when(is_top, F.col("outside") - 1).otherwise(F.col("outside") + F.col("inside") - 1)
    placed = spread_join(classed, top, ["key"], "m").select("key", "node", mine.alias("mine"), last.alias("last"))
    held = placed.join(members, ["key", "node"]).select("key", "node", "size", "payload", "mine", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("other"))
    rest = held.select("key", "node", "size", "payload", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"))
    return near.unionAll(search(rest))
