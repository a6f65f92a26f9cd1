"""Mixing sources to target weights by cube-method balanced sampling.

A source with target T and size S takes every document ``floor(T / S)`` times and, in expectation, a further
fraction of it. The cube method decides the fractional part: the vector of inclusion probabilities walks inside
the null-space of the balancing constraints, here a source's token total and document total, and stops when a
coordinate reaches 0 or 1. With two constraints three open documents always leave a direction, so one pass over a
chunk closes all but two. Chunks run apart; what they leave open meets in ever fewer chunks until at most two
documents of a source are open (the landing problem), and those are rounded by a keyed draw.

Every move keeps the expectation of each coordinate, and draws are keyed by seed, source, level and chunk with
rows in a fixed order, so a rerun gives the same sample.

Equal rows (of id, source, size and text) are counted before anything moves and then numbered, so that a null or
repeated id is dealt over all chunks of its source; :func:`mix` gives each of them its own number of copies without
bringing them together.

Defined results: null texts have size 0 and are taken 0 words; a null source is a source of its own, after all
others; null doc_ids and repeated rows are documents like any other (equal rows may be taken differently, in a
fixed order); a corpus without words has targets of 0; an empty table gives an empty table; extra columns pass
through :func:`mix`, whatever their names.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexloom.llm.common import durable, packed, unpacked

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
CHUNK = 8192
SEED = 17


def size_of(text):
    """Number of words."""
    return F.coalesce(F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def plan(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``(source, source_size, n_docs, target)`` per source, the targets by water-filling in closed form.

    A target is ``min(most * size, level * weight)``. In order of ``most * size / weight`` the capped sources form
    a prefix, and the level of each prefix follows from running sums, so one sorted pass over the (few) sources
    finds what repeated resharing converges to.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    one = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.get(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(one) - 1) % len(weights)).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing).orderBy(F.lit(0))
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    per = per.withColumn(
        "level_here",
        (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
    )
    # The first source that its prefix's level does not fill sets the level; if none, all are at their caps.
    open_level = F.min(F.when(F.col("level_here") <= F.col("cap") / F.col("weight"), F.struct(F.col("cap") / F.col("weight"), "level_here"))).over(everything)
    level = open_level["level_here"]
    target = F.when(level.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), level * F.col("weight")))
    return per.select("source", "source_size", "n_docs", target.alias("target"))


def _settle_long(sizes: Sequence[int], probs: list[float], draw: random.Random, part: float = 1 / 256) -> list[float]:
    """Close the documents that hold over ``part`` of a chunk's words, against all shorter ones together.

    Three documents at a time, a long one would stay open to the end. Here the null vector has the long document
    on one side and every shorter one, in proportion to its variance, on the other. At most ``1 / part`` documents
    are that long. ``sizes`` descend.
    """
    s, p = np.asarray(sizes, float), np.asarray(probs, float)
    for k in range(int((s > part * s.sum()).sum())):
        for _ in range(16):
            rest = k + 1 + np.flatnonzero((p[k + 1 :] > 0) & (p[k + 1 :] < 1))
            if not 0 < p[k] < 1 or len(rest) < 3:
                break
            weight, r = p[rest] * (1 - p[rest]), s[rest]
            m0, m1, m2 = weight.sum(), (weight * r).sum(), (weight * r * r).sum()
            det = m0 * m2 - m1 * m1
            if det <= 1e-9 * m0 * m2:
                break
            u = np.zeros(len(s))
            u[rest] = -weight * ((m2 - m1 * s[k]) + (m0 * s[k] - m1) * r) / det
            u[k] = 1.0
            with np.errstate(divide="ignore", invalid="ignore"):
                up = np.nanmin(np.where(u > 0, (1 - p) / u, np.where(u < 0, -p / u, np.inf)))
                down = np.nanmin(np.where(u > 0, p / u, np.where(u < 0, -(1 - p) / u, np.inf)))
            p = p + (up if draw.random() * (up + down) < down else -down) * u
            p[p < 1e-9], p[p > 1 - 1e-9] = 0.0, 1.0
    return p.tolist()


def _flight(sizes: Sequence[int], probs: list[float], draw: random.Random) -> list[float]:
    """Walk through the cube until at most two coordinates are open; closed ones are 0 or 1.

    Units that balance on (size, 1): the null vector of three is the cross product of the two constraints.
    """
    probs = _settle_long(sizes, probs, draw)
    open_units: list[int] = []
    for k in range(len(probs)):
        if 0.0 < probs[k] < 1.0:
            open_units.append(k)
        while len(open_units) >= 2:
            a, b = open_units[0], open_units[1]
            if sizes[a] == sizes[b]:
                units, u = [a, b], [1.0, -1.0]
            elif len(open_units) < 3:
                break
            else:
                c = open_units[2]
                units = [a, b, c]
                u = [float(sizes[b] - sizes[c]), float(sizes[c] - sizes[a]), float(sizes[a] - sizes[b])]
            _move(probs, units, u, draw)
            open_units = [x for x in open_units if 0.0 < probs[x] < 1.0]
    return probs


def _move(probs: list[float], units: list[int], u: list[float], draw: random.Random) -> None:
    """One step to a face of the cube along +u or -u, with chances that keep the expectation."""
    up = min(((1 - probs[k]) / x if x > 0 else probs[k] / -x) for k, x in zip(units, u, strict=True) if x)
    down = min((probs[k] / x if x > 0 else (1 - probs[k]) / -x) for k, x in zip(units, u, strict=True) if x)
    step = up if draw.random() * (up + down) < down else -down
    for k, x in zip(units, u, strict=True):
        p = probs[k] + step * x
        probs[k] = 0.0 if p < 1e-9 else 1.0 if p > 1 - 1e-9 else p


def _land(sizes: Sequence[int], probs: list[float], draw: random.Random) -> list[float]:
    """The landing problem: give up the document total, then the token total, and round what is left."""
    probs = list(probs)
    left = [k for k, p in enumerate(probs) if 0.0 < p < 1.0]
    if len(left) == 2 and (sizes[left[0]] or sizes[left[1]]):
        _move(probs, left, [float(sizes[left[1]]), -float(sizes[left[0]])], draw)
    for k in left:
        if 0.0 < probs[k] < 1.0:
            probs[k] = float(draw.random() < probs[k])
    return probs


def _fly(last: bool, level: int, seed: int):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        # Long documents first: neighbours are then alike, and what stays open for the landing is short.
        rows = rows.sort_by([("size", "descending"), ("rank", "ascending"), ("doc_id", "ascending")])
        source, bucket = (k.as_py() for k in key)
        draw = random.Random(f"{seed}/{source!r}/{level}/{bucket}")
        sizes = rows["size"].to_pylist()
        probs = _flight(sizes, rows["prob"].to_pylist(), draw)
        if last:
            probs = _land(sizes, probs, draw)
        return rows.set_column(rows.schema.get_field_index("prob"), "prob", pa.array(probs, pa.float64()))

    return run


def take(sized: DataFrame, targets: DataFrame, seed: int = SEED, chunk: int = CHUNK) -> DataFrame:
    """``(doc_id, source, size, source_size, target, copies)`` per row of ``sized``, and ``th`` if it has that.

    ``targets`` comes from :func:`plan`. Chunks hold about ``chunk`` rows whatever a source's share of the corpus.
    """
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    facts = targets.select(F.col("source").alias("__source"), "source_size", "n_docs", "target", times.alias("times"))
    units = [c for c in ("doc_id", "source", "size", "th") if c in sized.columns]
    joined = _numbered(sized.select(*units)).join(F.broadcast(facts) if _few(facts) else facts, F.col("source").eqNullSafe(F.col("__source")))
    base = F.floor("times").cast("long")
    rows = joined.select(
        *units, "source_size", "target", "n_docs", base.alias("base"), (F.col("times") - base).alias("prob"),
        F.xxhash64(F.lit(seed), *(u for u in units if u not in ("source", "size")), "nth").alias("rank"),
    )
    schema = rows.schema.simpleString()[len("struct<") : -1]
    largest = targets.agg(F.max("n_docs")).first()[0] or 0
    closed, level = [], 0
    while True:
        chunks = F.greatest(F.lit(1), F.ceil(F.col("n_docs") / (chunk * (chunk // 4) ** level)).cast("int"))
        last = largest <= chunk * (chunk // 4) ** level
        bucket = F.pmod(F.xxhash64(F.lit(level), "rank"), chunks.cast("long"))
        flown = rows.groupBy("source", bucket.alias("bucket")).applyInArrow(_fly(last, level, seed), schema)
        if last:
            closed.append(flown)
            break
        flown = durable(flown)
        still = (F.col("prob") > 0) & (F.col("prob") < 1)
        closed.append(flown.filter(~still))
        rows, level = flown.filter(still), level + 1
    out = closed[0]
    for more in closed[1:]:
        out = out.unionAll(more)
    copies = (F.col("base") + F.round("prob").cast("long")).alias("copies")
    return out.select(*units, "source_size", "target", copies)


BLOCK = 4096


def _numbered(rows: DataFrame, out: str = "nth") -> DataFrame:
    """The rows with a number that tells equal ones apart, from their counts; arrays stay short however many there are."""
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("__n"))
    blocks = counted.withColumn("__b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / BLOCK))))
    last = F.least(F.col("__n") - 1, (F.col("__b") + 1) * BLOCK - 1)
    return blocks.select(*rows.columns, F.explode(F.sequence(F.col("__b") * BLOCK, last)).alias(out))


def _few(facts: DataFrame, bound: int = 10_000) -> bool:
    """Whether the table of sources has a proven small size, so that it may be broadcast."""
    return facts.limit(bound + 1).count() <= bound


def text_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def sized_rows(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    t = F.col(f"`{text}`")
    return durable(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), size_of(t).alias("size"), text_hash(t).alias("th")))


def sample(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", seed: int = SEED, **limits) -> DataFrame:
    sized = sized_rows(docs, text, doc_id, source)
    return take(sized, durable(plan(sized, **limits)), seed)


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", seed: int = SEED, **limits) -> DataFrame:
    """The input's rows, each as many times as the mix takes it.

    Rows of one id, source and text are interchangeable here. Where they are not all taken equally often, whole rows
    that are equal are counted, and each kind gets its part in the order of a hash of the row: only hashes and counts
    of the kinds of one document meet, no texts.
    """
    taken = sample(docs, text, doc_id, source, seed, **limits)
    unit = ["doc_id", "source", "size", "th"]
    per = taken.groupBy(*unit).agg(F.count("*").alias("m"), F.sum("copies").alias("c"), F.min("copies").alias("lo"), F.max("copies").alias("hi"))
    per = durable(per.filter("hi > 0"))
    whole = F.col(f"`{text}`")
    keyed = packed(docs, i=F.col(f"`{doc_id}`"), s=F.col(f"`{source}`"), z=size_of(whole), t=text_hash(whole))
    on = F.col("i").eqNullSafe(F.col("doc_id")) & F.col("s").eqNullSafe(F.col("source")) & (F.col("z") == F.col("size")) & (F.col("t") == F.col("th"))
    even = keyed.join(per.filter("lo = hi"), on)
    out = even.select("row", F.explode(F.array_repeat(F.lit(1), F.col("lo").cast("int"))))
    uneven = per.filter("lo < hi")
    if not uneven.isEmpty():
        out = out.unionAll(_shared_out(keyed.join(uneven, on), unit))
    return unpacked(out, docs.columns)


def _shared_out(rows: DataFrame, unit: list[str]) -> DataFrame:
    """Rows of units whose copies differ: ``c`` rows of each unit of ``m``, none more than ``hi`` times, none less than ``lo``."""
    told = F.to_json("row")
    kinds = rows.groupBy(*unit, "m", "c", "lo", F.xxhash64(told).alias("h1"), F.xxhash64(F.lit(1), told).alias("h2"))
    kinds = durable(kinds.agg(F.count("*").alias("n"), F.first("row").alias("row")))
    before = F.coalesce(F.sum("n").over(W.partitionBy(*unit).orderBy("h1", "h2").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    extra = F.greatest(F.lit(0), F.least("n", F.col("c") - F.col("lo") * F.col("m") - before))
    more = kinds.select(*(F.col(x).alias(f"own_{x}") for x in [*unit, "h1", "h2"]), extra.alias("more"))
    same = [F.col(x).eqNullSafe(F.col(f"own_{x}")) for x in [*unit, "h1", "h2"]]
    dealt = kinds.join(more, reduce(and_, same)).select("h1", "row", (F.col("lo") * F.col("n") + F.col("more")).alias("k")).filter("k > 0")
    blocks = dealt.select("h1", "row", "k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("k") - 1) / BLOCK))).alias("b"))
    blocks = blocks.repartition(F.xxhash64("h1", "b"))
    here = F.least(F.col("k") - F.col("b") * BLOCK, F.lit(BLOCK))
    return blocks.select("row", F.explode(F.array_repeat(F.lit(1), here.cast("int"))))


def digest(docs: DataFrame) -> DataFrame:
    taken = sample(docs.select("doc_id", "source", "text"))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
