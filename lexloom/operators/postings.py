"""BM25 top-k over postings in blocks: what cannot reach a query's k-th score is neither exploded nor shuffled.

A token's postings stand in *blocks*: rows of at most about ``BLOCK`` postings, dealt by impact level (how much a
posting can add) and, within frequent tokens, by a hash of the document. A block's header (greatest tf, least length) bounds
what any of its postings adds, whatever the corpus statistics are at the time of a query.

A search takes the tokens of a query in MaxScore order, greatest bound first, in three passes:

1. *Seeds.* The blocks of greatest bounds, until they hold a few times k postings; their documents are scored wholly, and
   the k-th best is the query's threshold.
2. *Candidates.* A document is met first in the block of its first token in that order, so a block matters only if
   its bound and those of all later tokens reach the threshold together. Of the documents in these blocks those stay
   whose partial score reaches it with what their other tokens' unread blocks can add.
3. *Completion.* The candidates' other tokens are looked up in the blocks of their hash, and exact scores ranked.

Where queries are many, most postings are wanted by some query, and pairs of query and posting are what costs: then
:func:`chunk_scores` deals documents into chunks, each meets all queries in one group and sends on the first k a query.

Scores are those of a full evaluation. A query of which some token weighs less than 0 (the mean idf is below 0) has no
upper bounds; it is scored over all its postings, and documents without any of its tokens, which score 0, come from the
gaps between those that have some.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexloom.functions import fixed
from lexloom.session import stored

#: Postings of a block; seeds of a search, in multiples of k; tables of so many rows at most are broadcast.
BLOCK, SEEDS, FEW = 256, 20, 100_000
LEVELS = 6
#: Documents of a chunk at most, and least where there are cores for more chunks; queries that meet a chunk at once.
CHUNK, SMALL_CHUNK, AT_ONCE = 32_768, 512, 100_000
#: Scores are rounded to nine digits, bounds are compared with more room than that.
ROOM = 1e-6


def impact(tf: Column, dl: Column, avgdl: float, k1: float = fixed.BM25_K1, b: float = fixed.BM25_B) -> Column:
    """What one posting adds, for a weight of 1; it grows with tf and falls with the length."""
    return (tf * (k1 + 1)) / (tf + k1 * (F.lit(1 - b) + F.lit(b) * dl / F.lit(avgdl)))


def checked(df: DataFrame, most: int = FEW) -> DataFrame:
    """A broadcast of a table that has at most so many rows, else the table."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def blocks(postings: DataFrame, terms: DataFrame, avgdl: float, block: int = BLOCK) -> DataFrame:
    """``token, part, parts, level, n, most_tf, least_dl, docs`` of ``postings(token, doc_id, tf, dl)``.

    ``docs`` holds structs (doc_id, tf, dl). Only tokens of more than ``block`` documents are dealt over several parts,
    a power of two, and levels; these tokens are few and reach the postings by a checked broadcast.
    """
    many = F.pow(F.lit(2), F.ceil(F.log2(F.col("df") / block))).cast("long")
    frequent = terms.filter(F.col("df") > block).select("token", many.alias("parts"))
    told = postings.join(checked(frequent), "token", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    share = impact(F.col("tf"), F.col("dl"), avgdl) / (fixed.BM25_K1 + 1)
    level = F.when(F.col("parts") == 1, 0).otherwise(F.least(F.lit(LEVELS - 1), F.floor(share * LEVELS))).cast("int")
    dealt = told.withColumn("part", part("doc_id", F.col("parts"))).withColumn("level", level)
    return dealt.groupBy("token", "part", "parts", "level").agg(
        F.count("*").alias("n"), F.max("tf").alias("most_tf"), F.min("dl").alias("least_dl"), F.collect_list(F.struct("doc_id", "tf", "dl")).alias("docs")
    )


def part(doc_id: str, parts: Column) -> Column:
    return F.pmod(F.xxhash64(doc_id), parts)


def first_by_score(scored: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id").asc()))
    return scored.withColumn("rank", place).filter(F.col("rank") <= k)


class Search:
    """One search of ``asked(query_id, token, w)``, no w below 0, over blocks ``held`` that are read again by each pass.

    Blocks may come from several segments (column ``seg``), each document from one; ``dead(seg, doc_id)`` names
    documents that count no more. ``rows_an_id`` is the most rows that share an id, whose postings all count.
    """

    def __init__(self, asked: DataFrame, held: DataFrame, avgdl: float, k: int, decimals: int = 9, seeds: int = SEEDS, k1: float = fixed.BM25_K1, b: float = fixed.BM25_B, rows_an_id: int = 1, dead: DataFrame | None = None):
        self.held = held if "seg" in held.columns else held.withColumn("seg", F.lit(""))
        self.k, self.decimals, self.seeds, self.dead, self.rows_an_id = k, decimals, seeds, dead, rows_an_id
        self.adds = lambda tf, dl: impact(tf, dl, avgdl or 1.0, k1, b)
        most = self.adds(F.col("most_tf"), F.col("least_dl")) * rows_an_id
        headers = self.held.join(checked(asked.select("token").distinct()), "token", "left_semi")
        self.headers = stored(headers.select("seg", "token", "part", "parts", "level", "n", most.alias("most")))
        # Per query the tokens in MaxScore order, with the bounds of all later ones.
        tokens = self.headers.groupBy("token").agg(F.max("most").alias("most"))
        order = W.partitionBy("query_id").orderBy(F.col("u").desc(), "token")
        told = asked.filter("w > 0").join(tokens, "token").select("query_id", "token", "w", (F.col("w") * F.col("most")).alias("u"))
        later = F.coalesce(F.sum("u").over(order.rowsBetween(1, W.unboundedFollowing)), F.lit(0.0))
        self.told = stored(told.withColumn("later", later))
        self.parts = self.headers.select("seg", "token", "parts").distinct()
        self.limits: DataFrame | None = None

    def _alive(self, docs: DataFrame) -> DataFrame:
        return docs if self.dead is None else docs.join(checked(self.dead), ["seg", "doc_id"], "left_anti")

    def reach(self) -> DataFrame:
        """Pairs of query and block with what the block can add and what later tokens can."""
        told = self.told.select("query_id", "token", "w", "later")
        return told.join(self.headers, "token").select("query_id", "seg", "token", "part", "level", "n", (F.col("w") * F.col("most")).alias("adds"), "later")

    def passing(self) -> DataFrame:
        return self.reach().join(checked(self.limits), "query_id").filter(self._passes())

    def _passes(self) -> Column:
        return F.col("whole") | (F.col("adds") + F.col("later") >= F.col("limit"))

    def _worth(self, limits: DataFrame) -> DataFrame:
        """Adds ``whole``: the query's blocks are all read, as looking up the tokens that are not would cost more than that."""
        passes = F.col("adds") + F.col("later") >= F.col("limit")
        per = self.reach().join(checked(limits), "query_id").groupBy("query_id", "token").agg(F.sum("n").alias("n"), F.sum(F.when(passes, F.col("n")).otherwise(0)).alias("read"))
        told = per.groupBy("query_id").agg(F.sum("n").alias("n"), F.sum("read").alias("read"), F.count_if(F.col("read") < F.col("n")).alias("open"))
        return limits.join(told, "query_id", "left").select("query_id", "limit", F.coalesce(F.col("read") * (F.col("open") + 1) > 2 * F.col("n"), F.lit(False)).alias("whole"))

    def complete(self, found: DataFrame) -> DataFrame:
        """``query_id, doc_id, score`` of given ``(query_id, seg, doc_id)``, from the blocks of their tokens and hashes."""
        wanted = found.join(self.told.select("query_id", "token", "w"), "query_id").join(checked(self.parts), ["seg", "token"])
        wanted = wanted.withColumn("part", part("doc_id", F.col("parts"))).select("query_id", "seg", "doc_id", "token", "part", "w")
        wanted = stored(wanted)
        near = self.held.join(checked(wanted.select("seg", "token", "part").distinct()), ["seg", "token", "part"], "left_semi")
        looked = near.select("seg", "token", F.explode("docs").alias("d")).select("seg", "token", "d.*")
        parts = wanted.join(looked, ["seg", "token", "doc_id"])
        return parts.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("w") * self.adds(F.col("tf"), F.col("dl"))), self.decimals).alias("score"))

    def _seeds(self) -> DataFrame:
        """Documents of the blocks that can add most, a few times k of them a query."""
        first = W.partitionBy("query_id").orderBy(F.col("adds").desc(), "seg", "token", "part", "level")
        before = F.coalesce(F.sum("n").over(first.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        picked = self.reach().withColumn("before", before).filter(F.col("before") < self.seeds * self.k)
        keys = ["seg", "token", "part", "level"]
        met = checked(picked.select("query_id", *keys)).join(self.held.select(*keys, "docs"), keys)
        return self._alive(met.select("query_id", "seg", F.explode("docs.doc_id").alias("doc_id")).distinct())

    def scores(self) -> DataFrame:
        """``query_id, doc_id, score``: all that can be among the first k by score and id, and are above 0."""
        best = first_by_score(self.complete(self._seeds()), self.k).groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
        least = self.told.select("query_id").distinct().join(best.filter(F.col("n") == self.k), "query_id", "left")
        self.limits = stored(self._worth(least.select("query_id", (F.coalesce("least", F.lit(0.0)) - ROOM).alias("limit"))))
        # What a token can add where none of its passing blocks held the document: nothing if all its blocks passed.
        unread = self.reach().join(checked(self.limits), "query_id").filter(~self._passes())
        unread = unread.groupBy("query_id", "token").agg(F.max("adds").alias("v"))
        weights = stored(self.told.select("query_id", "token", "w").join(unread, ["query_id", "token"], "left").select("query_id", "token", "w", F.coalesce("v", F.lit(0.0)).alias("v")))
        keys = ["seg", "token", "part", "level"]
        met = checked(self.passing().select("query_id", *keys)).join(self.held.select(*keys, "docs"), keys)
        met = met.join(checked(weights), ["query_id", "token"]).select("query_id", "seg", "w", "v", F.explode("docs").alias("d"))
        each = met.select("query_id", "seg", "d.doc_id", (F.col("w") * self.adds(F.col("d.tf"), F.col("d.dl"))).alias("adds"), "v")
        per = each.groupBy("query_id", "seg", "doc_id").agg(F.sum("adds").alias("adds"), F.sum("v").alias("v"))
        # Rows that share an id may hold a token again, so theirs keep all bounds.
        bounds = weights.groupBy("query_id").agg((F.sum("v") * self.rows_an_id).alias("most")).join(self.limits, "query_id")
        held = F.col("v") if self.rows_an_id == 1 else F.lit(0.0)
        found = per.join(checked(bounds), "query_id").filter(F.col("adds") + F.col("most") - held + ROOM >= F.col("limit"))
        return self.complete(self._alive(found.select("query_id", "seg", "doc_id")))

    def read(self) -> DataFrame:
        """After :meth:`scores`, one row: pairs of query and block, those read for candidates, and their postings."""
        read = self.passing().agg(F.count("*").alias("blocks_read"), F.coalesce(F.sum("n"), F.lit(0)).alias("postings_read"))
        return self.reach().agg(F.count("*").alias("blocks"), F.coalesce(F.sum("n"), F.lit(0)).alias("postings")).crossJoin(read)


def least(found: tuple[np.ndarray, ...], k: int, margin: float) -> tuple[np.ndarray, ...]:
    """Of (query, distance, id) what can be among the first k by rounded distance and id, in order."""
    q, d, ids = found
    order = np.lexsort((ids, d, q))
    q, d, ids = q[order], d[order], ids[order]
    place = np.arange(len(q))
    start = np.maximum.accumulate(np.where(np.r_[True, q[1:] != q[:-1]], place, 0))
    last = np.minimum(start + k - 1, len(q) - 1)
    bound = np.where(q[last] == q, d[last] + margin, np.inf)
    run = np.maximum.accumulate(np.where(np.r_[True, (q[1:] != q[:-1]) | (d[1:] != d[:-1])], place, 0))
    keep = (d <= bound) & (place - run < k)
    return q[keep], d[keep], ids[keep]


#: A token that more than one in so many documents of a chunk hold is added as a whole vector; documents in so many groups bound the k-th score.
DENSE, GROUPS = 8, 64
#: Documents found that are cut to the first k of their queries at a time.
FOUND_AT_ONCE = 1_000_000


def _flat(postings: pa.Table) -> tuple[np.ndarray, ...]:
    """``t, doc_id, tf, dl`` of rows of one posting each, or of one document with lists of its postings."""
    t, tf, doc, dl = (postings[c].combine_chunks() for c in ("t", "tf", "doc_id", "dl"))
    if pa.types.is_list(t.type):
        each = np.diff(t.offsets.to_numpy())
        return t.flatten().to_numpy(), np.repeat(doc.to_numpy(), each), tf.flatten().to_numpy(), np.repeat(dl.to_numpy(), each)
    return tuple(x.to_numpy() for x in (t, doc, tf, dl))


def _summed(values: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """Keys in order and the sums of the values of equal ones."""
    new = np.r_[True, np.logical_or.reduce([x[1:] != x[:-1] for x in keys])][: len(values)]
    return (values, *keys) if new.all() else (np.add.reduceat(values, np.flatnonzero(new)), *(x[new] for x in keys))


def _best_of_chunk(k: int, margin: float, avgdl: float, k1: float, b: float):
    """A chunk's postings ``t, doc_id, tf, dl`` and queries ``query_id, own, w`` to what can be among a query's first k."""

    def run(postings: pa.Table, asked: pa.Table) -> pa.Table:
        t, doc, tf, dl = _flat(postings)
        ids, at = np.unique(doc, return_inverse=True)
        order = np.lexsort((dl, at, t))
        tf, t, at, dl = _summed(*(x[order] for x in (tf, t, at, dl)))
        adds, t, at = _summed((tf * (k1 + 1)) / (tf + k1 * ((1 - b) + b * dl / avgdl)), t, at)  # rows that share an id
        names = asked["query_id"].combine_chunks().dictionary_encode()
        query, own, w = names.indices.to_numpy(), asked["own"].to_numpy(), asked["w"].to_numpy()
        order = np.lexsort((own, query))
        query, own, w = query[order], own[order], w[order]
        begin, end = np.searchsorted(t, own), np.searchsorted(t, own, "right")
        done = found = [(np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))]
        score, held = np.zeros(-(-len(ids) // GROUPS) * GROUPS), 0
        whole: dict[int, np.ndarray] = {}
        first = np.r_[np.flatnonzero(np.r_[True, query[1:] != query[:-1]][: len(query)]), len(query)]
        for a, z in zip(first[:-1], first[1:], strict=True):
            score[:] = 0.0
            for j in range(a, z):
                if (end[j] - begin[j]) * DENSE > len(ids):
                    if own[j] not in whole:
                        whole[own[j]] = np.zeros(len(score))
                        whole[own[j]][at[begin[j] : end[j]]] = adds[begin[j] : end[j]]
                    score += w[j] * whole[own[j]]
                else:
                    score[at[begin[j] : end[j]]] += w[j] * adds[begin[j] : end[j]]
            # The k-th of the groups' best is at most the k-th of all.
            best = score.reshape(GROUPS, -1).max(axis=0)
            bound = np.partition(best, len(best) - k)[len(best) - k] - margin if len(best) > k else 0.0
            hit = np.flatnonzero(score >= bound) if bound > 0 else np.flatnonzero(score > 0)
            found.append((np.full(len(hit), query[a]), -score[hit], ids[hit]))
            held += len(hit)
            if held > FOUND_AT_ONCE:
                done.append(least(tuple(np.concatenate(x) for x in zip(*found, strict=True)), k, margin))
                found, held = [], 0
        if found is not done:
            done += found
        q, d, doc = least(tuple(np.concatenate(x) for x in zip(*done, strict=True)), k, margin)
        return pa.Table.from_arrays([names.dictionary.take(pa.array(q, pa.int64())), pa.array(doc), pa.array(-d)], ["query_id", "doc_id", "score"])

    return run


def chunk_scores(asked: DataFrame, postings: DataFrame, names: DataFrame, n: int, avgdl: float, k: int, decimals: int = 9, k1: float = fixed.BM25_K1, b: float = fixed.BM25_B) -> DataFrame:
    """``query_id, doc_id, score``: all that can be among the first k by score and id, and are above 0, for many queries.

    ``asked(query_id, token, w)``, no w below 0; ``names(token, t)``; ``postings(t, tf, doc_id, dl)`` of ``n`` documents with
    whole numbers as ids, a row a posting or, with lists, a row a document. Chunks grow in number with the documents, not in
    size; a query sends at most k and its near ties from each.
    """
    cores = asked.sparkSession.sparkContext.defaultParallelism
    chunks = max(1, math.ceil(n / CHUNK), min(4 * cores, math.ceil(n / SMALL_CHUNK)))
    asked = stored(asked.filter("w > 0"))
    parts = max(1, math.ceil(asked.select("query_id").distinct().count() / AT_ONCE))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    own = postings.filter("doc_id IS NOT NULL").select("t", "tf", F.col("doc_id").cast("long").alias("doc_id"), "dl")
    left = own.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int")).withColumn("part", every(parts))
    right = asked.join(checked(names), "token").select("query_id", F.col("t").alias("own"), "w").withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")).withColumn("chunk", every(chunks))
    # As many partitions as chunks: few bytes hold much work, so that small ones are not joined into one task.
    left, right = (df.repartition(chunks * parts, "chunk", "part") for df in (left, right))
    kind = asked.schema["query_id"].dataType.simpleString()
    best = _best_of_chunk(k, 2 * 10.0**-decimals, avgdl or 1.0, k1, b)
    found = left.groupBy("chunk", "part").cogroup(right.groupBy("chunk", "part")).applyInArrow(best, f"query_id {kind}, doc_id long, score double")
    return found.select("query_id", F.col("doc_id").cast(postings.schema["doc_id"].dataType).alias("doc_id"), F.round("score", decimals).alias("score"))


def all_scores(asked: DataFrame, held: DataFrame, avgdl: float, decimals: int = 9, k1: float = fixed.BM25_K1, b: float = fixed.BM25_B, dead: DataFrame | None = None) -> DataFrame:
    """``query_id, doc_id, score`` over all postings, for weights of any sign."""
    held = held if "seg" in held.columns else held.withColumn("seg", F.lit(""))
    each = held.join(asked, "token").select("query_id", "seg", "w", F.explode("docs").alias("d")).select("query_id", "seg", "w", "d.*")
    if dead is not None:
        each = each.join(checked(dead), ["seg", "doc_id"], "left_anti")
    return each.groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("w") * impact(F.col("tf"), F.col("dl"), avgdl or 1.0, k1, b)), decimals).alias("score"))


def numbered(ids: DataFrame) -> DataFrame:
    """``doc_id, nth``: distinct ids in order, numbered from 0 without a task that sees all."""
    ordered = stored(ids.distinct().repartitionByRange("doc_id").sortWithinPartitions("doc_id").select("doc_id", F.monotonically_increasing_id().alias("__m")))
    at = F.shiftright("__m", 33)
    sizes = ordered.groupBy(at.alias("__p")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return ordered.withColumn("__p", at).join(F.broadcast(sizes.select("__p", before.alias("before"))), "__p").select("doc_id", (F.col("before") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))).alias("nth"))


def without(queries: DataFrame, scored: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """``query_id, doc_id``: per query its k smallest ids that have no score, from the gaps between those that have."""
    order = numbered(ids)
    total = order.count()
    at = scored.join(order, "doc_id").select("query_id", "nth").unionByName(queries.select("query_id", F.lit(total).cast("long").alias("nth")))
    place = W.partitionBy("query_id").orderBy("nth")
    gaps = at.withColumn("i", F.row_number().over(place) - 1).withColumn("last", F.coalesce(F.lag("nth").over(place), F.lit(-1)))
    # Before a hit with i hits below it there are nth - i free numbers; a gap is of use while fewer than k came before.
    gaps = gaps.filter((F.col("nth") > F.col("last") + 1) & (F.col("last") + 1 - F.col("i") < k))
    free = gaps.select("query_id", F.explode(F.sequence(F.col("last") + 1, F.least(F.col("nth") - 1, F.col("last") + k))).alias("nth"))
    return free.join(order, "nth").select("query_id", "doc_id")
