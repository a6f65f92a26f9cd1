"""Hybrid retrieval for many queries at once: BM25, exact nearest vectors, weighted rank fusion, reranking."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexloom.functions import fixed
from lexloom.operators.index import Bm25Index, tokens
from lexloom.operators.postings import CHUNK, Search, all_scores, checked, chunk_scores, least, numbered, without
from lexloom.session import stored


#: Queries up to which blocks of postings are read by bounds.
FEW_QUERIES = 64


def top(df: DataFrame, order: list[Column], k: int, by: list[str], rank: str = "rank") -> DataFrame:
    """The first k rows of each group with their rank; partial limits run before the shuffle."""
    place = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    return df.withColumn(rank, place).filter(F.col(rank) <= k)


def bm25_topk(queries: DataFrame, index: Bm25Index, k: int, decimals: int = 9, negative: bool = False, **weights) -> DataFrame:
    """``query_id, doc_id, score, rank``; documents without a common token have score 0 and are eligible.

    Ties go by doc_id. More than ``FEW_QUERIES`` queries meet the documents chunk by chunk. Fewer, of weights from 0 on, read blocks of postings as far as these can matter (see
    :mod:`lexloom.operators.postings`); of the many documents at 0 only the 2k smallest distinct ids need to compete, as at
    least k of these are at 0 where fewer than k score above it. Queries with a token of negative idf (the mean is
    below 0), or all of them with ``negative``, are scored over all postings, and the k smallest ids without a score compete.
    """
    queries = queries.select("query_id", "question")
    asked = stored(queries.select("query_id", F.explode(tokens(F.col("question"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times")))
    many = asked.select("query_id").distinct().limit(FEW_QUERIES + 1).count() > FEW_QUERIES and index.ids().schema["doc_id"].dataType.typeName() in ("long", "integer")
    if not many and isinstance(index, Bm25Index):  # segments are stored, and read by token
        index = index.about(asked)
    read = index.read_for(asked) if many and isinstance(index, Bm25Index) else None
    if read is not None:
        near, names, weighed, n, avgdl = read
        dead = None
        # Asked for where weights are below 0 only.
        kept = lambda: index.found(asked)[0].select("token", F.array(F.struct("doc_id", "tf", "dl")).alias("docs"))
    else:
        row = index.stats.first()
        n, avgdl = (row["n"], float(row["avgdl"] or 0.0)) if row is not None else (0, 0.0)
        if many:
            near, weighed = index.found(asked)
            held, dead = near.select("token", F.array(F.struct("doc_id", "tf", "dl")).alias("docs")), None
            names = stored(numbered(asked.select(F.col("token").alias("doc_id"))).select(F.col("doc_id").alias("token"), F.col("nth").alias("t")))
            near = near.join(checked(names), "token")
        else:
            (held, weighed), dead = index.blocks(asked, avgdl), index.dead
        kept = lambda: held
    below = weighed.select("query_id").distinct() if negative else weighed.filter("w < 0").select("query_id").distinct()
    free = queries.select("query_id")
    scored = []
    if negative or not below.isEmpty():
        free = free.join(below, "query_id", "left_anti") if not negative else free.limit(0)
        others = queries.select("query_id") if negative else below
        full = stored(all_scores(weighed.join(below, "query_id", "left_semi"), kept(), avgdl, decimals, dead=dead, **weights))
        scored += [full, without(others, full, index.ids(), k).withColumn("score", F.lit(0.0))]
        weighed = weighed.join(below, "query_id", "left_anti")
    if not negative and many:
        scored.append(chunk_scores(weighed, near, names, n, avgdl, k, decimals, **weights))
    elif not negative:
        scored.append(Search(weighed, held, avgdl, k, decimals, rows_an_id=index.rows_an_id(), dead=dead, **weights).scores())
    if not negative:
        scored.append(free.crossJoin(F.broadcast(index.ids().distinct().orderBy("doc_id").limit(2 * k))).withColumn("score", F.lit(0.0)))
    kind = queries.schema["query_id"].dataType
    both = reduce(DataFrame.unionByName, (s.select(F.col("query_id").cast(kind), "doc_id", "score") for s in scored))
    best = both.groupBy("query_id", "doc_id").agg(F.max_by("score", F.abs("score")).alias("score"))  # a real score before the 0 of a filler
    return top(best, [F.col("score").desc(), F.col("doc_id").asc()], k, ["query_id"])


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def _nearest(asked: np.ndarray, k: int, margin: float):
    """Batches of ``doc_id, embedding`` to query number, id and exact distance of what can be among the first k.

    A matrix product finds what comes near enough; distances are then summed in the order of the native expression.
    """
    norms = (asked * asked).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = (np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))
        step = max(1, 2_000_000 // len(asked))
        for batch in batches:
            rows = [(i, x) for i, x in zip(batch.column("doc_id").to_pylist(), batch.column("embedding").to_numpy(zero_copy_only=False), strict=True) if x is not None]
            for at in range(0, len(rows), step):
                ids = np.array([i for i, _ in rows[at : at + step]], np.int64)
                block = np.stack([x for _, x in rows[at : at + step]]).astype(np.float64)
                own = (block * block).sum(axis=1)
                near = norms[:, None] + own - 2 * (asked @ block.T)
                bound = np.partition(near, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
                slack = margin + 1e-10 * (norms + own.max())
                q, v = np.nonzero(near <= (bound + slack)[:, None])
                d = np.zeros(len(q))
                for x in range(asked.shape[1]):
                    apart = block[v, x] - asked[q, x]
                    d += apart * apart
                best = least(tuple(np.concatenate(x) for x in zip(best, (q, d, ids[v]), strict=True)), k, margin)
        yield pa.RecordBatch.from_arrays([pa.array(best[0]), pa.array(best[2]), pa.array(best[1])], ["number", "doc_id", "score"])

    return run


def knn_topk(queries: DataFrame, vectors: DataFrame, k: int, decimals: int = 9, most_queries: int = 10_000) -> DataFrame:
    """``query_id, doc_id, score`` (squared distance) and ``rank``, exact; ties by doc_id.

    A stated set of queries meets all vectors. Up to ``most_queries``, checked first, go to every task, which returns
    only what can be among the first k; larger sets are dealt out in blocks that each meet all vectors, chunk by chunk. Rows and
    queries without a vector have no neighbours. All vectors have one length.
    """
    queries, vectors = (df.filter(F.col("embedding").isNotNull()) for df in (queries, vectors))
    count = queries.count()
    small = queries.select("query_id", F.col("embedding").alias("q"))
    if 0 < count <= most_queries and vectors.schema["doc_id"].dataType.typeName() in ("long", "integer"):
        asked = small.collect()
        run = _nearest(np.array([r["q"] for r in asked], np.float64), k, 2 * 10.0**-decimals)
        found = vectors.select(F.col("doc_id").cast("long").alias("doc_id"), "embedding").mapInArrow(run, "number long, doc_id long, score double")
        named = queries.sparkSession.createDataFrame([(n, r["query_id"]) for n, r in enumerate(asked)], f"number long, query_id {queries.schema['query_id'].dataType.simpleString()}")
        kind = vectors.schema["doc_id"].dataType
        near = found.join(F.broadcast(named), "number").select("query_id", F.col("doc_id").cast(kind).alias("doc_id"), F.round("score", decimals).alias("score"))
        return top(near, [F.col("score").asc(), F.col("doc_id").asc()], k, ["query_id"])
    blocks = max(1, -(-count // most_queries))
    if count and vectors.schema["doc_id"].dataType.typeName() in ("long", "integer"):
        return top(_by_blocks(small, vectors, k, decimals, blocks), [F.col("score").asc(), F.col("doc_id").asc()], k, ["query_id"])
    small = small.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    dealt = vectors.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    pairs = dealt.join(small, "block")
    near = pairs.select("query_id", "doc_id", F.round(squared_l2(F.col("embedding"), F.col("q")), decimals).alias("score"))
    return top(near, [F.col("score").asc(), F.col("doc_id").asc()], k, ["query_id"])


def _by_blocks(queries: DataFrame, vectors: DataFrame, k: int, decimals: int, blocks: int) -> DataFrame:
    """``query_id, doc_id, score`` of what can be among the first k: each chunk of vectors meets each block of ``queries(query_id, q)`` in one group."""
    session = vectors.sparkSession
    chunks = max(session.sparkContext.defaultParallelism, -(-vectors.count() // CHUNK))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = vectors.select(F.col("doc_id").cast("long").alias("doc_id"), "embedding", F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int").alias("chunk")).withColumn("block", every(blocks))
    right = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("chunk", every(chunks))
    left, right = (df.repartition(chunks * blocks, "chunk", "block") for df in (left, right))
    margin = 2 * 10.0**-decimals

    def run(near: pa.Table, asked: pa.Table) -> pa.Table:
        number, ids, score = (pa.array([], kind) for kind in (pa.int64(), pa.int64(), pa.float64()))
        if near.num_rows and asked.num_rows:
            matrix = np.stack(asked["q"].combine_chunks().to_numpy(zero_copy_only=False)).astype(np.float64)
            [found] = _nearest(matrix, k, margin)(iter(near.select(["doc_id", "embedding"]).combine_chunks().to_batches()))
            number, ids, score = found.columns
        return pa.Table.from_arrays([asked["query_id"].combine_chunks().take(number), ids, score], ["query_id", "doc_id", "score"])

    kind, ids = (df.schema[c].dataType for df, c in ((queries, "query_id"), (vectors, "doc_id")))
    found = left.groupBy("chunk", "block").cogroup(right.groupBy("chunk", "block")).applyInArrow(run, f"query_id {kind.simpleString()}, doc_id long, score double")
    return found.select("query_id", F.col("doc_id").cast(ids).alias("doc_id"), F.round("score", decimals).alias("score"))


def fuse(lists: list[tuple[str, DataFrame, float]], c: int = fixed.RRF_C, decimals: int = 12) -> DataFrame:
    """Weighted reciprocal ranks of named ranked lists: ``query_id, doc_id, score, rank``.

    Equal scores keep the order of first sight: the earlier list, then the better rank in it.
    """
    out = None
    for order, (_, ranked, weight) in enumerate(lists):
        part = ranked.select("query_id", "doc_id", F.lit(order).alias("list"), "rank", (F.lit(weight) / (F.col("rank") + c)).alias("part"))
        out = part if out is None else out.unionByName(part)
    per = out.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), decimals).alias("score"), F.min(F.struct("list", "rank")).alias("seen"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("seen"), F.col("doc_id")))
    return per.withColumn("rank", place).select("query_id", "doc_id", "score", "rank")


def hybrid(queries: DataFrame, index: Bm25Index, vectors: DataFrame, k: int, bm25_weight: float = fixed.BM25_WEIGHT, vector_weight: float = fixed.VECTOR_WEIGHT, c: int = fixed.RRF_C) -> DataFrame:
    """The fused union of both lists, up to 2k documents a query."""
    return fuse([("bm25", bm25_topk(queries, index, k), bm25_weight), ("vector", knn_topk(queries, vectors, k), vector_weight)], c)


def rerank_score(reply: Column) -> Column:
    """The first number of a reply, between 0 and 10; 0 without one."""
    number = F.nullif(F.regexp_extract(reply, r"(\d+(\.\d+)?)", 1), F.lit("")).cast("double")
    return F.coalesce(F.least(F.lit(fixed.RERANK_MOST), F.greatest(F.lit(fixed.RERANK_LEAST), number)), F.lit(0.0))


def rerank_prompt(question: Column, content: Column) -> Column:
    """Question and at most 1,500 characters of content."""
    return F.concat(F.lit("Pregunta:\n"), question, F.lit("\n\nFragmento:\n"), F.left(content, F.lit(fixed.RERANK_CHARS)), F.lit("\n\nResponde solo con un número entre 0 y 10."))


def rerank(replied: DataFrame, k: int) -> DataFrame:
    """``query_id, doc_id, rank, reply`` in; the best k by score, equal ones in their old order."""
    scored = replied.withColumn("score", rerank_score(F.col("reply"))).withColumnRenamed("rank", "old_rank")
    return top(scored, [F.col("score").desc(), F.col("old_rank").asc()], k, ["query_id"])
