"""A vector index in cells: every row in the cell of its nearest centroid, searches that probe cells by distance bounds.

Centroids are fitted on a bounded sample (``SAMPLE`` rows a centroid, those with the least hashes of id); every row is
indexed and its table is partitioned by cell. A cell's header holds its centroid and the greatest and least distance of
its rows from it. By the triangle inequality no row of a cell is nearer to a query than the distance to the centroid less
the greatest, or the least less that distance.

* Approximate: a query visits the ``probes`` cells of the nearest centroids.
* Exact: the nearest cell first gives the k-th distance so far; then every cell whose bound is not above it is visited.

Queries meet the rows of a cell in Arrow batches: one matrix product a batch, the first k of a query and task go on, so
no pair of query and row leaves a task otherwise. Queries and headers come from tables, not from the driver; only the
centroids, whose number is a parameter, are held there.

Defined results: rows and queries without a vector, with a null in it or of another length than most of the sample are
left out; ties go by id; an empty index gives no rows; repeated rows count once each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type

from lexloom.operators.retrieve import top
from lexloom.session import stored

CELLS, SAMPLE, ROUNDS, PROBES = 16, 256, 8, 12
#: Rows of a cell that one task compares with the queries of that cell; queries of a cell in one go.
ROWS, AT_ONCE = 50_000, 1024
#: Bounds are widened by more than the rounding of distances.
ROOM = 1e-6


def fit(vectors: DataFrame, cells: int = CELLS, sample: int = SAMPLE, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids of ``vectors(doc_id, embedding)`` by Lloyd's rounds over at most ``cells * sample`` rows."""
    rows = vectors.filter(F.forall("embedding", lambda x: x.isNotNull())).select("embedding", F.xxhash64(F.lit(5), "doc_id").alias("h"))
    picked = rows.orderBy("h", "embedding").limit(cells * sample).collect()
    if not picked:
        return np.empty((0, 0))
    lengths = Counter(len(r["embedding"]) for r in picked)
    width = max(lengths, key=lambda n: (lengths[n], n))
    points = np.array([r["embedding"] for r in picked if len(r["embedding"]) == width], np.float64)
    centroids = np.unique(points, axis=0)
    centroids = centroids[np.random.default_rng(1).permutation(len(centroids))[:cells]]
    for _ in range(rounds):
        near = _squared(points, centroids).argmin(axis=1)
        for c in np.unique(near):
            centroids[c] = points[near == c].mean(axis=0)
    return centroids


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([c.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(c), -1) for c in column.chunks if len(c)])


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T), 0)


def assign(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``doc_id, embedding, cell, away``: nearest centroid and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            points = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
            cell = _squared(points, centroids).argmin(axis=1)
            apart = points - centroids[cell]
            away = np.sqrt((apart * apart).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("embedding"), pa.array(cell, pa.int32()), pa.array(away)], ["doc_id", "embedding", "cell", "away"])

    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema}
    rows = vectors.select("doc_id", "embedding").filter(F.size("embedding") == (centroids.shape[1] or -1)).filter(F.forall("embedding", lambda x: x.isNotNull()))
    return rows.mapInArrow(run, f"doc_id {kinds['doc_id']}, embedding {kinds['embedding']}, cell int, away double")


class CellIndex:
    """``rows(doc_id, embedding, away, cell)`` partitioned by cell, ``headers(cell, n, least, most)``."""

    def __init__(self, rows: DataFrame, headers: DataFrame, centroids: np.ndarray):
        self.rows, self.headers, self.centroids = rows, headers, centroids

    @classmethod
    def build(cls, vectors: DataFrame, path: str, cells: int = CELLS, sample: int = SAMPLE, rounds: int = ROUNDS) -> CellIndex:
        spark, centroids = vectors.sparkSession, fit(vectors, cells, sample, rounds)
        told = assign(vectors, centroids) if len(centroids) else vectors.limit(0).select("doc_id", "embedding", F.lit(0).alias("cell"), F.lit(0.0).alias("away"))
        # A large cell lies in several files.
        told.repartition("cell", F.pmod(F.xxhash64("doc_id"), F.lit(4))).write.partitionBy("cell").parquet(f"{path}/rows")
        spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(centroids)], "cell int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
        return cls.read(spark, path, vectors)

    @classmethod
    def read(cls, spark: SparkSession, path: str, like: DataFrame) -> CellIndex:
        """``like`` tells the types of id and vector."""
        kinds = {f.name: f.dataType.simpleString() for f in like.schema}
        rows = spark.read.schema(f"doc_id {kinds['doc_id']}, embedding {kinds['embedding']}, away double, cell int").parquet(f"{path}/rows")
        found = spark.read.parquet(f"{path}/centroids").orderBy("cell").collect()
        headers = stored(rows.groupBy("cell").agg(F.count("*").alias("n"), F.min("away").alias("least"), F.max("away").alias("most")))
        return cls(rows, headers, np.array([r["centroid"] for r in found], np.float64) if found else np.empty((0, 0)))

    def _distances(self, queries: DataFrame) -> DataFrame:
        """``query_id, q, cell, d``: of every query to the centroid of every cell with rows."""
        centroids = self.centroids

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                q = batch.column("q").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                d = np.sqrt(((q[:, None, :] - centroids[None]) ** 2).sum(axis=2)) if batch.num_rows else np.empty((0, len(centroids)))
                yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("q"), pa.array(d.tolist(), pa.list_(pa.float64()))], ["query_id", "q", "ds"])

        kind = queries.schema["query_id"].dataType.simpleString()
        asked = queries.filter(F.size("embedding") == (centroids.shape[1] if len(centroids) else -1)).select("query_id", F.col("embedding").cast("array<double>").alias("q"))
        told = asked.mapInArrow(run, f"query_id {kind}, q array<double>, ds array<double>")
        each = told.select("query_id", "q", F.posexplode("ds").alias("cell", "d"))
        return each.join(F.broadcast(self.headers), "cell")  # a row a cell

    def _visit(self, visits: DataFrame, k: int, decimals: int) -> DataFrame:
        """``query_id, doc_id, score, rank``: the first k of each query in the cells of ``visits(query_id, q, cell)``."""
        kinds = {"query_id": visits.schema["query_id"].dataType.simpleString(), "doc_id": self.rows.schema["doc_id"].dataType.simpleString()}
        # A large cell's rows are dealt over chunks that all meet the cell's queries, and many queries likewise.
        asked_of = visits.groupBy("cell").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("parts"))
        chunks = F.broadcast(self.headers.select("cell", F.ceil(F.col("n") / ROWS).cast("int").alias("chunks")).join(asked_of, "cell"))
        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        rows = self.rows.join(chunks, "cell").select("cell", F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int").alias("chunk"), every("parts").alias("part"), "doc_id", "embedding")
        asked = visits.join(chunks, "cell").select("cell", every("chunks").alias("chunk"), F.pmod(F.xxhash64("query_id"), F.col("parts")).cast("int").alias("part"), "query_id", "q")
        types = {"query_id": to_arrow_type(visits.schema["query_id"].dataType), "doc_id": to_arrow_type(self.rows.schema["doc_id"].dataType), "score": pa.float64()}

        def meet(queries: pa.Table, members: pa.Table) -> pa.Table:
            out = [pa.table({n: pa.array([], t) for n, t in types.items()})]
            if members.num_rows and queries.num_rows:
                points, asked = (_matrix(t.column(c)) for t, c in ((members, "embedding"), (queries, "q")))
                n = min(k, len(points))
                for at in range(0, len(asked), AT_ONCE):
                    q = asked[at : at + AT_ONCE]
                    near = _squared(q, points)
                    limit = np.partition(near, n - 1, axis=1)[:, n - 1] + 4 * 10.0**-decimals
                    i, j = np.nonzero(near <= limit[:, None])
                    d = np.zeros(len(i))
                    for x in range(q.shape[1]):  # in the order of the native expression
                        apart = points[j, x] - q[i, x]
                        d += apart * apart
                    columns = [queries.column("query_id").take(pa.array(at + i)), members.column("doc_id").take(pa.array(j)), pa.array(d)]
                    out.append(pa.table([c.cast(t) for c, t in zip(columns, types.values(), strict=True)], names=list(types)))
            return pa.concat_tables(out)

        keys = ["cell", "chunk", "part"]
        found = asked.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(meet, f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, score double")
        near = found.select("query_id", "doc_id", F.round("score", decimals).alias("score"))
        return top(near, [F.col("score").asc(), F.col("doc_id").asc()], k, ["query_id"])

    def search(self, queries: DataFrame, k: int, probes: int = PROBES, decimals: int = 9) -> DataFrame:
        """Approximate: ``query_id, doc_id, score`` (squared distance) and ``rank``."""
        order = W.partitionBy("query_id").orderBy("d", "cell")
        visits = self._distances(queries).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= probes)
        return self._visit(stored(visits.select("query_id", "q", "cell")), k, decimals)

    def exact(self, queries: DataFrame, k: int, decimals: int = 9) -> DataFrame:
        """As a search of all rows."""
        far = stored(self._distances(queries))
        # Nearest cells until they hold k rows: their k-th distance bounds that of all.
        order = W.partitionBy("query_id").orderBy("d", "cell")
        before = F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        first = far.withColumn("before", before).filter(F.col("before") < k)
        limits = self._visit(stored(first.select("query_id", "q", "cell")), k, decimals).groupBy("query_id").agg(F.max("score").alias("kth"), F.count("*").alias("n"))
        limits = stored(limits.select("query_id", F.when(F.col("n") >= k, F.sqrt("kth") + ROOM).alias("limit")))
        bound = F.greatest(F.col("d") - F.col("most"), F.col("least") - F.col("d"))
        near = far.join(limits, "query_id", "left").filter(F.col("limit").isNull() | (bound <= F.col("limit")))
        self.visited = stored(near.select("query_id", "q", "cell"))
        return self._visit(self.visited, k, decimals)


def recall(found: DataFrame, wanted: DataFrame) -> float:
    """The share of wanted ``(query_id, doc_id)`` that was found."""
    hit = wanted.select("query_id", "doc_id").join(found.select("query_id", "doc_id").distinct().withColumn("hit", F.lit(1)), ["query_id", "doc_id"], "left")
    row = hit.agg(F.count("hit").alias("hits"), F.count("*").alias("n")).first()
    return row["hits"] / row["n"] if row["n"] else 1.0
