"""Centroid clustering of integer vectors with Drake's adaptive bounds.

Each row keeps its centroid, an upper bound of the distance to it, lower bounds of its next nearest centroids one by
one and one remainder bound below all other centroids. When centroids move, the upper bound grows by the move of its
centroid, each lower bound falls by that of its own and the remainder by the largest. A row whose upper bound is
below all lower ones keeps its centroid without a distance; else the bound is made exact, then only the listed
centroids that are still not told apart are measured, and all centroids only where the remainder bound does not rule
the others out. The list starts with a quarter of the centroids and shrinks to what the last round needed, an eighth
at least (the adaptive part). Distances are exact integers; bounds are floats that are widened by more than their
rounding errors, so a bound certifies only what is strictly true, and ties are always measured.

A round is one pass over the rows in Arrow batches and one native aggregation of exact component sums, combined
map-side; ``k`` rows come back to the driver. The rows of a round stand as Parquet in the shared folder, so lost executors read
them again, and go when the next round's are written.

Defined results: rows whose vector is null, of another length or holds a null or non-finite component are left out;
fewer rows than centroids make as many centroids as rows; repeated rows count each; rows with a null id are
clustered, but become first centroids only where too few others exist; equal distances go to the smaller number; a
centroid without rows stays; extra columns are ignored; an empty table gives an empty table. Scaled components above
``LARGEST`` in size raise a ValueError, as squared distances could leave a long.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexloom.llm.common import durable, remove, shared_folder

CLUSTERS, ROUNDS, SIZE, SCALE, SEED = 8, 10, 64, 1024, "3:"
LARGEST = 1 << 27
#: More than the relative rounding error of one step of a bound.
SLACK = 1e-9
STATE = "vec_id {kind}, p array<int>, a int, u double, near array<int>, low array<double>, rest double, used int"


@dataclass(frozen=True)
class Clusters:
    """``rows``: vec_id, cluster, distance (squared); ``centroids``: component lists by number."""

    rows: DataFrame
    centroids: list[list[int]]


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, rows x centroids."""
    out = np.empty((len(points), len(centroids)), np.int64)
    for k, c in enumerate(centroids):
        out[:, k] = _apart(points, c)
    return out


def _apart(points: np.ndarray, other: np.ndarray) -> np.ndarray:
    d = points - other
    return np.einsum("ij,ij->i", d, d)


@dataclass
class Bounds:
    """Of n rows: centroid, upper bound, numbers and lower bounds of b listed centroids, remainder bound, what was used."""

    a: np.ndarray
    u: np.ndarray
    near: np.ndarray
    low: np.ndarray
    rest: np.ndarray
    used: np.ndarray

    @classmethod
    def measured(cls, points: np.ndarray, centroids: np.ndarray, listed: int) -> Bounds:
        d = distances(points, centroids)
        order = np.argsort(d, axis=1, kind="stable")  # ties: the smaller number first
        root = np.sqrt(np.take_along_axis(d, order, 1).astype(np.float64))
        listed = min(listed, len(centroids) - 1)
        rest = root[:, listed + 1] * (1 - SLACK) if listed + 1 < len(centroids) else np.full(len(points), np.inf)
        return cls(order[:, 0], root[:, 0] * (1 + SLACK), order[:, 1 : listed + 1], root[:, 1 : listed + 1] * (1 - SLACK), rest, np.full(len(points), listed + 1))

    def shortened(self, listed: int) -> Bounds:
        """The list cut to its first entries; the others go into the remainder bound."""
        if listed >= self.near.shape[1]:
            return self
        self.rest = np.minimum(self.rest, self.low[:, listed:].min(axis=1))
        self.near, self.low = self.near[:, :listed].copy(), self.low[:, :listed].copy()
        return self

    def moved(self, points: np.ndarray, centroids: np.ndarray, drift: np.ndarray) -> int:
        """After every centroid went ``drift`` far: new bounds and centroids; the number of exact distances."""
        self.u = (self.u + drift[self.a]) * (1 + SLACK)
        far = drift[self.near]
        self.low = self.low - far - SLACK * (np.abs(self.low) + far)
        most = drift.max(initial=0.0)
        self.rest = self.rest - most - SLACK * (np.where(np.isfinite(self.rest), np.abs(self.rest), 0) + most)
        self.used = np.zeros(len(self.a), np.int64)
        open_ = np.flatnonzero(self.u >= np.minimum(self.rest, self.low.min(axis=1, initial=np.inf)))
        if not len(open_):
            return 0
        exact = _apart(points[open_], centroids[self.a[open_]])
        done = len(open_)
        self.u[open_] = np.sqrt(exact.astype(np.float64)) * (1 + SLACK)
        whole = self.u[open_] >= self.rest[open_]
        rows = open_[whole]
        if len(rows):
            done += len(rows) * len(centroids)
            new = Bounds.measured(points[rows], centroids, self.near.shape[1])
            self.a[rows], self.u[rows], self.near[rows], self.low[rows], self.rest[rows], self.used[rows] = new.a, new.u, new.near, new.low, new.rest, new.used
        rows, exact = open_[~whole], exact[~whole]
        for z in range(self.near.shape[1]):
            at = np.flatnonzero(self.u[rows] >= self.low[rows, z])
            if not len(at):
                continue
            r = rows[at]
            self.used[r] = z + 1
            other = self.near[r, z].copy()
            d = _apart(points[r], centroids[other])
            done += len(r)
            better = (d < exact[at]) | ((d == exact[at]) & (other < self.a[r]))
            lost_a, lost_d = np.where(better, self.a[r], other), np.where(better, exact[at], d)
            self.a[r], exact[at] = np.where(better, other, self.a[r]), np.where(better, d, exact[at])
            self.near[r, z], self.low[r, z] = lost_a, np.sqrt(lost_d.astype(np.float64)) * (1 - SLACK)
            self.u[r] = np.sqrt(exact[at].astype(np.float64)) * (1 + SLACK)
        return done


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), width)


def _step(centroids: np.ndarray, drift: np.ndarray | None, listed: int, last: bool):
    """Batches of one round; the first, without a drift, measures everything."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = {n: batch.column(n) for n in batch.schema.names}
            points = _matrix(column["p"], centroids.shape[1], np.int64)
            if drift is None:
                b = Bounds.measured(points, centroids, listed)
            else:
                width = len(column["near"][0])
                flat = {n: column[n].to_numpy(zero_copy_only=False).copy() for n in ("a", "u", "rest")}
                b = Bounds(flat["a"].astype(np.int64), flat["u"], _matrix(column["near"], width, np.int64), _matrix(column["low"], width, np.float64), flat["rest"], np.zeros(len(points), np.int64))
                b.shortened(listed).moved(points, centroids, drift)
            if last:
                yield pa.RecordBatch.from_arrays([column["vec_id"], pa.array(b.a, pa.int32()), pa.array(_apart(points, centroids[b.a]))], ["vec_id", "cluster", "distance"])
                continue
            ends = pa.array(np.arange(len(points) + 1) * b.near.shape[1], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x.ravel(), k)) for x, k in ((b.near, pa.int32()), (b.low, pa.float64()))]
            yield pa.RecordBatch.from_arrays(
                [column["vec_id"], column["p"], pa.array(b.a, pa.int32()), pa.array(b.u), *lists, pa.array(b.rest), pa.array(b.used, pa.int32())],
                ["vec_id", "p", "a", "u", "near", "low", "rest", "used"],
            )

    return run


def integers(vectors: DataFrame, size: int = SIZE, scale: int = SCALE, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``vec_id, p``: the floors of the scaled components of rows with whole vectors."""
    x = F.col(embedding)
    whole = (F.size(x) == size) & F.forall(x, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < float("inf")))
    return vectors.filter(F.coalesce(whole, F.lit(False))).select(F.col(vec_id).alias("vec_id"), F.transform(x, lambda v: F.floor(F.lit(scale) * v.cast("double")).cast("long")).alias("p"))


def cluster(vectors: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: str = SEED, vec_id: str = "vec_id", embedding: str = "embedding") -> Clusters:
    """Lloyd's rounds from the rows with the least hashes of id, then a last assignment."""
    spark = vectors.sparkSession
    points = integers(vectors, size, scale, vec_id, embedding)
    kind = points.schema["vec_id"].dataType.simpleString()
    told = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = [r["p"] for r in points.orderBy(told.asc_nulls_last(), "p").limit(clusters).collect()]
    if not first:
        return Clusters(spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long"), [])
    if points.agg(F.max(F.greatest(F.array_max("p"), -F.array_min("p")))).first()[0] > LARGEST:
        raise ValueError(f"a scaled component is larger than {LARGEST}")
    centroids, drift = np.array(first, np.int64), None
    listed = max(1, len(first) // 4)
    state, folder, at = points.withColumn("p", F.col("p").cast("array<int>")), f"{shared_folder(spark)}/clusters-{uuid.uuid4().hex}", None
    for k in range(rounds):
        run = _step(centroids, drift, listed, False)
        out = f"{folder}/{k}"
        state.mapInArrow(run, STATE.format(kind=kind)).write.parquet(out)
        state = spark.read.parquet(out)
        if at:
            remove(spark, at)
        at = out
        sums = state.groupBy("a").agg(F.count("*").alias("n"), F.max("used").alias("used"), *(F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(size))).collect()
        new = centroids.copy()
        for r in sums:
            new[r["a"]] = [r[f"s{i}"] // r["n"] for i in range(size)]
        drift = np.sqrt(_apart(new, centroids).astype(np.float64)) * (1 + SLACK)
        listed = max(1, len(first) // 8, min(listed, max(r["used"] for r in sums)))
        centroids = new
    run = _step(centroids, drift, listed, True)
    rows = durable(state.mapInArrow(run, f"vec_id {kind}, cluster int, distance long"))
    if at:
        remove(spark, folder)
    return Clusters(rows, centroids.tolist())


def digest(vectors: DataFrame, **parameters) -> DataFrame:
    found = cluster(vectors.select("vec_id", "embedding"), **parameters)
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]
    per = {r["cluster"]: int(r["s"]) for r in found.rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    facts = [(k, s, sum(per.values()), hashes[k]) for k, s in per.items()]  # a row per centroid
    told = found.rows.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.rows.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle(clusters: int = CLUSTERS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: str = SEED) -> str:
    """The rounds without bounds, written out."""
    apart = "list_sum(list_transform(list_zip(p, m), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    assign = lambda c: f"SELECT rid, any_value(vec_id) AS vec_id, any_value(p) AS p, arg_min(c, d::HUGEINT * {clusters} + c) AS c, min(d) AS d FROM (SELECT rid, vec_id, p, c, {apart} AS d FROM points, {c}) GROUP BY rid"
    parts = [
        f"points AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS p FROM embeddings "
        f"WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h NULLS LAST, p) - 1 AS c, p AS m FROM (SELECT sha256('{seed}' || vec_id::VARCHAR) AS h, p FROM points ORDER BY h NULLS LAST, p LIMIT {clusters}))",
    ]
    for k in range(rounds):
        parts += [
            f"a{k} AS MATERIALIZED ({assign(f'c{k}')})",
            f"s{k} AS (SELECT c, i, sum(v) AS s, count(*) AS n FROM (SELECT c, unnest(p) AS v, generate_subscripts(p, 1) AS i FROM a{k}) GROUP BY c, i)",
            f"n{k} AS (SELECT c, list(((s - (s % n + n) % n) // n)::BIGINT ORDER BY i) AS m FROM s{k} GROUP BY c)",
            f"c{k + 1} AS MATERIALIZED (SELECT o.c, coalesce(n.m, o.m) AS m FROM c{k} o LEFT JOIN n{k} n ON o.c = n.c)",
        ]
    parts.append(f"last AS MATERIALIZED ({assign(f'c{rounds}')})")
    told = f"SELECT c, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM c{rounds}"
    return (
        f"WITH {', '.join(parts)} SELECT vec_id, c::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, "
        f"(sum(d) OVER ())::BIGINT AS inertia, centroid_sha256 FROM last JOIN ({told}) USING (c)"
    )
