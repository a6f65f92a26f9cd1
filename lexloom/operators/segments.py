"""A stored BM25 index of immutable segments that merge their statistics when they are read.

A segment holds the blocks of its documents' postings (see :mod:`lexloom.operators.postings`), its document
frequencies and lengths, in folders by bucket of token; the log names what counts (see :mod:`lexloom.sources.commits`).
Adding writes one segment, deleting writes which documents of which segments are dead and what they take off the document
frequencies, compacting writes the living postings of all segments as one. A query merges n, lengths and df of what
lives, reads its tokens' buckets only and answers as an index that was built anew would.

Ids are unique among living documents; an update is a deletion and an addition. A null id counts in statistics and is
returned like any other.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.functions import fixed
from lexloom.operators.index import raw_idf, tokens
from lexloom.operators.postings import BLOCK, blocks, checked
from lexloom.session import stored
from lexloom.sources.commits import CommitLog

BUCKETS, FILES = 32, 8


def bucket(buckets: int):
    return F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int")


class SegmentedIndex:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, epsilon: float = fixed.BM25_EPSILON, decimals: int = 9):
        self.spark, self.path, self.buckets, self.epsilon, self.decimals = spark, path.rstrip("/"), buckets, epsilon, decimals
        self.log = CommitLog(spark, f"{self.path}/log")
        self.refresh()

    # --- What counts

    def refresh(self) -> None:
        """Take in what others have committed."""
        self.records = self.log.records()
        self.segments: dict[str, dict] = {}
        self.deletes: list[dict] = []
        for r in self.records:
            if r["kind"] == "segment":
                self.segments[r["id"]] = r
            elif r["kind"] == "compact":
                self.segments = {k: s for k, s in self.segments.items() if k not in r["replaces"]} | {r["id"]: r}
                self.deletes = [d for d in self.deletes if set(d["of"]) - set(r["replaces"])]
            else:
                self.deletes.append(r)

    def _read(self, table: str, ids: list[str], columns: str, wanted: list[int] | None = None) -> DataFrame:
        if not ids:
            return self.spark.createDataFrame([], f"{columns}, seg string")
        parts = ", bucket int" if table in ("blocks", "terms", "gone") else ""
        rows = self.spark.read.schema(f"{columns}, seg string{parts}").option("basePath", f"{self.path}/{table}").parquet(*(f"{self.path}/{table}/seg={i}" for i in ids))
        if wanted is not None:
            rows = rows.filter(F.col("bucket").isin(wanted))
        return rows

    def _id_kind(self) -> str:
        return next((r["id_kind"] for r in self.records), "bigint")

    @property
    def docs(self) -> DataFrame:
        """``doc_id, dl, seg`` of the living."""
        rows = self._read("docs", list(self.segments), f"doc_id {self._id_kind()}, dl int")
        return rows if self.dead is None else rows.join(checked(self.dead), ["seg", "doc_id"], "left_anti")

    @property
    def dead(self) -> DataFrame | None:
        ids = [d["id"] for d in self.deletes]
        if not ids:
            return None
        return self._read("dead", ids, f"doc_id {self._id_kind()}, own string").select(F.col("own").alias("seg"), "doc_id").filter(F.col("seg").isin(list(self.segments)))

    @property
    def stats(self) -> DataFrame:
        """``n, avgdl``: sums over segments less those of the dead."""
        row = self.docs.agg(F.count("*").alias("n"), F.round(F.avg("dl"), self.decimals).alias("avgdl")) if self.deletes else None
        if row is not None:
            return row
        n, total = (sum(s[c] for s in self.segments.values()) for c in ("n", "total"))
        return self.spark.createDataFrame([(n, round(total / n, self.decimals) if n else None)], "n long, avgdl double")

    def ids(self) -> DataFrame:
        return self.docs.select("doc_id")

    def rows_an_id(self) -> int:
        return 1

    def _frequencies(self, wanted: list[int] | None) -> DataFrame:
        """``token, df``, merged."""
        df = self._read("terms", list(self.segments), "token string, df long", wanted).select("token", "df")
        gone = [d["id"] for d in self.deletes]
        if gone:
            less = self._read("gone", gone, "token string, df long, own string", wanted).filter(F.col("own").isin(list(self.segments)))
            df = df.unionByName(less.select("token", (-F.col("df")).alias("df")))
        return df.groupBy("token").agg(F.sum("df").alias("df")).filter("df > 0")

    def terms(self, wanted: list[int] | None = None) -> DataFrame:
        """``token, df, idf``; the mean idf is counted over all tokens, and only where one of those asked for is negative."""
        n = self.stats.first()["n"]
        told = stored(self._frequencies(wanted).withColumn("raw", raw_idf(F.lit(n), F.col("df"), self.decimals)))
        if told.filter("raw < 0").isEmpty():
            return told.select("token", "df", F.col("raw").alias("idf"))
        mean = self._frequencies(None).agg(F.round(F.avg(raw_idf(F.lit(n), F.col("df"), self.decimals)), self.decimals)).first()[0]
        return told.select("token", "df", F.when(F.col("raw") < 0, F.round(F.lit(self.epsilon * mean), self.decimals)).otherwise(F.col("raw")).alias("idf"))

    def buckets_of(self, wanted: DataFrame) -> list[int]:
        return sorted(r[0] for r in wanted.select(bucket(self.buckets)).distinct().collect())

    def read_blocks(self, wanted: list[int] | None = None) -> DataFrame:
        kind = f"token string, part long, parts long, level int, n long, most_tf long, least_dl int, docs array<struct<doc_id:{self._id_kind()}, tf:long, dl:int>>"
        return self._read("blocks", list(self.segments), kind, wanted)

    def blocks(self, asked: DataFrame, avgdl: float) -> tuple[DataFrame, DataFrame]:
        """As of an index in memory, from the buckets of the asked tokens."""
        wanted = self.buckets_of(asked.select("token"))
        weighed = asked.join(self.terms(wanted), "token").select("query_id", "token", (F.col("times") * F.col("idf")).alias("w"))
        return self.read_blocks(wanted), weighed

    def found(self, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The living postings ``token, doc_id, tf, dl`` of the asked tokens, and ``query_id, token, w``."""
        held, weighed = self.blocks(asked, 0.0)
        near = held.join(checked(asked.select("token").distinct()), "token", "left_semi").select("seg", "token", F.explode("docs").alias("d")).select("seg", "token", "d.*")
        near = near if self.dead is None else near.join(checked(self.dead), ["seg", "doc_id"], "left_anti")
        return near.select("token", "doc_id", "tf", "dl"), weighed

    # --- Changes

    def _commit(self, record: dict) -> bool:
        """As the next record; False if what this index had read is out of date."""
        done = self.log.append({"id_kind": record.pop("id_kind", self._id_kind()), **record}, len(self.records))
        self.refresh()
        return done

    def _write(self, postings: DataFrame, docs: DataFrame, block: int) -> dict:
        own = f"s{uuid.uuid4().hex}"
        docs.write.parquet(f"{self.path}/docs/seg={own}")
        row = docs.agg(F.count("*").alias("n"), F.sum("dl").alias("total")).first()
        terms = stored(postings.groupBy("token").agg(F.count("*").alias("df")))
        terms.withColumn("bucket", bucket(self.buckets)).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/terms/seg={own}")
        held = blocks(postings, terms, (row["total"] or 0) / row["n"] if row["n"] and row["total"] else 1.0, block).withColumn("bucket", bucket(self.buckets))
        # A frequent token's blocks lie in several files of its bucket.
        dealt = held.repartition("bucket", F.pmod(F.xxhash64("token", "part", "level"), F.lit(FILES)))
        dealt.write.partitionBy("bucket").parquet(f"{self.path}/blocks/seg={own}")
        return {"id": own, "n": row["n"], "total": int(row["total"] or 0), "id_kind": docs.schema["doc_id"].dataType.simpleString()}

    def add(self, documents: DataFrame, text: str = "text", doc_id: str = "doc_id", block: int = BLOCK, batch: str | None = None) -> bool:
        """One segment of the documents; False if their ``batch`` is in the log already."""
        split = documents.select(F.col(doc_id).alias("doc_id"), tokens(F.col(text)).alias("ts")).withColumn("dl", F.size("ts"))
        split = stored(split)
        counted = split.select("doc_id", "dl", F.explode("ts").alias("token")).groupBy("token", "doc_id", "dl").agg(F.count("*").alias("tf"))
        facts = self._write(stored(counted), split.select("doc_id", "dl"), block)
        while batch is None or not any(r.get("batch") == batch for r in self.records):
            if self._commit({"kind": "segment", "batch": batch, **facts}):
                return True
        return False

    def _living(self) -> DataFrame:
        """``seg, token, doc_id, tf, dl``"""
        rows = self.read_blocks().select("seg", "token", F.explode("docs").alias("d")).select("seg", "token", "d.*")
        return rows if self.dead is None else rows.join(checked(self.dead), ["seg", "doc_id"], "left_anti")

    def delete(self, ids: DataFrame) -> int:
        """The living documents of the ids ``doc_id`` die; their number."""
        while True:
            own = f"d{uuid.uuid4().hex}"
            dead = stored(self.docs.join(checked(ids.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", F.col("seg").alias("own")))
            if not (count := dead.count()):
                return 0
            dead.write.parquet(f"{self.path}/dead/seg={own}")
            keys = dead.select("doc_id", F.col("own").alias("seg"))
            less = self._living().join(checked(keys), ["seg", "doc_id"], "left_semi").groupBy("token", F.col("seg").alias("own")).agg(F.count("*").alias("df"))
            less.withColumn("bucket", bucket(self.buckets)).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/gone/seg={own}")
            if self._commit({"kind": "delete", "id": own, "of": list(self.segments)}):
                return count

    def compact(self, block: int = BLOCK) -> None:
        """The living postings of all segments as one."""
        while len(self.segments) > 1 or self.deletes:
            replaced = list(self.segments)
            facts = self._write(stored(self._living().select("token", "doc_id", "tf", "dl")), stored(self.docs.select("doc_id", "dl")), block)
            if self._commit({"kind": "compact", "replaces": replaced, **facts}):
                return
