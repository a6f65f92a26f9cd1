"""Tables of whole loads: a numbered record per load, written last, says which files count.

A load writes its files to a folder of its own and then creates the next record, which only one of several loads at
once can. The others look again at what has been committed since and try once more. Readers see the folders that
records name, so a load that was killed half way, or whose tasks ran twice, leaves nothing that counts.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.operators.index import only_new
from lexloom.sources.files import create_text, key_exists, remove

BUCKETS = 64


class CommitLog:
    """The records of a table, by number; one small object each."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def records(self) -> list[dict]:
        """In order, up to the first that is missing or still being written."""
        if not key_exists(self.spark, self.path):
            return []
        rows = self.spark.read.text(f"{self.path}/*.json", wholetext=True).select("value", F.col("_metadata.file_name").alias("name")).collect()
        told = {int(r["name"].split(".")[0]): r["value"] for r in rows}
        out: list[dict] = []
        while (text := told.get(len(out))) is not None:
            try:
                out.append(json.loads(text))
            except ValueError:
                break
        return out

    def append(self, record: dict, number: int) -> bool:
        """Whether the record could be made the one of this number."""
        return create_text(self.spark, f"{self.path}/{number:012d}.json", json.dumps(record))


def bucket(key: str, buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def read_loads(spark: SparkSession, path: str, schema: T.StructType, loads: list[str], buckets: list[int] | None = None) -> DataFrame:
    """The rows of the named loads, of some buckets only where these are given."""
    if not loads:
        return spark.createDataFrame([], schema)
    whole = T.StructType([*schema.fields, T.StructField("load", T.StringType()), T.StructField("bucket", T.IntegerType())])
    rows = spark.read.schema(whole).option("basePath", f"{path}/data").parquet(*(f"{path}/data/load={x}" for x in loads))
    if buckets is not None:
        rows = rows.filter(F.col("bucket").isin(buckets))
    return rows.select(*schema.names)


def collection(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All committed rows."""
    return read_loads(spark, path, schema, [r["load"] for r in CommitLog(spark, f"{path}/log").records() if r["rows"]])


def load(rows: DataFrame, path: str, batch: str, key: str = "chunk_id", buckets: int = BUCKETS) -> int:
    """Add the rows whose key the table lacks, each key once; the number of rows added.

    A ``batch`` that is in the log adds nothing. Only the buckets that the rows fall into are read of the table.
    """
    spark, path = rows.sparkSession, path.rstrip("/")
    log = CommitLog(spark, f"{path}/log")
    touched = [r[0] for r in rows.select(bucket(key, buckets)).distinct().collect()]  # numbers below ``buckets``
    while True:
        records = log.records()
        if any(r["batch"] == batch for r in records):
            return 0
        known = read_loads(spark, path, rows.schema, [r["load"] for r in records if r["rows"]], touched)
        own = uuid.uuid4().hex
        folder = f"{path}/data/load={own}"
        only_new(rows, known, key).withColumn("bucket", bucket(key, buckets)).write.partitionBy("bucket").parquet(folder)
        count = spark.read.parquet(folder).count() if touched and _has_rows(spark, folder) else 0
        if log.append({"batch": batch, "load": own, "rows": count}, len(records)):
            return count
        remove(spark, folder)


def _has_rows(spark: SparkSession, folder: str) -> bool:
    """Whether a bucket was written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/bucket=*")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0
