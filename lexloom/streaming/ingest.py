"""Incremental ingest with Structured Streaming: new files become index rows once."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from lexloom.sources.commits import load
from lexloom.sources.files import create_text, key_exists


def follow(spark: SparkSession, folder: str, schema: T.StructType, format: str = "parquet", files_per_batch: int = 1000) -> DataFrame:
    """The files of a folder as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(format).load(folder)


def index_new(rows: DataFrame, index_path: str, checkpoint: str, key: str = "chunk_id", prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Load what the index lacks and stop when the backlog is done; :func:`lexloom.sources.commits.collection` reads it.

    A micro-batch is a committed load, so a repeated one adds nothing, and reads the buckets of its own keys only.
    """

    def batch(df: DataFrame, number: int) -> None:
        load(prepare(df), index_path, f"{checkpoint}#{number}", key)

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def progress(events: DataFrame, time: str = "ts", late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Counts of ingest events per window and kind, late ones tolerated up to a watermark."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "event_type").agg(F.count("*").alias("n"))


def counted(rows: DataFrame, name: str, **figures: Column) -> DataFrame:
    """The same rows; ``rows`` and the aggregates ``figures`` are taken as they pass, without a pass of their own."""
    return rows.observe(name, F.count(F.lit(1)).alias("rows"), *(c.alias(n) for n, c in figures.items()))


class ProgressLog(StreamingQueryListener):
    """One small object per micro-batch of the stream ``name``: its number and what :func:`counted` took, under ``path``.

    Spark tells of a batch after it is committed. One that runs again after a restart has its number again and is
    written once, so the log counts each batch once; a batch whose stream died before it was told of is missing.
    """

    def __init__(self, spark: SparkSession, path: str, name: str):
        self.spark, self.path, self.name = spark, path.rstrip("/"), name
        self._ended, self._runs = threading.Condition(), set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        told = event.progress.observedMetrics.get(self.name)
        if told is not None and event.progress.numInputRows:
            record = {"batch": event.progress.batchId, "input": event.progress.numInputRows, "figures": json.dumps(told.asDict(), default=str)}
            create_text(self.spark, f"{self.path}/{event.progress.batchId:012d}.json", json.dumps(record))

    def onQueryTerminated(self, event) -> None:
        with self._ended:
            self._runs.add(str(event.runId))
            self._ended.notify_all()

    def finish(self, query: StreamingQuery, seconds: float = 60.0) -> None:
        """Wait for the query's end and for its last batch to be told of."""
        query.awaitTermination()
        with self._ended:
            if not self._ended.wait_for(lambda: str(query.runId) in self._runs, seconds):
                raise TimeoutError(f"the end of stream {query.runId} was not told of")

    def rows(self, figures: str) -> DataFrame:
        """``batch, input`` and the named figures (a schema), a row a batch."""
        if not key_exists(self.spark, self.path):
            return self.spark.createDataFrame([], f"batch long, input long, {figures}")
        told = self.spark.read.schema("batch long, input long, figures string").json(self.path)
        return told.withColumn("f", F.from_json("figures", figures)).select("batch", "input", "f.*")


def closed_windows(events: DataFrame, late: str = "10 minutes", window: str = "1 hour", time: str = "ts") -> DataFrame:
    """``event_type, start, n`` of a stream's windows, each once, when the watermark passes its end; later rows of it are dropped.

    ``start`` has the type of ``time``; times without a zone are read in the session's.
    """
    own = events.schema[time].dataType
    rows = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    counts = rows.groupBy(F.window(time, window).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counts.select("event_type", F.col("w.start").cast(own).alias("start"), "n")


def backlog(rows: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append what a stream gives for its backlog to a table of Parquet files, each row once over restarts."""
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", folder).outputMode("append").trigger(availableNow=True).start()
