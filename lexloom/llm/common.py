"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of the word and line contracts: U+0020 and U+0009 to U+000D.
SPACE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row and bound to a lambda variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def packed(df: DataFrame, **more: Column) -> DataFrame:
    """``row``, a struct of the input's columns, beside named expressions on them, so that no names can clash."""
    return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), *(c.alias(n) for n, c in more.items()))


def unpacked(df: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns of ``row`` again, some replaced."""
    return df.select(*(changed.get(c, F.col("row").getField(c)).alias(c) for c in columns))


def words(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space; null counts as empty."""
    blanks = F.translate(F.coalesce(text, F.lit("")), SPACE[1:], " " * len(SPACE[1:]))
    return F.array_remove(F.split(blanks, " "), "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a session of one machine that names none gets a folder of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="lexloom-"))
    return context.getCheckpointDir()


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of any file system that Spark knows."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def rows_batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    """Rows as one Arrow batch of the named types."""
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage through reliable storage that every executor can read again."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """As :func:`durable`, by columns: a table in the shared folder, of which later passes read what they name."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that are done.

    It acts when the driver's memory is collected, which a small driver of a long iterative job seldom needs.
    """
    spark.sparkContext._jvm.System.gc()
