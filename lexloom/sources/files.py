"""File sources and sinks of the layers: everything through Spark's readers and writers, so any store will do."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions.text import base_name, normalize_text, stem, strip, title

RECORD = T.StructType([T.StructField("page_content", T.StringType()), T.StructField("metadata", T.MapType(T.StringType(), T.StringType()))])


def list_keys(spark: SparkSession, prefix: str, suffix: str = "") -> DataFrame:
    """``path, length, modified`` under a prefix, sorted; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}")
    return files.load(prefix).select("path", "length", F.col("modificationTime").alias("modified")).orderBy("path")


def key_exists(spark: SparkSession, path: str) -> bool:
    store, target = _file_system(spark, path)
    return store.exists(target)


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """One named object, replaced if it is there; for reports and sidecars, not for tables."""
    store, target = _file_system(spark, path)
    out = store.create(target, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """A new named object; False, and nothing written, if there is one already."""
    store, target = _file_system(spark, path)
    try:
        out = store.create(target, False)
    except Exception as e:
        if store.exists(target):
            return False
        raise e
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    return True


def remove(spark: SparkSession, path: str) -> None:
    store, target = _file_system(spark, path)
    store.delete(target, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    write_bytes(spark, path, text.encode("utf-8"))


def upload(spark: SparkSession, local: str, path: str) -> None:
    """A local file of the driver, or a folder with all below it under the same relative names, to any store."""
    store, target = _file_system(spark, path)
    if not os.path.isdir(local):
        store.copyFromLocalFile(False, True, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"file://{os.path.abspath(local)}"), target)
        return
    for name in sorted(os.listdir(local)):
        upload(spark, os.path.join(local, name), f"{path.rstrip('/')}/{name}")


def download(spark: SparkSession, path: str, local: str) -> None:
    store, source = _file_system(spark, path)
    store.copyToLocalFile(False, source, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"file://{os.path.abspath(local)}"), True)


def read_texts(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    """``path, text``: whole files."""
    found = spark.read.option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").text(path, wholetext=True)
    return found.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_binaries(spark: SparkSession, path: str, suffix: str = "") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", "true").load(path).select("path", "content")


def write_texts(df: DataFrame, path: str, text: str = "text") -> None:
    df.select(F.col(text).alias("value")).write.mode("overwrite").text(path)


def write_jsonl(df: DataFrame, path: str, text: str = "page_content", source: str = "source") -> None:
    """One folder ``source_stem=...`` per source, records ``page_content`` and ``metadata``.

    A large source may fill several files; rows are dealt by stem and a hash so that no source binds a task.
    """
    name = F.coalesce(F.nullif(stem(F.col(source)), F.lit("")), F.lit("document"))
    meta = F.create_map(*(x for c in df.columns if c != text for x in (F.lit(c), F.col(f"`{c}`").cast("string"))))
    rows = df.select(name.alias("source_stem"), F.col(text).alias("page_content"), F.map_filter(meta, lambda k, v: v.isNotNull()).alias("metadata"))
    rows.repartition("source_stem", F.pmod(F.xxhash64("page_content"), F.lit(16))).write.mode("overwrite").partitionBy("source_stem").json(path)


def read_jsonl(spark: SparkSession, path: str, source_stem: str | None = None) -> DataFrame:
    """Records of all sources or of one, whose folder alone is then read; missing metadata are an empty map."""
    schema = T.StructType([*RECORD.fields, T.StructField("source_stem", T.StringType())])
    rows = spark.read.schema(schema).json(path)
    rows = rows.filter(F.col("source_stem") == source_stem) if source_stem is not None else rows
    return rows.withColumn("metadata", F.coalesce("metadata", F.create_map().cast("map<string,string>")))


def read_metadata_csv(spark: SparkSession, path: str, key: str = "Archivo") -> DataFrame:
    """A row per key: values trimmed, blanks null; of repeated keys the last row wins."""
    raw = spark.read.option("header", "true").option("sep", ";").option("encoding", "UTF-8").csv(path)
    return last_by_key(raw.withColumn("__at", F.monotonically_increasing_id()), key, "__at")


def last_by_key(raw: DataFrame, key: str, order: str) -> DataFrame:
    names = [c for c in raw.columns if c not in (key, order)]
    clean = raw.select(strip(F.col(f"`{key}`")).alias(key), order, *(F.nullif(strip(F.col(f"`{c}`")), F.lit("")).alias(c) for c in names))
    last = clean.filter(F.coalesce(F.col(f"`{key}`"), F.lit("")) != "").groupBy(key).agg(F.max(F.struct(order, *names)).alias("__r"))
    return last.select(key, *(F.col(f"__r.`{c}`").alias(c) for c in names))


def with_metadata(docs: DataFrame, metadata: DataFrame, key: str = "Archivo", source: str = "source") -> DataFrame:
    """Left join on the file name with ``.md`` read as ``.pdf``; present values win over columns of equal name."""
    pdf = F.regexp_replace(base_name(F.col(source)), r"\.md$", ".pdf")
    names = [c for c in metadata.columns if c != key]
    right = metadata.select(F.col(key).alias("__key"), *(F.col(f"`{c}`").alias(f"__m_{c}") for c in names))
    joined = docs.withColumn("__pdf", pdf).join(right, F.col("__pdf") == F.col("__key"), "left")
    kept = [F.coalesce(F.col(f"`__m_{c}`"), F.col(f"`{c}`")).alias(c) if c in names else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*kept, *(F.col(f"`__m_{c}`").alias(c) for c in names if c not in docs.columns))


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    """``source, title, page_content`` of the Markdown files, normalised."""
    docs = read_texts(spark, path, ".md")
    return docs.select(base_name(F.col("path")).alias("source"), title(F.col("path")).alias("title"), normalize_text(F.col("text")).alias("page_content"))


def convert_documents(files: DataFrame, converter: Callable[[bytes], str]) -> DataFrame:
    """``path, content`` to ``stem, markdown, error``; the converter (OCR and layout) is a plug-in that must pickle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                try:
                    text, error = converter(row.column("content")[0].as_py()), None
                except Exception as e:  # a bad file is reported and skipped
                    text, error = None, f"{type(e).__name__}: {e}"[:500]
                yield pa.RecordBatch.from_arrays([row.column("path"), pa.array([text], pa.string()), pa.array([error], pa.string())], ["path", "markdown", "error"])

    made = files.select("path", "content").mapInArrow(run, "path string, markdown string, error string")
    return made.select(stem(F.col("path")).alias("stem"), "markdown", "error")


def write_bronze(cleaned: DataFrame, folder: str) -> None:
    """Three tables: texts, quality reports, and entities where there are any. ``cleaned`` has stem, clean, quality, entities."""
    cleaned.select(F.col("stem"), F.col("clean").alias("page_content")).write.mode("overwrite").parquet(f"{folder}/docs")
    cleaned.select("stem", "quality.*").write.mode("overwrite").parquet(f"{folder}/quality")
    cleaned.filter(F.size("entities") > 0).select("stem", "entities").write.mode("overwrite").parquet(f"{folder}/entities")


def count_rows(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(path).count()


def clear_table(spark: SparkSession, path: str, confirmed: bool = False) -> bool:
    """Overwrite with no rows, only if confirmed."""
    if confirmed:
        schema = spark.read.parquet(path).schema
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
    return confirmed
