"""Replies of models kept in a table before they are used: a job that starts again calls only what is missing.

A reply stands under the digest of model and prompt, so equal prompts are called once, in one job and over all jobs that
share the ledger. Failed calls are recorded as failures and called again by the next job.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.operators import enrich
from lexloom.operators.postings import checked
from lexloom.session import shared_folder, stored
from lexloom.sources.commits import CommitLog, collection, load, read_loads

SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in ("digest", "reply", "error")])


def replies(spark: SparkSession, path: str) -> DataFrame:
    """``digest, reply, error`` of all committed calls; a digest may have several."""
    return read_loads(spark, path, SCHEMA, [r["load"] for r in CommitLog(spark, f"{path}/log").records()])


def call_missing(prompts: DataFrame, path: str, provider: enrich.Provider, parts: int = 8, **how) -> int:
    """Call the model for the prompts (``digest, prompt``) that have no reply yet; the number of calls that were due.

    The prompts are dealt into ``parts`` by digest; the replies of a part are committed before the next part is called.
    A job that dies loses the part it was at, a task that runs again calls its own prompts again.
    """
    spark = prompts.sparkSession
    log = CommitLog(spark, f"{path}/log")
    known = replies(spark, path).filter("error IS NULL").select("digest").distinct()
    due = prompts.groupBy("digest").agg(F.first("prompt").alias("prompt")).join(known, "digest", "left_anti")
    folder = shared_folder(spark)
    due.withColumn("part", F.pmod(F.xxhash64("digest"), F.lit(parts)).cast("int")).write.partitionBy("part").parquet(folder)
    waiting = spark.read.schema("digest string, prompt string, part int").parquet(folder)
    counts = {r["part"]: r["count"] for r in waiting.groupBy("part").count().collect()}  # at most ``parts`` rows
    for part in sorted(counts):
        told = enrich.generate(waiting.filter(F.col("part") == part), "prompt", "reply", provider, **how)
        own = uuid.uuid4().hex
        told.select("digest", "reply", F.col("reply_error").alias("error")).write.parquet(f"{path}/data/load={own}")
        record = {"batch": own, "load": own, "rows": counts[part]}
        while not log.append(record, len(log.records())):
            pass  # another job took the number
    return sum(counts.values())


def generate_once(df: DataFrame, prompt: str, output: str, path: str, provider: enrich.Provider | None = None, parts: int = 8, **how) -> DataFrame:
    """As :func:`lexloom.operators.enrich.generate`, with the replies of the ledger at ``path``, which is filled first.

    Adds ``output`` and ``<output>_error`` (in place of columns of these names). A null prompt is an empty one.
    """
    service, path = provider or enrich.OfflineProvider(), path.rstrip("/")
    text = F.coalesce(F.col(f"`{prompt}`"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(service.name + "\0"), text), 256)
    call_missing(df.select(digest.alias("digest"), text.alias("prompt")), path, service, parts, **how)
    told = replies(df.sparkSession, path).groupBy(F.col("digest").alias("__digest")).agg(F.struct(F.min("reply").alias("reply"), F.max("error").alias("error")).alias("__told"))
    rows = df.withColumn("__digest", digest).drop(output, f"{output}_error").join(told, "__digest", "left")
    failed = F.when(F.col("__told.reply").isNull(), F.col("__told.error"))
    return rows.withColumns({output: F.col("__told.reply"), f"{output}_error": failed}).drop("__digest", "__told")


def enriched(spark: SparkSession, path: str, chunks: T.StructType) -> DataFrame:
    """The chunks of the files that are done, with ``summary, keywords, entities``."""
    facts = T.DataType.fromDDL(enrich.CHUNK_FACTS)
    return collection(spark, f"{path.rstrip('/')}/gold", T.StructType([*chunks.fields, *facts.fields]))


def enrich_files(chunks: DataFrame, path: str, provider: enrich.Provider | None = None, file: str = "source", key: str = "chunk_id", text: str = "page_content", parts: int = 8, **how) -> int:
    """Enrich the files that are not done yet and load those whose chunks all got replies; the number of chunks added.

    A file with a failed call adds nothing; the next run calls for its failed chunks only. A chunk without a file is a
    file by itself. ``chunks`` holds each key once.
    """
    spark, path = chunks.sparkSession, path.rstrip("/")
    named = F.coalesce(F.col(f"`{file}`").cast("string"), F.concat(F.lit("\0"), F.col(f"`{key}`").cast("string")))
    done = enriched(spark, path, chunks.schema).select(named.alias("__file")).distinct()
    waiting = chunks.withColumn("__file", named).join(checked(done), "__file", "left_anti")
    asked = generate_once(waiting.withColumn("__prompt", enrich.chunk_prompt(chunks.columns, text)), "__prompt", "__reply", f"{path}/replies", provider, parts, **how)
    told = stored(enrich.chunk_facts(asked, [*chunks.columns, "__file"]))
    failed = told.filter("enrich_error IS NOT NULL").select("__file").distinct()
    whole = told.join(checked(failed), "__file", "left_anti").drop("__file", "enrich_error")
    return load(whole, f"{path}/gold", uuid.uuid4().hex, key)
