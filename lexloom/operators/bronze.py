"""From raw binaries to the bronze layer: conversion, clean-up, quality and entities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.operators import cleanup, profile
from lexloom.sources import files


def bronze_rows(converted: DataFrame) -> DataFrame:
    """``stem, clean, quality, entities`` of ``stem, markdown``."""
    cleaned = cleanup.adaptive_cleanup(converted.select("stem", "markdown"), "markdown")
    scored = profile.quality_report(cleaned, "markdown", "clean")
    scores = [c for c in scored.columns if c not in ("stem", "markdown", "clean")]
    return scored.select("stem", "clean", F.struct(*scores).alias("quality"), profile.entities(F.col("clean")).alias("entities"))


def build_bronze(spark: SparkSession, raw: str, folder: str, converter: Callable[[bytes], str], suffix: str = ".pdf") -> None:
    """All files of ``raw`` into the tables ``converted, docs, quality, entities, failures`` of ``folder``.

    Conversion is the dear step, so it is written before anything reads it; a file that cannot be converted is a row
    of ``failures`` and stops no other.
    """
    files.convert_documents(files.read_binaries(spark, raw, suffix), converter).write.mode("overwrite").parquet(f"{folder}/converted")
    converted = spark.read.parquet(f"{folder}/converted")
    converted.filter(F.col("error").isNotNull()).select("stem", "error").write.mode("overwrite").parquet(f"{folder}/failures")
    files.write_bronze(bronze_rows(converted.filter(F.col("error").isNull())), folder)
