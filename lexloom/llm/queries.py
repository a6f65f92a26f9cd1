"""The registered queries of the training-data operators and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexloom.llm import bpe, chat, clustering, html_extract, infill, langid, line_dedup, media, minhash, mixing, quality_rules, simhash, warc
from lexloom.session import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(table(spark, sf_dir, "pages"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(table(spark, sf_dir, "conversations"))


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.digest(table(spark, sf_dir, "pages"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.digest(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.digest(table(spark, sf_dir, "documents"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(table(spark, sf_dir, "documents"))


def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.digest(table(spark, sf_dir, "embeddings"))


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digest(table(spark, sf_dir, "documents"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_chat": op2_chat,
    "op3_html": op3_html,
    "op4_langid": op4_langid,
    "op5_bpe": op5_bpe,
    "op6_quality_rules": op6_quality_rules,
    "op7_media": op7_media,
    "op8_mixing": op8_mixing,
    "op9_simhash": op9_simhash,
    "op10_line_dedup": op10_line_dedup,
    "op11_clustering": op11_clustering,
    "op12_infill": op12_infill,
    "op13_minhash": op13_minhash,
}

ORACLES: dict[str, str] = {
    "op1_warc": warc.ORACLE,
    "op2_chat": chat.ORACLE,
    "op6_quality_rules": quality_rules.oracle(),
    "op10_line_dedup": line_dedup.ORACLE,
    "op11_clustering": clustering.oracle(),
    "op12_infill": infill.ORACLE,
    "op13_minhash": minhash.ORACLE,
}
