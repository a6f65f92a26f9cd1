"""Evaluation data sets, repair of judges' replies, metric means and token usage."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexloom.functions import fixed
from lexloom.functions.text import strip
from lexloom.operators.enrich import Provider, generate, json_text
from lexloom.sources.files import write_text


def dataset(answers: DataFrame, ranked: DataFrame, truths: DataFrame, n_contexts: int = 3, text: str = "page_content") -> DataFrame:
    """``query_id, question, answer, contexts, ground_truth`` with the first ``n_contexts`` texts in rank order."""
    few = ranked.filter(F.col("rank") <= n_contexts).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", F.col(text).alias("t")))).alias("c"))
    contexts = few.select("query_id", F.transform("c", lambda x: x["t"]).alias("contexts"))
    none = F.array().cast("array<string>")
    joined = answers.join(contexts, "query_id", "left").join(truths, "query_id", "left")
    return joined.select("query_id", "question", "answer", F.coalesce("contexts", none).alias("contexts"), "ground_truth")


def verdict(raw: Column) -> Column:
    """1 for true and for numbers of at least a half, else 0."""
    return F.when(F.lower(raw) == "true", 1).when(raw.try_cast("double") >= 0.5, 1).otherwise(0)


def truth(raw: Column) -> Column:
    """True for true and for numbers other than 0."""
    return F.when(F.lower(raw) == "true", True).otherwise(F.coalesce(raw.try_cast("double") != 0, F.lit(False)))


def repaired(reply: Column) -> Column:
    """``ok, verdict, noncommittal, attributed, question`` of a judge's reply; not ok where no JSON can be read."""
    body = json_text(reply)
    at = lambda name: F.get_json_object(body, f"$.{name}")
    return F.struct(
        F.try_parse_json(body).isNotNull().alias("ok"),
        verdict(at("verdict")).alias("verdict"),
        truth(at("noncommittal")).alias("noncommittal"),
        truth(at("Attributed")).alias("attributed"),
        F.coalesce(at("question"), F.lit("")).alias("question"),
    )


def judge(rows: DataFrame, prompt: str, provider: Provider | None = None, calls_per_minute: int | None = fixed.JUDGE_CALLS_PER_MINUTE, tries: int = 1) -> DataFrame:
    """Adds ``judged``, the repaired reply of a judge, and ``judge_error``; the pace holds for the whole job."""
    told = generate(rows, prompt, "__reply", provider, calls_per_minute, tries=tries)
    return told.select(*rows.columns, repaired(F.col("__reply")).alias("judged"), F.col("__reply_error").alias("judge_error"))


def summary(scores: DataFrame, n_samples: int, decimals: int = 6) -> str:
    """JSON of the sample count and each metric's mean; a metric without a number is null."""
    names = scores.select("metric").distinct()
    rows = names.join(metric_means(scores, decimals), "metric", "left").orderBy("metric").collect()  # a row a metric
    return json.dumps({"n_samples": n_samples, "metrics": {r["metric"]: r["mean"] for r in rows}}, ensure_ascii=False, indent=2)


def write_evaluation(samples: DataFrame, scores: DataFrame, folder: str) -> None:
    """The data set as JSON lines in ``dataset`` and the means in ``summary.json``."""
    spark = samples.sparkSession
    samples.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/dataset")
    written = spark.read.schema(samples.schema).json(f"{folder}/dataset").count()
    write_text(spark, f"{folder}/summary.json", summary(scores, written))


def context_precision(verdicts: DataFrame) -> DataFrame:
    """``query_id, metric, value`` from ``query_id, rank, verdict``: the mean, over the useful contexts, of the useful share up to each.

    Nulls count as useless; 0 where no context is useful. A window holds one query's list of contexts.
    """
    useful = F.coalesce(F.col("verdict").cast("double"), F.lit(0.0))
    upto = F.avg("v").over(W.partitionBy("query_id").orderBy("rank").rowsBetween(W.unboundedPreceding, 0))
    rows = verdicts.select("query_id", "rank", useful.alias("v")).withColumn("p", upto)
    value = F.when(F.sum("v") > 0, F.sum(F.col("p") * F.col("v")) / F.sum("v")).otherwise(0.0)
    return rows.groupBy("query_id").agg(value.alias("value")).select("query_id", F.lit("context_precision").alias("metric"), "value")


def supported_share(statements: DataFrame, metric: str) -> DataFrame:
    """``query_id, metric, value`` from ``query_id, statement_id, context_id, supported``: statements that some context supports.

    Over statements of the answer this is ``faithfulness``, over those of the truth ``context_recall``; null is no support.
    """
    told = F.max(F.coalesce(F.col("supported").cast("int"), F.lit(0))).alias("s")
    each = statements.groupBy("query_id", "statement_id").agg(told)
    return each.groupBy("query_id").agg(F.avg("s").alias("value")).select("query_id", F.lit(metric).alias("metric"), "value")


def answer_relevancy(generated: DataFrame) -> DataFrame:
    """``query_id, metric, value`` from ``query_id, question, generated, noncommittal``: mean cosine of both vectors, evasive ones at 0.

    A vector of length 0, or one that is null, has cosine 0.
    """
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)
    length = F.sqrt(dot("question", "question") * dot("generated", "generated"))
    evasive = F.coalesce(F.col("noncommittal").cast("boolean"), F.lit(False))
    cosine = F.when(~evasive & (length > 0), dot("question", "generated") / length).otherwise(0.0)
    return generated.groupBy("query_id").agg(F.avg(cosine).alias("value")).select("query_id", F.lit("answer_relevancy").alias("metric"), "value")


def metric_means(scores: DataFrame, decimals: int = 6) -> DataFrame:
    """``metric, mean, n`` over values that are numbers."""
    fit = scores.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    return fit.groupBy("metric").agg(F.round(F.avg("value"), decimals).alias("mean"), F.count("*").alias("n"))


USAGE_PATHS = {
    "input": ("llm_output.token_usage.prompt_tokens", "llm_output.usage_metadata.input_token_count", "llm_output.usage_metadata.prompt_token_count", "message.usage_metadata.input_tokens", "message.response_metadata.token_usage.prompt_tokens"),
    "output": ("llm_output.token_usage.completion_tokens", "llm_output.usage_metadata.output_token_count", "llm_output.usage_metadata.candidates_token_count", "message.usage_metadata.output_tokens", "message.response_metadata.token_usage.completion_tokens"),
}


def token_usage(responses: DataFrame, body: str = "response") -> DataFrame:
    """Adds ``tokens_in, tokens_out`` from whichever shape a response has, null if it tells neither."""
    told = lambda kind: F.coalesce(*(F.get_json_object(body, f"$.{p}").try_cast("long") for p in USAGE_PATHS[kind]))
    return responses.withColumns({"tokens_in": told("input"), "tokens_out": told("output")})


def usage_summary(responses: DataFrame, by: tuple[str, ...] = ("model", "use_case"), body: str = "response") -> DataFrame:
    told = token_usage(responses, body)
    shown = lambda c: F.coalesce(F.sum(c).cast("string"), F.lit("?"))
    return told.groupBy(*by).agg(F.count("*").alias("calls"), shown("tokens_in").alias("tokens_in"), shown("tokens_out").alias("tokens_out"))


__all__ = ["answer_relevancy", "context_precision", "dataset", "judge", "metric_means", "repaired", "summary", "supported_share", "token_usage", "truth", "usage_summary", "verdict", "write_evaluation"]
