"""The four evaluation metrics on small tables worked out by hand."""

from __future__ import annotations

import pytest

from lexloom.operators import evaluate


def values(df):
    return {r.query_id: pytest.approx(r.value) for r in df.collect()}


def test_context_precision(spark):
    rows = [(1, 1, 1), (1, 2, 0), (1, 3, 1), (2, 1, 0), (2, 2, None), (3, 1, 0), (3, 2, 1)]
    got = values(evaluate.context_precision(spark.createDataFrame(rows, "query_id long, rank int, verdict int")))
    assert {1: (1 + 2 / 3) / 2, 2: 0.0, 3: 0.5} == got


def test_supported_share(spark):
    rows = [(1, 1, 1, False), (1, 1, 2, True), (1, 2, 1, None), (1, 2, 2, False), (2, 1, 1, True), (2, 1, 1, True)]
    told = spark.createDataFrame(rows, "query_id long, statement_id long, context_id long, supported boolean")
    assert {1: 0.5, 2: 1.0} == values(evaluate.supported_share(told, "faithfulness"))


def test_answer_relevancy(spark):
    rows = [(1, [1.0, 0.0], [2.0, 0.0], False), (1, [1.0, 0.0], [1.0, 1.0], None), (2, [1.0, 0.0], [1.0, 0.0], True), (3, [0.0, 0.0], [1.0, 0.0], False), (4, None, [1.0, 0.0], False)]
    told = spark.createDataFrame(rows, "query_id long, question array<float>, generated array<float>, noncommittal boolean")
    assert {1: (1 + 0.5**0.5) / 2, 2: 0.0, 3: 0.0, 4: 0.0} == values(evaluate.answer_relevancy(told))


def test_no_rows(spark):
    empty = spark.createDataFrame([], "query_id long, rank int, verdict int")
    assert evaluate.context_precision(empty).count() == 0
