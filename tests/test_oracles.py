"""Every query with an oracle equals it on the smallest tables; the others run with a stable schema."""

from __future__ import annotations

import pytest

import __spark_entry__
from lexloom.plans import catalog
from tests.compare import duck_rows, spark_rows
from tests.conftest import SMALL


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, duck, name):
    assert spark_rows(catalog.QUERIES[name](spark, SMALL)) == duck_rows(duck, catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    df = catalog.QUERIES[name](spark, SMALL)
    assert len(df.collect()) > 0
    assert df.schema == catalog.QUERIES[name](spark, SMALL).schema


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    names = __spark_entry__.queries()
    assert set(catalog.QUERIES) <= set(names)
    assert set(__spark_entry__.oracle_sql()) <= set(names)
