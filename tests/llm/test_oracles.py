"""Queries of the training-data operators against their SQL, and the rest on whole tables."""

import pytest

from gymlake.llm import catalogue
from tests.oracle import SF, compare, connect


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, name):
    compare(spark, connect(), catalogue.QUERIES[name], catalogue.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_covers_its_table(spark, name):
    table, key = ("pages", "page_id") if name.startswith("op3_") else ("documents", "doc_id")
    whole = spark.read.parquet(f"{SF}/{table}.parquet").select(key)
    got = catalogue.QUERIES[name](spark, SF)
    assert whole.join(got.select(key), key, "left_anti").count() == 0 and got.count() >= whole.count()
