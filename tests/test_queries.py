from __future__ import annotations

import pytest

import __spark_entry__ as entry_point
from check_queries import compare, connect
from tallybrook.plans import oracles, registry

QUERIES = registry.QUERIES
SQL = oracles.oracle_sql()
#: Results of the fitted forest, which SQL cannot grow; tests/test_nodetable.py walks its nodes in SQL.
FOREST = {"fraud_model_confusion", "ml_payment_scores", "forest_node_scores"}


@pytest.fixture(scope="module")
def connection(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, connection, sf_dir, name, monkeypatch):
    from tallybrook.operators import model

    monkeypatch.setattr(model, "TREES", 5)
    verdict = compare(spark, connection, sf_dir, name, QUERIES[name], SQL.get(name))
    assert verdict.startswith("rows only" if name in FOREST else "match"), verdict


def test_every_query_but_the_forest_has_its_sql_and_is_an_entry():
    assert set(QUERIES) == set(SQL) | FOREST
    assert set(QUERIES) <= set(entry_point.queries()) and set(SQL) <= set(entry_point.oracle_sql())


def test_entry_returns_rows(spark):
    frame = entry_point.entry(spark)
    assert frame.columns[0] == "summary_date" and frame.count() > 0
