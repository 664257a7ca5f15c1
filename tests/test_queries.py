"""Every registered query against its SQL on the smallest tables."""

import os
import sys

import duckdb
import pytest

import __spark_entry__ as registry
from duelframe.catalog.oracles import ORACLES
from duelframe.catalog.queries import QUERIES

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
import check_queries  # noqa: E402

SMALL = "/root/testdata/sf0.001"
# Seasons are too short at this size: nobody has five earlier games in three of them.
NEED_MORE = {"model_matrix", "train_and_score", "train_comparison", "predict_coming_matches"}


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for table in check_queries.TABLES:
        connection.execute(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in NEED_MORE])
def test_query_matches_sql(spark, con, name):
    text, _, _, good = check_queries.check(spark, con, SMALL, name, QUERIES[name], ORACLES.get(name))
    assert good, text


def test_entry(spark):
    assert registry.entry(spark).count() == 1500


def test_only_trained_models_lack_sql():
    assert set(QUERIES) - set(ORACLES) == {"train_and_score", "train_comparison", "predict_coming_matches"}
    assert set(QUERIES) <= set(registry.queries())
    assert set(registry.oracle_sql()) <= set(registry.queries())
