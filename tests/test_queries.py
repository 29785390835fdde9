"""Every registered query against its SQL oracle in DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from tests.conftest import DATA

FOLDER = f"{DATA}/sf0.001"
QUERIES, ORACLES = dict(entry_points.QUERIES), dict(entry_points.ORACLES)
WITHOUT_ORACLE = {"kmeans_train"}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in os.listdir(FOLDER):
        table = name.removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{name}'")
    return connection


def rows(table):
    names = sorted(table.column_names)
    return names, sorted(map(repr, zip(*[table.column(n).to_pylist() for n in names])))


def test_all_queries_have_an_oracle_but_one():
    assert QUERIES.keys() - ORACLES.keys() == WITHOUT_ORACLE
    assert not ORACLES.keys() - QUERIES.keys()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_oracle(spark, duck, name):
    got = QUERIES[name](spark, FOLDER).toArrow()
    assert rows(got) == rows(duck.sql(ORACLES[name]).to_arrow_table())


def test_queries_without_oracle(spark):
    trained = QUERIES["kmeans_train"](spark, FOLDER).collect()
    gallery = QUERIES["gallery_scan"](spark, FOLDER).count()
    assert len(trained) <= 8 and sum(r["n"] for r in trained) == gallery


def test_entry(spark):
    result = entry_points.entry(spark)
    assert result.columns == ["query_id", "rank", "speaker_id", "score"] and result.count() > 0
