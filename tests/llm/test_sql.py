"""Queries with a SQL counterpart, on small tables."""

import duckdb
import pytest

from netsift.llm import registry
from tools.check import rows_of

registry.load()
TABLES = ["documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(name, spark):
    folder = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    for table in TABLES:
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    frame = registry.QUERIES[name](spark, folder)
    result = duck.execute(registry.ORACLES[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(frame.columns)
    assert rows_of(frame.columns, frame.collect()) == rows_of(columns, result.fetchall())


def test_all_operators():
    assert {name.split("_")[0] for name in registry.QUERIES} == {f"op{k}" for k in range(1, 14)}
