"""Every query with SQL against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from tintworks.oracles import oracles
from tintworks.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def rows_of(frame: pd.DataFrame):
    cell = lambda v: None if v is None or v is pd.NA or isinstance(v, float) and math.isnan(v) else float(v) + 0.0 if isinstance(v, float) else str(v)
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(map(cell, r)) for r in frame.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(oracles()))
def test_query_equals_sql(spark, sf, duck, name):
    ours, theirs = QUERIES[name](spark, sf).toPandas(), duck.execute(oracles()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)


def test_every_query_is_listed():
    from __spark_entry__ import oracle_sql, queries

    assert set(QUERIES) <= set(queries()) and set(oracles()) <= set(oracle_sql())
    assert set(oracle_sql()) <= set(queries())


def test_engine_does_not_import_the_optional_part():
    root = os.path.join(os.path.dirname(__file__), "..", "tintworks")
    for folder, _, files in os.walk(root):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    assert "llm" not in open(os.path.join(folder, f)).read()
