import importlib
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from quillstream.plans import catalog


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert "cue_index" in df.columns and df.limit(5).count() == 5


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in "documents pages conversations events customer".split():
        con.execute(f"create view {name} as select * from '{small}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_against_sql(spark, small, duck, name):
    df = catalog.QUERIES[name](spark, small)
    mine = sorted(map(str, df.select(sorted(df.columns)).collect()))
    table = duck.sql(catalog.ORACLE_SQL[name]).to_arrow_table()
    columns = sorted(table.column_names)
    assert columns == sorted(df.columns)
    from pyspark.sql import Row

    theirs = sorted(str(Row(**dict(zip(columns, r, strict=True)))) for r in zip(*(table.column(c).to_pylist() for c in columns), strict=True))
    assert mine == theirs


def test_the_rest_stands_alone(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("quillstream.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "quillstream.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    monkeypatch.delitem(sys.modules, "__spark_entry__")
    alone = importlib.import_module("__spark_entry__")
    assert set(alone.queries()) == set(catalog.QUERIES) and set(alone.oracle_sql()) <= set(alone.queries())
    monkeypatch.undo()
    sys.modules["__spark_entry__"] = entry
