from dataclasses import replace

from quillstream.functions.config import Config
from quillstream.plans import narrate
from quillstream.sources import segments as X
from quillstream.sources import sinks
from tests.test_rules import segments


def test_cache_is_keyed_by_settings(spark):
    cache, df = narrate.CueCache(), segments(spark, [("paragraph", "One. Two.")])
    first = cache.get("a", df)
    assert cache.get("a", df, Config()) is first and first.is_cached
    other = cache.get("a", df, replace(Config(), debugMode=True))
    assert other is not first and not first.is_cached
    cache.drop("a")
    assert not other.is_cached


def test_sinks_round_trip(spark, tmp_path):
    df = narrate.clean(segments(spark, [("heading", "1. A"), ("paragraph", "x [1] y e.g. z")]))
    sinks.write_segments(df, str(tmp_path / "s"))
    again = spark.read.parquet(str(tmp_path / "s"))
    assert again.schema.simpleString() == df.schema.simpleString() and sorted(map(str, again.collect())) == sorted(map(str, df.collect()))
    sinks.write_tokens(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == sum(len(r.tokens) for r in df.collect())
    names = spark.createDataFrame([(1, "paper")], "doc_id bigint, name string")
    sinks.write_links(narrate.cues(df), names, str(tmp_path / "l"))
    assert spark.read.json(str(tmp_path / "l")).first().link == "[[paper#page=1]]"


def test_cleaning_a_text_table_takes_one_exchange(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    plan = narrate.clean(X.decorated_segments(docs))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan
    plan = narrate.cues(X.decorated_segments(docs))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_page_limit_and_columns_reach_the_scan(spark, tmp_path):
    rows = X.line_items(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    rows.write.parquet(str(tmp_path / "items"))
    df = X.read_items(spark, str(tmp_path / "items"), max_pages=2)
    plan = df.select("doc_id", "str")._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(page,2)" in plan and "font_size" not in plan.split("ReadSchema")[1]
