import re

import pytest
from pyspark.sql import functions as F

from quillstream.functions import rx


def matches(spark, pattern, texts, flags=""):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r.m for r in df.select("k", F.col("t").rlike(flags + pattern).alias("m")).orderBy("k").collect()]


def test_end_anchor_is_the_end(spark):
    assert matches(spark, rx.to_java(r"^\d{1,4}$"), ["12", "12\n", "12345"]) == [True, False, False]


def test_borders_are_ascii(spark):
    assert matches(spark, rx.to_java(r"\bé"), ["café", "é"]) == [True, False]
    assert matches(spark, rx.to_java(r"x\b"), ["xé", "xy", "x"]) == [True, False, True]


def test_white_space_is_wide(spark):
    odd = [f"a{chr(c)}b" for c in (0x20, 0xA0, 0x1680, 0x2003, 0x2028, 0x202F, 0x3000, 0xFEFF, 0x0B)]
    assert all(matches(spark, rx.to_java(r"a\sb"), odd)) and not any(matches(spark, rx.to_java(r"a\Sb"), odd))
    df = spark.createDataFrame([(f"　 \t{t}﻿ ",) for t in ("x y", "")], "t string")
    assert [r[0] for r in df.select(rx.trim(F.col("t"))).collect()] == ["x y", ""]


def test_class_contents_survive(spark):
    assert matches(spark, rx.to_java(r"^[\s\-:,.'&[]+$"), ["- :", "[&", "x"]) == [True, True, False]


def test_bad_patterns_are_skipped(spark):
    assert not rx.is_valid(spark, "(") and rx.is_valid(spark, "a|b")


@pytest.mark.parametrize(("given", "text", "want"), [("$$", "a", "$"), ("[$&]", "a", "[a]"), (r"\1$1", "a", r"\1$1")])
def test_replacements_are_literal(spark, given, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(F.regexp_replace("t", "a", rx.java_replacement(given))).first()[0] == want


def test_escape():
    assert re.fullmatch(rx.escape("a.b*c(d)[e]{f}^$|\\?+"), "a.b*c(d)[e]{f}^$|\\?+")
