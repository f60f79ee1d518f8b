import math
import random
from collections import Counter, defaultdict
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from quillstream.functions import tokens as T
from quillstream.functions.config import Bracket, Brackets, Config, Substitution
from quillstream.operators import rules as R
from quillstream.plans import catalog, narrate

DEFAULT = Config()


def segments(spark, rows):
    """rows: (type, text) or (type, text, page), one document."""
    full = [(1, k, r[0], r[1], r[2] if len(r) > 2 else 1) for k, r in enumerate(rows)]
    df = spark.createDataFrame(full, "doc_id bigint, seq bigint, type string, text string, page int")
    return df.select("doc_id", "seq", F.lit(0).alias("sub"), "type", F.lit(None).cast("int").alias("level"), "page", F.lit(None).cast(T.PDF_REF).alias("pdf_ref"), F.array(T.text(F.col("text"))).alias("tokens"))


def texts(df):
    return [r.t for r in df.orderBy("seq", "sub").select(T.plain_text(F.col("tokens")).alias("t")).collect()]


def stream(df):
    rows = df.orderBy("seq", "sub").select("tokens").collect()
    return [t.value if t.kind == "text" else (t.ms, t.reason) for r in rows for t in r.tokens]


def test_boilerplate(spark):
    rows = [("paragraph", t) for t in ("42", "12345", " Page 3 of 9 ", "Doing well", "©2020", "copyrighted", "", "  ", "All rights reserved", "http://a.b/c d", "http://a.b/c")]
    assert texts(R.filter_boilerplate(segments(spark, rows), DEFAULT.removeBoilerplate)) == ["12345", "copyrighted", "", "  ", "http://a.b/c d"]
    odd = replace(DEFAULT.removeBoilerplate, patterns=("(", "^x$"))
    assert texts(R.filter_boilerplate(segments(spark, [("p", "X"), ("p", "y")]), odd)) == ["y"]


def test_repeated_lines(spark):
    three = [("p", "HEAD", 1), ("p", "a", 1), ("p", " HEAD", 2), ("p", "b", 3), ("p", "HEAD ", 4)]
    assert texts(R.filter_repeated(segments(spark, three), DEFAULT.removeRepeatedHeadersFooters)) == ["a", "b"]
    assert len(texts(R.filter_repeated(segments(spark, three[:3]), DEFAULT.removeRepeatedHeadersFooters))) == 3
    long = [("p", "x" * 81, 1)] * 9
    assert len(texts(R.filter_repeated(segments(spark, long), DEFAULT.removeRepeatedHeadersFooters))) == 9


def test_repeated_lines_of_a_host_meet_by_sums(spark, small):
    plan = catalog.repeated_lines_by_host(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "collect_set" not in plan
    rng = random.Random(5)
    rows = [(rng.choice([None, 1, 2, 3]), k, rng.choice([None, *range(60)]), rng.choice(["", " ", "x" * 81, *"abcdefgh"]) + rng.choice(["", " "])) for k in range(900)]
    rows += [(4, 900 + k, None, "a") for k in range(3)] + [(5, 910 + k, k, "a") for k in range(2)]
    df = spark.createDataFrame(rows, "doc_id bigint, seq bigint, page int, text string").withColumn("tokens", F.array(T.text(F.col("text"))))
    for fraction in (0.1, 0.3, 0.6, None):
        config = replace(DEFAULT.removeRepeatedHeadersFooters, minRepeatFraction=fraction)
        pages, times = defaultdict(set), Counter((d, t.strip()) for d, _, _, t in rows)
        for d, _, p, _ in rows:
            pages[d] |= {p} - {None}
        least = {d: max(3, math.ceil(max(1, len(p)) * (0.3 if fraction is None else fraction))) for d, p in pages.items()}
        stay = [k for d, k, _, t in rows if not 0 < len(t.strip()) <= 80 or times[d, t.strip()] < least[d]]
        assert len(stay) < len(rows)
        for f in (R.filter_repeated, R.filter_repeated_wide):
            assert sorted(r.seq for r in f(df, config).select("seq").collect()) == stay
        assert R.filter_repeated_wide(df, config).columns == df.columns
    assert R.filter_repeated_wide(df, replace(config, enabled=False)) is df


def test_references(spark):
    on = replace(DEFAULT.stopAtReferences, enabled=True)
    assert texts(R.stop_at_references(segments(spark, [("paragraph", "References"), ("heading", "7. References"), ("heading", " References "), ("paragraph", "x")]), on)) == ["References", "7. References"]


def test_table_runs(spark):
    rows = [("paragraph", "p"), ("table-row", "1"), ("table-row", "2"), ("paragraph", "q"), ("table-row", "3")]
    assert texts(R.collapse_tables(segments(spark, rows), DEFAULT.tables)) == ["p", "table omitted", "q", "table omitted"]
    assert texts(R.collapse_tables(segments(spark, rows), replace(DEFAULT.tables, mode="skip"))) == ["p", "q"]
    assert stream(R.collapse_tables(segments(spark, rows[:2]), replace(DEFAULT.tables, replacement=" "), 70)) == ["p", (70, "table")]
    assert len(texts(R.collapse_tables(segments(spark, rows), replace(DEFAULT.tables, mode="keep")))) == 5


def test_captions(spark):
    rows = [("p", t) for t in ("Table 3 shows results.", "Fig. 2: Setup", "figure 4.2 - Block", "Tables are useful.", "See Figure 3.")]
    assert texts(R.standalone_captions(segments(spark, rows), DEFAULT.figuresAndTables)) == ["Tables are useful.", "See Figure 3."]
    inline = [("p", "as in (see Fig. 3) here"), ("p", "(Figs. 3 and 4)"), ("p", "(Fig. 3.1a)"), ("p", "(fig 1)(Table 2)")]
    assert stream(R.inline_captions(segments(spark, inline), DEFAULT.figuresAndTables)) == ["as in ", "figure omitted", " here", "(Figs. 3 and 4)", "(Fig. 3.1a)", "figure omitted", "figure omitted"]


def direct_spans(text):
    depth, start, out = 0, -1, []
    for i, c in enumerate(text):
        if c == "(":
            if depth == 0:
                start = i
            depth += 1
        elif c == ")" and depth:
            depth -= 1
            if depth == 0:
                out.append(text[start : i + 1])
    return out


def test_spans_against_a_scan(spark):
    rng = random.Random(1)
    cases = ["a (b (c) d) e", "a (b (c) d", "a ) (b)", "", "()", ")(", "x [] y"] + ["".join(rng.choice("ab(()) ") for _ in range(rng.randint(0, 25))) for _ in range(400)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(cases)], "k int, t string")
    parts = R.bracket_parts(F.col("t"), "(", ")")
    rows = df.select("k", F.transform(F.filter(parts, lambda p: p["span"]), lambda p: p["text"]).alias("s"), F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("whole")).collect()
    for r in rows:
        assert r.s == direct_spans(cases[r.k]) and r.whole == cases[r.k], cases[r.k]


def test_brackets(spark):
    assert stream(R.apply_brackets(segments(spark, [("p", "As shown [12], results hold.")]), DEFAULT.brackets)) == ["As shown ", (0, "bracket-square"), ", results hold."]
    assert stream(R.apply_brackets(segments(spark, [("p", "x [] y")]), DEFAULT.brackets)) == ["x ", (0, "bracket-square"), " y"]
    parens = Brackets(parens=Bracket(minWords=4), square=Bracket(enabled=False), curly=Bracket(enabled=False))
    assert stream(R.apply_brackets(segments(spark, [("p", "ok (two words) end"), ("p", "cut (one two three four) (Doe, 2001)")]), parens)) == ["ok ", "(two words)", " end", "cut ", (0, "bracket-parens"), " ", (0, "bracket-parens")]
    kept = Brackets(parens=Bracket(minWords=9))
    assert stream(R.apply_brackets(segments(spark, [("p", "[a (b) c]")]), kept)) == ["[a ", "(b)", " c]"]


def test_headings(spark):
    assert stream(R.normalize_headings(segments(spark, [("heading", "3.2 Related Work"), ("heading", "Plain"), ("paragraph", "1. x")]), DEFAULT.headings)) == ["Section 3.2.", (120, "section-number"), "Related Work", "Plain", "1. x"]
    assert stream(R.normalize_headings(segments(spark, [("heading", "1. Introduction")]), replace(DEFAULT.headings, pauseAfterNumberMs=0)))[1] == (150, "section-number")


def test_substitutions(spark):
    df = R.apply_substitutions(segments(spark, [("p", "e.g. Fig. 3 vs. Eq. 2"), ("p", "10 parsec. away"), ("p", "none")]), DEFAULT.substitutions)
    assert texts(df) == ["for example figure 3 versus equation 2", "10 parsection away", "none"]
    tags = [r.tokens[0].debug_tag for r in df.orderBy("seq").collect()]
    assert tags == ["substituted: e.g.→for example, vs.→versus, fig.→figure, eq.→equation", "substituted: sec.→section", None]
    chain = (Substitution("a", "b"), Substitution("b", "$$c"), Substitution(" ", "x"), Substitution("Q", "q", caseSensitive=True))
    assert texts(R.apply_substitutions(segments(spark, [("p", "a cab Q"), ("p", "q")]), chain)) == ["$c cab q", "q"]


def test_structural_pauses(spark):
    rows = [("heading", "h"), ("heading", "h"), ("paragraph", "p"), ("list-item", "l"), ("list-item", "l"), ("paragraph", "p"), ("heading", "h")]
    marks = [t for t in stream(R.structural_pauses(segments(spark, rows), DEFAULT.structuralPauses)) if isinstance(t, tuple)]
    assert marks == [(80, "after-heading"), (80, "after-heading"), (25, "before-list"), (20, "between-list-items"), (100, "paragraph-gap"), (120, "before-heading")]
    none = replace(DEFAULT.structuralPauses, betweenListItemsMs=0)
    assert R.structural_pauses(segments(spark, rows[3:5]), none).count() == 2


def test_disabled_rules_change_nothing(spark):
    rows = [("heading", "References"), ("table-row", "x"), ("paragraph", "Page 3 of 9"), ("paragraph", "Fig. 3 a (b) [c] e.g. {d}")]
    off = Config(
        removeBoilerplate=replace(DEFAULT.removeBoilerplate, enabled=False), removeRepeatedHeadersFooters=replace(DEFAULT.removeRepeatedHeadersFooters, enabled=False),
        brackets=Brackets(Bracket(enabled=False), Bracket(enabled=False), Bracket(enabled=False)), figuresAndTables=replace(DEFAULT.figuresAndTables, enabled=False),
        tables=replace(DEFAULT.tables, enabled=False), headings=replace(DEFAULT.headings, enabled=False), structuralPauses=replace(DEFAULT.structuralPauses, enabled=False), substitutions=(),
    )
    assert texts(narrate.clean(segments(spark, rows), off)) == [t for _, t in rows]


def test_stream_is_the_segments_flattened(spark):
    rows = [("heading", "1. A"), ("paragraph", "x [1] y e.g. z"), ("list-item", "q")]
    df = segments(spark, rows)
    flat = [r.value if r.kind == "text" else (r.ms, r.reason) for r in narrate.process(df).orderBy("seq", "sub", "pos").collect()]
    assert flat == stream(narrate.clean(df))


@pytest.mark.parametrize(("text", "want"), [("Smith et al., 2020", True), ("12–15", True), ("Müller, 2020", False), ("see Smith, 2020", False), ("12a", False)])
def test_citations(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(F.col("t").rlike(R.CITATION)).first()[0] is want
