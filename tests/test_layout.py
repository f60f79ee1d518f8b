import random

import pytest
from pyspark.sql import functions as F

from quillstream.functions import tokens as T
from quillstream.operators import layout as L
from quillstream.sources.segments import ITEM, project_items


def items(spark, rows):
    """rows: (page, str, x, y) with width 6 a sign and a font of 10, or (page, str, x, y, width, font)."""
    full = [(1, r[0], k, r[1], float(r[2]), float(r[3]), float(r[4] if len(r) > 4 else 6 * len(r[1])), float(r[5] if len(r) > 5 else 10)) for k, r in enumerate(rows)]
    return spark.createDataFrame(full, ITEM)


def lines(spark, rows):
    return L.group_lines(items(spark, rows)).orderBy("page", "line_no").collect()


def test_anchor_does_not_drift(spark):
    got = lines(spark, [(1, "a", 0, 100), (1, "b", 50, 98), (1, "c", 0, 96), (1, "d", 0, 93)])
    assert [r.text for r in got] == ["a b", "c", "d"] and [r.gap_before for r in got] == [None, 4.0, 3.0]


def test_against_a_scan(spark):
    rng = random.Random(3)
    rows = [(p, f"w{k}", rng.randint(0, 300), rng.choice([100, 99, 98.5, 97, 96, 94, 93.9, 90, 85])) for p in range(1, 6) for k in range(40)]
    want = []
    for p in range(1, 6):
        anchor, cur = None, []
        for r in sorted(((k, *r) for k, r in enumerate(rows) if r[0] == p), key=lambda r: (-r[4], r[3], r[0])):
            if anchor is None or abs(anchor - r[4]) > 2.5:
                anchor = r[4]
                cur = []
                want.append((p, anchor, cur))
            cur.append(r)
    got = lines(spark, rows)
    assert len(got) == len(want)
    for g, (p, anchor, cur) in zip(got, want, strict=True):
        order = sorted(cur, key=lambda r: r[3])
        assert (g.page, g.y) == (p, anchor) and g.first_item == order[0][0] and g.last_item == order[-1][0]
        assert g.text.replace(" ", "") == "".join(r[2] for r in order)


def test_spaces_and_gaps(spark):
    got = lines(spark, [(1, "ab", 0, 50), (1, "cd", 12.5, 50), (1, "ef", 30, 50), (1, " ", 43, 50, 3), (1, "gh", 46, 50), (1, "   ", 0, 20)])
    assert [r.text for r in got] == ["abcd ef gh"] and got[0].gap_widths == [0.5, 5.5, 3.0] and got[0].last_item_len == 2


def test_raw_items(spark):
    raw = spark.createDataFrame([(1, 1, 0, "ab", [2.0, 0.0, 3.0, 4.0, 7.0, 8.0], None), (1, 1, 1, None, [1.0] * 6, None), (1, 1, 2, "c", [1.0, 0.0, 0.0, 0.0, 1.0, 2.0], 9.0)], "doc_id bigint, page int, item_index int, str string, transform array<double>, width double")
    assert [tuple(r)[2:] for r in project_items(raw).collect()] == [(0, "ab", 7.0, 8.0, 4.0, 5.0), (2, "c", 1.0, 2.0, 9.0, 10.0)]


def test_table_rows_need_a_run(spark):
    row = lambda y: [(1, "a", 0, y), (1, "b", 60, y), (1, "c", 120, y)]
    rows = [*row(500), *row(480), *row(460), (1, "plain text", 0, 440), *row(420), *row(400)]
    got = L.mark_table_rows(L.group_lines(items(spark, rows))).orderBy("line_no").collect()
    assert [r.is_table_row for r in got] == [True] * 3 + [False] * 3


def classify(spark, rows):
    """rows: (text, x, font, y, page)."""
    df = items(spark, [(r[4] if len(r) > 4 else 1, r[0], r[1], r[3], 6 * len(r[0]), r[2]) for r in rows])
    return L.classify_lines(L.mark_table_rows(L.group_lines(df)))


def test_classes(spark):
    body = [("this is a body line that goes on and on without any end", 50, 10, 700 - 12 * k) for k in range(8)]
    body[7] = ("and here it ends.", *body[7][1:])
    more = [
        ("3.2 Related Work", 50, 10, 590), ("Large words", 50, 14, 578), ("It ends here.", 50, 10, 566), ("METHODS AND DATA", 50, 10, 554), ("It ends again.", 50, 10, 542), ("Introduction", 50, 10, 530),
        ("one more body line, with an end.", 50, 10, 518), ("- a bullet", 50, 10, 506), ("1) numbered", 50, 10, 494), ("set far in", 90, 10, 482), ("42", 50, 10, 470), ("12345 is no page", 50, 10, 458),
    ]
    kinds = [r.kind for r in classify(spark, body + more).orderBy("line_no").collect()][8:]
    assert kinds == ["heading", "heading", "paragraph-line", "heading", "paragraph-line", "heading", "paragraph-line", "list-item", "list-item", "paragraph-line", "standalone-short", "paragraph-line"]


def buffered(rows, margin):
    """A straight buffer over (kind, text, x, page, ends)."""
    out, buf, page = [], None, None
    for kind, text, x, p in rows:
        if buf is not None and p != page and buf[-1:] in ".!?":
            out.append(buf)
            buf = None
        page = p
        if kind != "paragraph-line":
            if buf is not None:
                out.append(buf)
            buf = None
            out.append(text)
            continue
        if buf is not None and x > margin + 8 and buf[-1:] in ".!?":
            out.append(buf)
            buf = None
        if buf is None:
            buf = text
        elif len(buf) > 1 and buf[-1] == "-" and "a" <= buf[-2] <= "z":
            buf = buf[:-1] + text
        else:
            buf += " " + text
    return out + ([buf] if buf is not None else [])


def test_paragraphs_against_a_buffer(spark):
    rng = random.Random(4)
    rows = []
    for page in (1, 2, 3, 4):
        for k in range(30):
            rows.append((rng.choice(["circu-", "goes on", "it ends.", "so", "Really?", "- item", "x " * 35]).strip(), rng.choice([50, 50, 50, 70]), 10, 700 - 12 * k, page))
    df = classify(spark, rows)
    seen = [(r.kind, r.text, r.x, r.page) for r in df.orderBy("page", "line_no").collect()]
    margin = df.first().body_margin
    got = [r.t for r in L.assemble(df).orderBy("seq").select(T.plain_text(F.col("tokens")).alias("t")).collect()]
    strip = lambda t: t[2:] if t.startswith("- ") else t
    assert [strip(t) for t in got] == [strip(t) for t in buffered(seen, margin)]


def test_references_end_on_the_first_page(spark):
    rows = [("one line without end", 50, 10, 700, 1), ("two", 50, 10, 688, 1), ("three ends.", 50, 10, 700, 2)]
    got = L.assemble(classify(spark, rows)).collect()
    assert [(r.page, tuple(r.pdf_ref)) for r in got] == [(1, (0, 0, 1, 3))]


@pytest.mark.parametrize("most", [1, None])
def test_page_limit(spark, most):
    rows = [(p, f"Page text {p}.", 50, 700) for p in (1, 2)]
    assert L.extract_segments(items(spark, rows), most).count() == (1 if most else 2)
