import random
import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from quillstream.functions.config import Config
from quillstream.operators import cues as C
from quillstream.operators import seek as S
from quillstream.plans import narrate
from tests.test_rules import segments

CFG = Config().punctuationPauses
MS = {m: getattr(CFG, key) for m, key, _ in C.MARKS}
ABBREVIATIONS = set(C.ABBREVIATIONS)


def split(spark, texts, config=CFG):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [[(p.text, p.pause_after_ms) for p in r.p] for r in df.select("k", C.split_text(F.col("t"), config).alias("p")).orderBy("k").collect()]


def scan(text):
    """A straight scan from left to right."""
    text, out, last, i = text.strip(), [], 0, 0
    while i < len(text):
        c, rest = text[i], text[i + 1 :]
        blank = len(rest) - len(rest.lstrip())
        after = rest.lstrip()[:1]
        if c in ".!?" and blank and after and re.match("[A-Z0-9\"'“(]", after):
            run = re.search(r"[A-Za-z.]+$", text[last:i])
            if not (c == "." and run and run.group().lower() in ABBREVIATIONS):
                out.append((text[last : i + 1].strip(), MS[c]))
                last = i + 1 + blank
            i += 1 + blank
        elif c in ",;:" and blank:
            out.append((text[last : i + 1].strip(), MS[c]))
            last = i = i + 1 + blank
        elif c in "([{" and (i == 0 or text[i - 1].isspace()):
            out.append((text[last:i].strip(), MS[c]))
            last, i = i, i + 1
        else:
            i += 1
    out.append((text[last:].strip(), 0))
    return [p for p in out if p[0]]


def test_goldens(spark):
    cases = {
        "Mr. Smith arrived. He left, quickly.": [("Mr. Smith arrived.", 80), ("He left,", 5), ("quickly.", 0)],
        "See Smith(2020) for details": [("See Smith(2020) for details", 0)],
        "It was 3:30 and 1,000 units.": [("It was 3:30 and 1,000 units.", 0)],
        "We use a filter (see below) here.": [("We use a filter", 5), ("(see below) here.", 0)],
        "Is it? (Yes). No.": [("Is it?", 110), ("(Yes).", 80), ("No.", 0)],
        "(alpha) beta": [("(alpha) beta", 0)],
        "The answer is no. Then stop.": [("The answer is no. Then stop.", 0)],
        "  ": [],
    }
    assert split(spark, list(cases)) == list(cases.values())


def test_against_a_scan(spark):
    rng = random.Random(2)
    parts = ["Mr", "no", "e.g", "x", "Ab", "A", "9", ".", "!", "?", ",", ":", ";", " ", "  ", "\n", "(", "[", "{", ")", '"', "fig", "É", "v.s"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 22))) for _ in range(3000)]
    for t, got in zip(texts, split(spark, texts), strict=True):
        assert got == scan(t), repr(t)


def test_long_pieces_are_packed(spark):
    text = " ".join(["word"] * 60) + "! Next"
    (a, b, c), = split(spark, [text])
    assert len(a[0]) <= 280 and a[1] == 0 and b[1] == 100 and c == ("Next", 0)
    assert split(spark, ["x" * 500 + " y"]) == [[("x" * 500, 0), ("y", 0)]]


def test_without_punctuation_pauses(spark):
    off = replace(CFG, enabled=False)
    assert split(spark, ["One. Two, three? four. Five"], off) == [[("One.", 0), ("Two, three? four.", 0), ("Five", 0)]]
    long = "a" * 200 + ", " + "b" * 200
    assert [len(p[0]) for p in split(spark, [long], off)[0]] == [201, 200]


def test_queue(spark):
    df = narrate.cues(segments(spark, [("paragraph", "As shown [12], results hold."), ("heading", "2 Next")]))
    rows = [(r.kind, r.text or r.ms, r.seg_start, r.reason) for r in df.orderBy("cue_index").collect()]
    assert rows == [
        ("speech", "As shown", True, None), ("speech", ",", False, None), ("silence", 5, False, "comma"), ("speech", "results hold.", False, None), ("silence", 120, False, "before-heading"),
        ("speech", "Section 2.", True, None), ("silence", 120, False, "section-number"), ("speech", "Next", False, None),
    ]
    assert [r.cue_index for r in df.orderBy("cue_index").collect()] == list(range(df.count()))


def queue(spark, rows):
    """rows: (page, type, seg_start, text); no text is silence."""
    full = [(1, k, "speech" if t else "silence", t, None if t else 80, p, ty, s, None, None) for k, (p, ty, s, t) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id bigint, cue_index bigint, kind string, text string, ms int, page int, type string, seg_start boolean, debug_tag string, reason string")


def test_seek_page(spark):
    q = queue(spark, [(1, "p", True, "a"), (1, "p", True, "b"), (3, "p", True, "c"), (3, "p", True, "d")])
    probes = spark.createDataFrame([(1, 2), (1, 9), (2, 1)], "doc_id bigint, page int")
    assert {(r.doc_id, r.page): r.cue_index for r in S.seek_page(q, probes).collect()} == {(1, 2): 2, (1, 9): 3, (2, 1): -1}


@pytest.mark.parametrize(("text", "hint", "want"), [("The  QUICK brown fox jumps", 3, 2), ("the quick brown fox jumps", 2, 2), ("the quick brown fox jumps", 1, 0), ("the quick brown fox jumps", None, 0), ("", 1, -1), ("nothing like that at all here", 1, -1), ("the quick brown fox jumps", 9, 0)])
def test_seek_text(spark, text, hint, want):
    q = queue(spark, [(1, "p", True, "the quick brown fox jumps over"), (1, "p", True, "short"), (3, "p", True, "The quick brown fox jumps again")])
    s = spark.createDataFrame([(1, text, hint)], "doc_id bigint, text string, hint_page int")
    assert S.seek_text(q, s).first().cue_index == want


def test_debug_window_and_headings(spark):
    q = queue(spark, [(1, "heading" if k % 5 == 0 else "p", True, f"c{k}" if k % 4 else None) for k in range(14)])
    shown = {r.cue_index: r.debug_text for r in S.debug_windows(q).collect()}
    assert shown[1] == "{pause: unlabeled, 80ms} ▶c1◀ c2 c3 …" and shown[13].startswith("… c5 ") and shown[13].endswith("▶c13◀")
    near = {r.cue_index: (r.previous_heading, r.next_heading) for r in S.heading_neighbours(q).collect()}
    assert near[0] == (None, 5) and near[5] == (0, 10) and near[13] == (10, None)


def test_links_and_preview(spark):
    row = spark.range(1).select(S.passage_link(F.lit("a"), F.lit(2), F.struct(F.lit(1).alias("begin_index"), F.lit(0).alias("begin_offset"), F.lit(3).alias("end_index"), F.lit(4).alias("end_offset"))), S.preview(F.lit("x" * 91)), S.progress(F.lit(1), F.lit(8)), S.progress(F.lit(-1), F.lit(0))).first()
    assert tuple(row) == ("[[a#page=2&selection=1,0,3,4]]", "x" * 89 + "…", 13, 0)


def test_selection_has_no_document_rules(spark):
    rows = spark.createDataFrame([(1, "Page 3 of 9", 4)], "doc_id bigint, text string, hint_page int")
    assert [(r.text, r.page) for r in narrate.narrate_selections(rows).collect()] == [("Page 3 of 9", 4)]


def test_signs_that_the_split_uses_are_kept(spark):
    text = "One\ue000 two.\ue000 Three\ue001\ue002, f\ue001\ue003our. Five\ue000mr. Six"
    plain = text.translate({0xE000: "#", 0xE001: "~", 0xE002: "^", 0xE003: "_"})
    rows = spark.createDataFrame([(0, text), (1, plain)], "k int, t string")
    got = {r.k: [p.text for p in r.p] for r in rows.select("k", C.split_text(F.col("t"), Config().punctuationPauses).alias("p")).collect()}
    assert [p.translate({0xE000: "#", 0xE001: "~", 0xE002: "^", 0xE003: "_"}) for p in got[0]] == got[1] and len(got[1]) > 2
