import random
import re
from fractions import Fraction

import pytest

from quillstream.llm import ngram_join as N
from tests.llm.helpers import awkward, docs, words


def grams(t):
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [grams(t) for _, t in rows]
    n = len(rows)
    link = [[i != j and bool(sets[i]) and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) for j in range(n)] for i in range(n)]
    root = list(range(n))
    for _ in range(n):
        new = [min([root[j] for j in range(n) if link[i][j]] + [root[i]]) for i in range(n)]
        if new == root:
            break
        root = new
    out = []
    for i in range(n):
        ids = [rows[j][0] for j in range(n) if root[j] == root[i] and rows[j][0] is not None]
        out.append((str(rows[i][0]), str(min(ids) if ids and sets[i] else rows[i][0]), sum(link[i])))
    return sorted(out)


def near_copies(rng, groups=6, copies=25):
    rows, k = [], 100
    for _ in range(groups):
        base = words(rng, rng.randint(20, 150))
        for _ in range(copies):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = words(rng, 1)[0]
            rows.append((k, " ".join(w)))
            k += 1
    rng.shuffle(rows)
    return rows + [(k + i, " ".join(words(rng, 80))) for i in range(60)]


@pytest.mark.parametrize(("block", "meetings", "grams_"), [(96, 2, 1 << 16), (5, 2, 1 << 16), (5, 21, 1 << 16), (5, 6, 40)])
def test_against_all_pairs(spark, monkeypatch, block, meetings, grams_):
    """Families alone, buckets alone, and both; sets in classes of sizes."""
    monkeypatch.setattr(N, "BLOCK_ROWS", block)
    monkeypatch.setattr(N, "MEETINGS", meetings)
    monkeypatch.setattr(N, "BLOCK_GRAMS", grams_)
    rng = random.Random(8)
    rows = near_copies(rng) + awkward(rng)
    got = sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in N.similar_texts(docs(spark, rows)).collect())
    assert got == brute(rows)


def test_one_of_each_class_stays(spark):
    rng = random.Random(9)
    rows = near_copies(rng, 3, 10) + awkward(rng)
    out = [(r[0], r[1]) for r in N.drop_similar(docs(spark, rows)).collect()]
    classes = {c for _, c, n in brute(rows) if n}
    singles = sum(1 for _, _, n in brute(rows) if not n)
    assert len(out) == len(classes) + singles
    assert (1, rows[[r[0] for r in rows].index(1)][1]) in out and not any(i == 9 for i, _ in out)


def test_empty_table(spark):
    assert N.similar_texts(docs(spark, [])).collect() == []
    assert N.drop_similar(docs(spark, [])).collect() == []


def test_banding_reaches_its_recall():
    b = N.choose_banding(0.8, 0.9995)
    assert b.candidate(0.8) >= 0.9995 and b.candidate(0.3) < 0.06
    with pytest.raises(ValueError):
        N.choose_banding(0.05, 0.9999, most=16)


def test_threshold_is_exact():
    import numpy as np

    a, b = np.arange(9, dtype=np.uint64), np.arange(1, 10, dtype=np.uint64)  # 8 of 10
    assert N.pair_links([a, b], 1, Fraction(4, 5)).all()
    assert not N.pair_links([a, b], 1, Fraction(81, 100)).any()


def test_recall_of_a_stated_query_set(spark):
    """Links of all documents whose id is divisible by 20, against all documents of a table."""
    table = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id < 3000")
    sets = {r.doc_id: grams(r.text) for r in table.collect()}
    got = {r.doc_id: r.n_links for r in N.similar_texts(table).collect()}
    want = {i: sum(j != i and bool(s) and 5 * len(s & t) >= 4 * len(s | t) for j, t in sets.items()) for i, s in sets.items() if i % 20 == 0}
    assert sum(want.values()) > 10
    assert all(got[i] <= n for i, n in want.items())
    assert sum(got[i] for i in want) >= 0.99 * sum(want.values())


def test_long_texts_in_a_family(spark):
    rng = random.Random(12)
    w = words(rng, 150_000)
    rows = [(k, " ".join([*w[: 75_000 * k], *words(rng, 20), *w[75_000 * k :]])) for k in range(3)] + [(9, " ".join(w[:90_000])), (10, " ".join(w[:100_000]))]
    got = {r.doc_id: (r.class_id, r.n_links) for r in N.similar_texts(docs(spark, rows)).collect()}
    assert got == {0: (0, 2), 1: (0, 2), 2: (0, 2), 9: (9, 1), 10: (9, 1)}
