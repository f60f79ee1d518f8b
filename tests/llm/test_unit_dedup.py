import random

from quillstream.llm import unit_dedup as D
from tests.llm.helpers import docs, words

BLANKS = " \t\r\x0b\x0c"


def sentences(rng, n, size=9):
    return [" ".join(words(rng, size)).capitalize() + rng.choice(".!?") for _ in range(n)]


def corpus(rng):
    passages = [" ".join(sentences(rng, n)) for n in (2, 3, 6)] + [" ".join(words(rng, 40)), "All rights reserved.", "St. Nr. 5."]
    rows = []
    for k in range(40):
        own = sentences(rng, 6)
        at = rng.randrange(6)
        own[at] += rng.choice([" ", "\n", " some words before "]) + rng.choice(passages).replace(" ", rng.choice([" ", " \t"])) + rng.choice([" ", "\n"])
        rows.append((k, " ".join(own) if k % 3 else "\n".join(own).upper()))
    long = passages[2]
    rows += [(None, long), (50, None), (51, ""), (52, long + "\n" + long), (53, "\n".join(passages * 300)), (54, long), (54, long), (55, "é" + passages[3]), (56, "." * 100_000), (57, "...a" * 50_000)]
    return rows


def split(text):
    """Units, sign by sign."""
    out, at, i = [], 0, 0
    while i < len(text):
        if text[i] == "\n":
            i += 1
        elif text[i] in ".!?":
            while i < len(text) and text[i] in ".!?":
                i += 1
            if i < len(text) and text[i] not in BLANKS + "\n":
                continue
            while i < len(text) and text[i] in BLANKS:
                i += 1
            i += i < len(text) and text[i] == "\n"
        else:
            i += 1
            continue
        out.append((at, i))
        at = i
    return [*out, (at, len(text))] if at < len(text) else out


def brute(rows):
    seen = []
    for none, n, t in sorted({(i is None, i or 0, t or "") for i, t in rows}):
        k = 0
        for s, e in split(t):
            parts = t[s:e].replace("\n", " ").translate({ord(c): " " for c in BLANKS}).split(" ")
            parts = [p for p in parts if p]
            if len(parts) >= D.LEAST_WORDS:
                key = "".join(c.lower() if "A" <= c <= "Z" else c for c in " ".join(parts))
                seen.append((key, none, n, s, e, len(parts), k, t))
                k += 1
    first, times = {}, {}
    for key, none, n, s, *_ in sorted(seen):
        first.setdefault(key, (none, n, s))
        times[key] = times.get(key, 0) + 1
    runs, out = [], []
    for x in sorted(seen, key=lambda x: (x[1], x[2], x[7], x[6])):
        goes = first[x[0]] != x[1:4]
        if goes and runs and runs[-1][-1][1:3] == x[1:3] and runs[-1][-1][7] == x[7] and runs[-1][-1][6] == x[6] - 1:
            runs[-1].append(x)
        elif goes:
            runs.append([x])
    for r in runs:
        if sum(x[5] for x in r) >= D.LEAST_RUN:
            out += [("None" if x[1] else str(x[2]), x[3], x[4]) for x in r]
    return sorted(out)


def test_against_brute_force(spark):
    for seed in (6, 9):
        rows = corpus(random.Random(seed))
        got = D.removed_spans(docs(spark, rows)).collect()
        want = brute(rows)
        assert sorted((str(r.doc_id), r.unit_start, r.unit_end) for r in got) == want
        assert len(want) > 100
        source = dict(rows)
        for r in got:
            kept = source[r.keep_id][r.keep_start :]
            unit = D.normalise_unit(source[r.doc_id][r.unit_start : r.unit_end])
            assert len(unit.split(" ")) == r.n_words and D.normalise_unit(kept[: next(D.pieces(kept))[1]]) == unit


def test_units_tile_the_text():
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("ab.!?\n \té") for _ in range(rng.randrange(60)))
        assert list(D.pieces(text)) == split(text)


def test_a_passage_that_starts_and_ends_within_sentences_is_found(spark):
    rng = random.Random(4)
    passage = " ".join(sentences(rng, 7))
    rows = [(k, f"{' '.join(words(rng, 30))} {passage} {' '.join(words(rng, 30))}.") for k in range(3)]
    rows.append((3, " ".join(sentences(rng, 20))))
    notice = "Licensed under the Apache License, Version 2.0."
    rows += [(k, " ".join(sentences(rng, 4)) + "\n" + notice) for k in (4, 5)]
    got = D.removed_spans(docs(spark, rows)).collect()
    assert {r.doc_id for r in got} == {1, 2} and {r.keep_id for r in got} == {0}
    for i in (1, 2):
        gone = sum(r.unit_end - r.unit_start for r in got if r.doc_id == i)
        assert gone >= 0.8 * len(passage)


def test_texts_without_what_goes(spark):
    rows = [r for r in corpus(random.Random(7)) if r[0] != 54]
    out = {(r.doc_id, r.removed_spans): r.text for r in D.remove_repeated_units(docs(spark, rows)).collect()}
    assert len(out) == len(rows)
    source = dict(rows)
    for (i, spans), text in out.items():
        full, parts, at = source[i] or "", [], 0
        for s, e in (map(int, x.split(":")) for x in spans.split(",") if x):
            parts.append(full[at:s])
            at = e
        assert text == "".join(parts) + full[at:]
    assert D.remove_repeated_units(docs(spark, [])).collect() == []
