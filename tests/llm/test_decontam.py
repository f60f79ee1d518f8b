import random

import pyarrow as pa

from quillstream.llm import decontam as D
from tests.llm.helpers import awkward, docs, words


def bench(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "item_id bigint, text string, TEXT string, tag int")


def test_items_are_found_whole_and_reparameterised(spark):
    rng = random.Random(17)
    items = [(k, " ".join(words(rng, 30)).capitalize() + ".") for k in range(12)]
    items += [
        (20, "A train leaves from the station in Boston at 9 and travels 120 km before it meets Alice who walked 5 km from Boston, how far is it"),
        (21, None), (22, ""), (23, "too short"), (24, "exactly six little words stand here"),
    ]
    other = items[12][1].replace("Boston", "Berlin").replace("120", "75").replace("Alice", "Maria").replace("km", "miles")
    mixed = items[12][1].replace("Boston at", "Berlin at")  # one name, two values: slots clash
    rows = awkward(rng) + [
        (30, " ".join(words(rng, 40)) + " " + items[3][1] + " " + " ".join(words(rng, 40))), (31, other), (32, mixed), (33, " ".join(items[4][1].split()[:10])),
        (34, items[5][1] + "\n" + items[6][1]), (35, "1 2 3 4 5 6 7 8 9 10 11 12 13"), (None, items[7][1]), (36, " ".join(words(rng, 9000)) + " " + items[8][1]),
        (37, "well exactly six little words stand here then"), (38, " ".join(words(rng, 60))), (39, items[9][1]), (39, items[9][1]), (40, items[10][1].upper()),
    ]
    got = {(r.doc_id, r.item_id) for r in D.contaminated(docs(spark, rows), bench(spark, items)).collect()}
    assert got == {(30, 3), (31, 20), (34, 5), (34, 6), (None, 7), (36, 8), (37, 24), (39, 9)} | ({(40, 10)} & got)
    left = D.drop_contaminated(docs(spark, rows), bench(spark, items))
    assert left.columns == docs(spark, []).columns
    gone = {i for i, _ in got}
    assert sorted(str(r[0]) for r in left.collect() if r[0] is not None) == sorted(str(i) for i, _ in rows if i is not None and i not in gone)
    assert sum(r[0] is None for r in left.collect()) == 2  # one of three null ids holds an item


def test_empty_tables(spark):
    assert D.contaminated(docs(spark, []), bench(spark, [(1, "a b c d e f g h i j k l")])).collect() == []
    assert D.contaminated(docs(spark, [(1, "a b c d e f g h i j k l")]), bench(spark, [])).collect() == []


def test_template_types():
    t, h, typed, at = D.template(pa.array(["The train took 3.5 km to Paris. We saw 1,200 km", "km is a unit"]))
    kinds = {int(D.NUM): "N", int(D.NAME): "M", int(D.UNIT): "U"}
    assert "".join(kinds.get(int(x), ".") for x in t) == "...NU.M..NU...."
    assert list(at) == [0, 11, 15] and typed.sum() == 5


def test_documents_against_search_for_whole_items(spark, small):
    d, b = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in D.contaminated(d, b).collect()}
    items, texts = b.collect(), d.collect()
    want = {(x.doc_id, i.item_id) for x in texts for i in items if i.text in x.text}
    assert want and want <= got and len(got - want) <= 2


def test_words_inserted_or_left_out_and_names_of_other_length(spark):
    rng = random.Random(23)
    long = words(rng, 40)
    middle, thirds, less = list(long), list(long), list(long)
    middle.insert(20, "inserted")
    thirds.insert(14, "inserted")
    thirds.insert(28, "again")
    del less[20]
    short = words(rng, 20)
    shifted = [*short[:10], "inserted", *short[10:]]
    story = "Alice has {} in her bag and goes to the market by the river. Alice buys {} more for the feast. Then Alice gives some of it to her brother before the sun is down"
    items = [(1, " ".join(long)), (2, story.format(12, 5)), (3, " ".join(short))]
    other = story.format(7, 9).replace("Alice", "Mary Ann")
    rows = [(10, " ".join(middle)), (11, " ".join(thirds)), (12, "Before it. " + other), (13, " ".join(less)), (14, other.replace("Alice", "Maria")), (15, " ".join(shifted))]
    rows += [(16, " ".join(long[20:] + long[:20]))]
    got = {(r.doc_id, r.item_id) for r in D.contaminated(docs(spark, rows), bench(spark, items)).collect()}
    assert got == {(10, 1), (11, 1), (12, 2), (13, 1), (14, 2), (15, 3)}


def test_whole_copies_in_any_case(spark):
    rng = random.Random(29)
    text = " ".join(words(rng, 30)).capitalize() + "."
    items = [(10, text), (11, "What is 12 times 30"), (12, "Frobnicate zygotes"), (13, "12 3 45 6 78 9 10 11 12 13 14 and 15"), (14, "quux"), (15, "Čtyři žlutí ŽÁCI šli domů přes řeku a les")]
    rows = [(40, text.upper()), (41, "Q: what IS 12 times 30? Nobody knows"), (42, "they FROBNICATE\nzygotes, frobnicate zygotes"), (43, "x " + items[3][1] + " y"), (44, "a Quux b")]
    rows += [(45, items[5][1].upper()), (46, "What is 13 times 30"), (47, text.upper().rsplit(" ", 1)[0]), (48, "quuxes frobnicate"), (49, text.title())]
    got = {(r.doc_id, r.item_id) for r in D.contaminated(docs(spark, rows), bench(spark, items)).collect()}
    assert got == {(40, 10), (41, 11), (42, 12), (43, 13), (44, 14), (45, 15), (49, 10)}


def test_a_number_with_two_roles_and_names_that_fall_together(spark):
    story = "Yesterday {a} bought {x} apples for {y} dollars from a farmer while {b} only looked at them and then {a} walked home with {b} along the old road"
    items = [(1, story.format(a="Alice", b="Robert", x=3, y=3))]
    rows = [(1, story.format(a="Maria", b="Peter", x=5, y=7)), (2, story.format(a="Maria", b="Maria", x=5, y=7)), (3, story.format(a="Robert", b="Alice", x=3, y=3))]
    got = {r.doc_id for r in D.contaminated(docs(spark, rows), bench(spark, items)).collect()}
    assert got == {1, 3}


def brute(texts, items):
    """Pairs that one diagonal or a chain of them makes up, each item's windows compared with each text's one by one."""
    found = set()
    for wide in (False, True):
        def read(text, wide=wide):
            t, value, typed, _ = D.template(pa.array([text]), wide)
            return t.tolist(), value, typed, D.roles(t, value)

        def places(t, typed):
            return [p for p in range(len(t) - D.SIZE + 1) if D.SIZE - sum(typed[p : p + D.SIZE]) >= D.LEAST_LITERALS]

        for item_id, item in items:
            it, _, ityped, role = read(item)
            own = places(it, ityped)
            for doc_id, text in texts:
                t, value, typed, _ = read(text)
                points = []
                for p in own:
                    ahead = sum(1 << (i - 1) for i in range(1, D.SIZE) if p + i in own)
                    for q in places(t, typed):
                        if it[p : p + D.SIZE] == t[q : q + D.SIZE]:
                            slot = [j for j in range(D.SIZE) if ityped[p + j]]
                            points.append((p, q, D.SIZE, ahead, [int(role[p + j]) for j in slot], [int(value[q + j]) for j in slot]))
                lines = {}
                for x in points:
                    lines.setdefault(x[1] - x[0], []).append(x)
                for line in lines.values():
                    pairs = {(a, b) for x in line for a, b in zip(x[4], x[5], strict=True)}
                    clash = len({a for a, _ in pairs}) < len(pairs) or len({b for a, b in pairs if a % 2 == 0}) < sum(a % 2 == 0 for a, _ in pairs)
                    if not clash and len({x[0] for x in line}) >= D.COVER * len(own):
                        found.add((doc_id, item_id))
                if points and D.chained(points) >= D.COVER * len(own):
                    found.add((doc_id, item_id))
    return found


def test_alignments_by_brute_force(spark):
    rng = random.Random(31)
    names, units = ["Alice", "Robert", "Boston", "New York", "Maria Ann"], ["km", "miles", "dollars", "kg"]

    def fill(shape, stable):
        bind = {}
        pick = lambda key, xs: bind.setdefault(key, rng.choice(xs)) if stable else rng.choice(xs)
        return " ".join(pick(w, names) if w[0] == "N" else pick(w, [str(n) for n in range(2, 60)]) if w[0] == "V" else pick(w, units) if w[0] == "U" else w for w in shape)

    shapes = []
    for _ in range(12):
        shape = words(rng, rng.randint(24, 40))
        for k in range(rng.randint(2, 6)):
            shape.insert(rng.randint(1, len(shape)), rng.choice([f"N{k % 3}", f"V{k % 2}"]))
        shapes.append(shape)
    items = [(k, fill(s, True)) for k, s in enumerate(shapes)]
    rows = []
    for k in range(60):
        shape = list(rng.choice(shapes))
        cut = rng.choice([0, 0, 5, len(shape) // 2, len(shape) - 9])
        rows.append((k, " ".join([*words(rng, rng.randint(0, 9)), fill(shape[cut:], rng.random() < 0.6), *words(rng, rng.randint(0, 9))])))
    got = {(r.doc_id, r.item_id) for r in D.contaminated(docs(spark, rows), bench(spark, items)).collect()}
    assert got == brute(rows, items) and len(got) > 15
