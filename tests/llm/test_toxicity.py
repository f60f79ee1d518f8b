import random
import zlib

import numpy as np
import pyarrow as pa

from quillstream.llm import toxicity as T
from tests.llm.helpers import awkward, docs, words


def labelled(spark, rows):
    return spark.createDataFrame([(i, 1, y, 5) for i, y in rows], "doc_id bigint, quality int, toxic int, score int")


def test_pairs_that_no_linear_weights_can_tell():
    """Label 1 where insult and group stand together or neither does."""
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (1200, 2))
    y = (x[:, 0] == x[:, 1]).astype(int)
    sets = [np.unique(np.concatenate([np.flatnonzero(r) * 7 + 5, [99]])).astype(np.int32) for r in x]
    model = T.fit(sets, y)
    assert set(np.flatnonzero(model.place)) == {5, 12}
    rows = [r[r > 0] for r in (model.place[s] for s in sets)]
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    z = model.logits(np.concatenate(rows), owner, len(rows))
    assert ((z > 0) == (y == 1)).mean() > 0.99


def test_held_out_rows_of_the_table(spark):
    d, lab = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    y = {r.doc_id: r.toxic for r in lab.collect()}
    got = T.toxicity_scores(d, lab).collect()
    assert len(got) == d.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    held = [(r.predicted, y[r.doc_id]) for r in got if r.held_out and r.doc_id in y]
    assert np.mean([p == t for p, t in held]) > 0.97
    assert sum(p and not t for p, t in held) <= 0.005 * len(held)


def test_awkward_rows(spark):
    rng = random.Random(18)
    rows = awkward(rng) + [(1000 + k, " ".join(words(rng, 30) + (["grubdast"] if k % 3 == 0 else []))) for k in range(300)]
    labels = [(1000 + k, int(k % 3 == 0)) for k in range(300)] + [(None, 1), (1003, None), (99_999, 1)]
    got = T.toxicity_scores(docs(spark, rows), labelled(spark, labels)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[1000 + k].predicted == (k % 3 == 0) for k in range(300)) and by[5].predicted == 0 and by[5].score == by[4].score
    left = T.drop_toxic(docs(spark, rows), labelled(spark, labels))
    assert left.columns == docs(spark, []).columns and left.count() == len(rows) - 100
    assert T.toxicity_scores(docs(spark, []), labelled(spark, labels)).collect() == []
    alike = T.toxicity_scores(docs(spark, rows[:5]), labelled(spark, [])).collect()
    assert len(alike) == 5 and len({r.score for r in alike}) == 1


def test_terms_that_tell_only_in_pairs_are_learned_with_the_settings_as_they_are():
    """Label 1 where one insult and a group stand together; either alone is as common in both labels."""
    rng = np.random.default_rng(3)
    y = np.arange(1200) % 2
    noise = [rng.choice(np.arange(1000, 3000), 25, replace=False) for _ in y]
    x = np.array([rng.permutation([(1, 1), (0, 0)])[0] if t else rng.permutation([(1, 0), (0, 1)])[0] for t in y])
    sets = [np.unique(np.concatenate([np.flatnonzero(r) * 7 + 5, [99], z])).astype(np.int32) for r, z in zip(x, noise, strict=True)]
    model = T.fit(sets, y)
    assert set(np.flatnonzero(model.place)) == {5, 12}
    rows = [r[r > 0] for r in (model.place[s] for s in sets)]
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    z = model.logits(np.concatenate(rows), owner, len(rows))
    assert ((z > 0) == (y == 1)).mean() > 0.99


def test_scores_by_adding_up_every_pair():
    """The score is the logistic of the bias, the weights and the product of each pair's factors."""
    rng = np.random.default_rng(4)
    place = rng.integers(0, 40, 1 << T.BITS).astype(np.int32)
    model = T.FactorizationMachine(place, -0.3, np.append(0, rng.normal(0, 0.3, 39)), np.concatenate([np.zeros((1, 4)), rng.normal(0, 0.2, (39, 4))]))
    texts = [" ".join(words(random.Random(k), k)) for k in (0, 1, 2, 7, 60)] + ["", "Élan ÉLAN élan", "a" * 5000]
    got = model.score(pa.array(texts))
    for text, score in zip(texts, got, strict=True):
        flat, _ = T.terms(pa.array([text]))
        rows = sorted({int(place[t]) for t in flat} - {0})
        z = model.bias + sum(model.weight[i] for i in rows) + sum(float(model.factor[i] @ model.factor[j]) for i in rows for j in rows if i < j)
        assert abs(score - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-9


def test_a_table_without_texts(spark):
    table = spark.createDataFrame([(1, "x")], "doc_id bigint, other string")
    assert T.drop_toxic(table, labelled(spark, [])).collect() == table.collect()
