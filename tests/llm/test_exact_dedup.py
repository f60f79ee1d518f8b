import hashlib
import random
from collections import defaultdict

import pyarrow as pa
import pytest

from quillstream.llm import exact_dedup as E
from tests.llm.helpers import awkward, docs


def norm(t):
    return "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")


@pytest.mark.parametrize("capacity", [1 << 20, 300])
def test_groups_by_brute_force(spark, capacity):
    rows = awkward(random.Random(2))
    got = E.exact_groups(docs(spark, rows), capacity).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append((-len(t or ""), i is None, i or 0, i))
    expected = sorted((str(i), str(min(groups[norm(t)])[3]), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == expected
    kept = defaultdict(int)
    for r in got:
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}


def test_drop_keeps_columns_and_one_of_each(spark):
    rows = awkward(random.Random(3))
    df = docs(spark, rows)
    out = E.drop_exact_copies(df)
    assert out.columns == df.columns
    texts = [r[1] for r in out.collect()]
    assert len(texts) == len({norm(t) for _, t in rows}) and {norm(t) for t in texts} == {norm(t) for _, t in rows}


def test_empty_table(spark):
    assert E.exact_groups(docs(spark, [])).collect() == []
    assert E.drop_exact_copies(docs(spark, [])).collect() == []


def test_directory_doubles_and_splits_only_what_is_full(spark):
    keys = [(int.from_bytes(hashlib.sha256(str(i).encode()).digest()[:8], "big", signed=True), 10) for i in range(500)]
    keys += [(5 << 40 | i << 20, 10) for i in range(200)]  # a dense corner
    directory = E.build_directory(spark.createDataFrame(keys, "key bigint, n_bytes bigint"), capacity=100, bits=4)
    assert directory.depth > 20 and max(directory.buckets.values()) <= 100
    assert sum(directory.buckets.values()) == 7000
    assert sum(2.0**-d for _, d in directory.buckets) == 1.0
    assert list(directory.bounds()) == sorted(set(directory.bounds()))


def test_equal_keys_are_chained_by_bytes():
    batch = pa.RecordBatch.from_pydict({"bucket": pa.array([0] * 5, pa.int32()), "key": [7] * 4 + [8], "ref": [1, 2, 3, 4, 5], "body": [b"1", b"2", b"1", b"3", b"1"]})
    rows = pa.Table.from_batches(E.chain([batch])).to_pylist()
    assert [(r["ref"], r["slot"], r["first"]) for r in rows] == [(1, 0, 1), (2, 1, 2), (3, 0, 1), (4, 2, 4), (5, 0, 5)]


def few(text):
    """Digests that many texts share."""
    return b"collide" + bytes([len(text) % 2])


@pytest.mark.parametrize("hot", [1, 512])
@pytest.mark.parametrize("digest", [few, E.sha256])
def test_bytes_decide_where_digests_collide(spark, digest, hot):
    rng = random.Random(5)
    rows = [(k, f"text {rng.randrange(30)}" + " " * rng.randrange(3)) for k in range(400)] + awkward(rng)
    table = docs(spark, rows).repartition(9)
    got = E.exact_groups(table, 300, digest, hot).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append((-len(t or ""), i is None, i or 0, i))
    expected = sorted((str(i), str(min(groups[norm(t)])[3]), len(groups[norm(t)])) for i, t in rows)
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size) for r in got) == expected
    assert sum(r.kept for r in got) == len(groups)
    assert E.drop_exact_copies(table, 300, digest, hot).count() == len(groups)


def test_groups_come_from_the_index(spark, monkeypatch):
    whole = E.build_index(docs(spark, [(1, "a"), (2, "b"), (3, "a")]))
    lost = (*whole[:2], whole[2].limit(1))
    monkeypatch.setattr(E, "build_index", lambda *_: lost)
    assert E.exact_groups(docs(spark, [])).count() in (1, 2)
