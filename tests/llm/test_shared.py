import random

import pytest

from quillstream.llm import shared


def least(edges):
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if a != b and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    return root


@pytest.mark.parametrize("most", [0, 250_000])
def test_components(spark, monkeypatch, most):
    monkeypatch.setattr(shared, "DRIVER_EDGES", most)
    rng, whole = random.Random(3), shared.stage_table
    path = list(range(-40, 40))
    rng.shuffle(path)
    numbers = [*zip(path, path[1:]), *((rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)), (500, 500), (2**62, -(2**62))]
    tables = []
    monkeypatch.setattr(shared, "stage_table", lambda df, name, rows=None: tables.append(name) or whole(df, name, rows))
    for rows in (None, len(numbers)):
        tables.clear()
        found = shared.components(spark.createDataFrame(numbers, "a bigint, b bigint"), rows=rows)
        assert dict(map(tuple, found.collect())) == least(numbers)
        assert most == 0 or len(tables) == 2  # no rounds, of which each writes two tables
    if most:
        texts = [(bytes([a % 256, 7]), bytes([b % 256, 7])) for a, b in numbers]
        found = shared.components(spark.createDataFrame(texts, "a binary, b binary"))
        assert {bytes(k): bytes(v) for k, v in found.collect()} == least(texts)
        assert found.schema.simpleString() == "struct<node:binary,root:binary>"
    assert shared.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []
