"""Small tables with what operators have to bear: nulls, empty and long texts, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id bigint, text string, TEXT string, kept boolean, digest int, n bigint, `__tag` string, Doc_Id string, lang string"


def docs(spark, rows):
    """rows: (doc_id, text)."""
    full = [(i, t, "other", None, k, None, None, "x", None) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def awkward(rng: random.Random) -> list[tuple]:
    """Documents of all sorts."""
    base = " ".join(words(rng, 60))
    return [
        (1, base), (2, base), (2, base), (3, base.replace(" ", "\n")), (None, base), (4, None), (5, ""), (None, None), (6, " \t\n"),
        (7, " ".join(words(rng, 30_000))), (8, "ünï çodé 漢字 😀 " + base), (9, base + " tail"), (10, "x"), (11, "x"), (12, "a b c"), (12, "other text of it"),
    ]
