import hashlib
import random

import numpy as np
import pytest

from quillstream.llm import bpe as B
from tests.llm.helpers import awkward, docs

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def coders():
    path = P.path("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    with open(path, encoding="utf-8") as f:
        return path, library, B.WordBpe.load(f.read())


def agree(coders, texts):
    _, library, own = coders
    for text, theirs, ids in zip(texts, library.encode_batch(texts, add_special_tokens=False), own.encode_batch(texts), strict=True):
        assert theirs.ids == list(ids), repr(text[:80])
        assert library.decode(theirs.ids, skip_special_tokens=False) == own.decode(ids), repr(text[:80])


def test_random_texts(coders):
    rng = random.Random(11)
    signs = "abcdefghijklmnopqrstuvwxyz ABCXYZéèßñ'’0123456789 !?.,-_()ΣσςİıſK\n\t 　漢字😀é"
    agree(coders, ["".join(rng.choice(signs) for _ in range(rng.randint(0, 80))) for _ in range(4000)])


def test_special_and_long_texts(coders):
    agree(coders, ["", " ", "<|endoftext|>", "a<|endoftext|>b<|startoftext|>", "<|ENDOFTEXT|>", "it's THEY'LL 'S", "a" * 20_000, "ab" * 20_000, "1" * 500, "x " * 5000, "İİ", "</w> w>"])


def test_all_code_points(coders):
    agree(coders, ["a" + chr(c) + "b1" + chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF])


def test_documents(coders):
    import pyarrow.parquet as pq

    agree(coders, pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist())


def test_pairs_decide_like_merging(coders):
    """Greedy proposals with compatible pairs are what exact merging gives."""
    _, _, own = coders
    rng = random.Random(12)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(1, 14))) for _ in range(3000)]
    learned = own.learn(words)
    for w in words:
        assert learned[w] == own.merge(w)


def test_query_rows(spark, coders):
    path, library, _ = coders
    rows = awkward(random.Random(13))
    got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in B.token_digests(docs(spark, rows), path).collect())
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((str(i), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert got == sorted(want)
    assert B.token_digests(docs(spark, []), path).collect() == []


def test_ids_and_back(spark, coders):
    path, library, _ = coders
    df = docs(spark, [(1, "Hello there, World"), (2, None)])
    out = {r.doc_id: r.text for r in B.decode_ids(B.encode_texts(df, path), path).collect()}
    assert out[1] == library.decode(library.encode("Hello there, World", add_special_tokens=False).ids, skip_special_tokens=False) and out[2] == ""
