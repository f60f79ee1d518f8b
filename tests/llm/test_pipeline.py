"""The pipeline against its stages by brute force, over the smallest tables."""

import random

import corpus_pipeline
from quillstream.llm import toxicity
from tests.llm.helpers import awkward
from tests.llm.test_exact_dedup import norm
from tests.llm.test_ngram_join import brute


def test_rows_of_the_last_stage(spark, small):
    d, labels, bench = (spark.read.parquet(f"{small}/{n}.parquet") for n in ("documents", "labels", "benchmark"))
    bad = {r.doc_id for r in toxicity.toxicity_scores(d, labels).collect() if r.predicted}
    rows = [(r.doc_id, r.text) for r in d.collect() if r.doc_id not in bad]
    best = {}
    for i, t in rows:
        best[norm(t)] = min(best.get(norm(t), (1, 0)), (-len(t), i))
    rows = [(i, t) for i, t in rows if best[norm(t)][1] == i]
    stay = {c for _, c, _ in brute(rows)}
    rows = [(i, t) for i, t in rows if str(i) in stay]
    items = [r.text for r in bench.collect()]
    rows = [(i, t) for i, t in rows if not any(x in t for x in items)]
    out = corpus_pipeline.run(spark, small)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(r.doc_id for r in out.collect()) == sorted(i for i, _ in rows)


def test_stages_return_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, small).columns == docs.columns
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, small).count() == 0, name


def test_stages_bear_awkward_tables(spark, small, tmp_path):
    rows = awkward(random.Random(19))
    schema = "kept boolean, doc_id bigint, digest int, text string, n bigint, tag string, root int, held_out int, lang string, source string, n_chars bigint, family int"
    docs = spark.createDataFrame([(None, i, k, t, None, "x", 1, None, None, "s", None, 0) for k, (i, t) in enumerate(rows)], schema)
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, small).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert k == 4 or docs.columns == names
    # 1, 2, 2, 3 and a null id hold one text, 8 and 9 nearly that; 6 is the longest of the blank ones; 10 and 11 are alike
    assert sorted(str(r.doc_id) for r in docs.collect()) == sorted(["1", "6", "7", "10", "12", "12"])
