"""A corpus pipeline in stages, each written as Parquet and read again as the next one's documents.

A stage's own tables in the shared folder go when the next stage begins, as its result is stored by then.

Rows with a null doc_id, null or empty texts, or of any length pass through all stages like any others:
a null text counts as an empty one, is never toxic or leaked, and is an exact copy of other empty texts.
Of rows that repeat each other one stays. All but the last stage return every column that they were given,
whatever its name; an empty table stays empty. The operators' docstrings have the details.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillstream.llm import bpe, decontam, exact_dedup, ngram_join, toxicity
from quillstream.llm.queries import table, vocabulary
from quillstream.llm.shared import fresh_path, remove, successive


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go."""
    with successive(spark, "pipeline"):
        return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of equal texts stays."""
    with successive(spark, "pipeline"):
        return exact_dedup.drop_exact_copies(docs)


def similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One of each group of near copies stays."""
    with successive(spark, "pipeline"):
        return ngram_join.drop_similar(docs)


def leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    with successive(spark, "pipeline"):
        return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is kept, as digests of its tokens and of the decoded text."""
    with successive(spark, "pipeline"):
        return bpe.token_digests(docs, vocabulary())


STAGES = [
    ("toxicity", toxic),
    ("exact_dedup", exact),
    ("ngram_jaccard", similar),
    ("decontamination", leaked),
    ("bpe", encoded),
]
#: A trained model decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over sf_dir's documents.

    A stage's table goes as soon as the next one's is stored. The last one's is the result; it stays in
    the shared folder until quillstream.llm.shared.cleanup.
    """
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        remove(spark, before)
        docs, before = spark.read.parquet(path), [path]
    return docs
