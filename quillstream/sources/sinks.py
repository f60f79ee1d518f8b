"""Where results go: segments and cues with their nested columns, token streams flat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.operators.rules import token_stream
from quillstream.operators.seek import passage_link


def write_segments(segments: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    segments.write.format(fmt).mode(mode).save(path)


def write_tokens(segments: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """The token stream; a document's tokens are in the order of (seq, sub, pos)."""
    token_stream(segments).write.format(fmt).mode(mode).save(path)


def write_links(cues: DataFrame, base: DataFrame, path: str, fmt: str = "json", mode: str = "errorifexists") -> None:
    """A link to each cue's passage, under the name that base (doc_id, name) gives its document."""
    rows = cues.join(base, "doc_id").select("doc_id", "cue_index", passage_link(F.col("name"), F.col("page"), F.col("pdf_ref")).alias("link"))
    rows.write.format(fmt).mode(mode).save(path)
