"""Substring deduplication by hashed lines and sentences.

Texts are cut into units at line feeds and at sentence ends; units tile the text.
Each one is normalised and digested, digests are grouped over the whole corpus and the
earliest occurrence by (doc_id, offset) stays. Later ones go where they stand in a
run of repeated units that is long enough to be a passage, with their places in the
original text on record.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstream.llm.kernels import slices, texts_of, tidy
from quillstream.llm.shared import project, same, stage_table, text_tag

#: Words of a unit, at least; shorter ones neither go nor interrupt a run.
LEAST_WORDS = 2
#: Words of a run of repeated units, at least. What is shorter stays, however often it occurs: headings, signatures and licence notes are no passages.
LEAST_RUN = 25
_BLANK = re.compile(r"[ \t\r\x0b\x0c\n]+")
#: A unit ends after a line feed, or after stops that blanks follow, which it takes along.
_END = re.compile(r"(?<![.!?])[.!?]++(?:[ \t\r\x0b\x0c]++\n?|\n|\Z)|\n")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(_UPPER, _LOWER)


def normalise_unit(unit: str) -> str:
    """Blanks become one space, none at the ends; A-Z become a-z."""
    return _BLANK.sub(" ", unit).strip(" ").translate(_FOLD)


def pieces(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of all units, which tile the text."""
    at = 0
    for m in _END.finditer(text):
        yield at, m.end()
        at = m.end()
    if at < len(text):
        yield at, len(text)


def units(text: str, least_words: int) -> Iterator[tuple[int, int, int, str]]:
    """(start, end, words, normalised text) of the units that have enough words; offsets in code points."""
    for start, end in pieces(text):
        norm = normalise_unit(text[start:end])
        n = norm.count(" ") + 1
        if norm and n >= least_words:
            yield start, end, n, norm


def unit_table(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, tag, unit_no, unit_start, unit_end, n_words, digest) of all units of enough words, numbered from 0 in each text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in slices(batch.column("text")):
                ids, tags = (batch.column(c).slice(at, len(part)) for c in ("doc_id", "tag"))
                row: list[int] = []
                found: list[tuple] = []
                for k, text in enumerate(part.to_pylist()):
                    for i, (start, end, n, norm) in enumerate(units(text, least_words)):
                        row.append(k)
                        found.append((i, start, end, n, hashlib.blake2b(norm.encode(), digest_size=16).digest()))
                if found:
                    take = pa.array(row, pa.int64())
                    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(take), tags.take(take), *[pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)]],
                        ["doc_id", "tag", "unit_no", "unit_start", "unit_end", "n_words", "digest"],
                    )

    rows = project(docs, doc_id="bigint", text="string").withColumn("tag", text_tag("text"))
    return rows.mapInArrow(tidy(run), "doc_id bigint, tag bigint, unit_no int, unit_start bigint, unit_end bigint, n_words bigint, digest binary")


def repeated_units(docs: DataFrame, least_words: int = LEAST_WORDS, least_run: int = LEAST_RUN) -> DataFrame:
    """Rows (doc_id, tag, unit_start, unit_end, n_words, keep_id, keep_start), one for each removed occurrence.

    Of units that are equal after normalise_unit and have `least_words` words at
    least, the one with the least (doc_id, start) stays, a null doc_id coming last.
    The others go where they and their repeated neighbours, none of which is a first
    occurrence, have `least_run` words together. Rows that repeat doc_id and text are
    one document. Null and empty texts have no units; long texts are read whole; an
    empty table gives no rows. Offsets count code points of the original text, the
    end is exclusive.
    """
    rows = stage_table(unit_table(docs, least_words), "units")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "unit_start")
    first = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("f")).where("n > 1")
    first = stage_table(first.select("digest", F.col("f.doc_id").alias("keep_id"), F.col("f.unit_start").alias("keep_start")), "unit-first")
    stays = same(F.col("doc_id"), F.col("keep_id")) & (F.col("unit_start") == F.col("keep_start"))
    later = rows.join(first, "digest").where(~stays).drop("digest").distinct()
    # numbers that run on without a gap are one run; a document's repeated units alone meet here
    ordered = Window.partitionBy("doc_id", "tag").orderBy("unit_no")
    later = later.withColumn("run", F.col("unit_no") - F.row_number().over(ordered))
    later = later.withColumn("run_words", F.sum("n_words").over(Window.partitionBy("doc_id", "tag", "run")))
    return later.where(F.col("run_words") >= least_run).select("doc_id", "tag", "unit_start", "unit_end", "n_words", "keep_id", "keep_start")


def removed_spans(docs: DataFrame, least_words: int = LEAST_WORDS, least_run: int = LEAST_RUN) -> DataFrame:
    """The removed occurrences, as the query returns them."""
    return repeated_units(docs, least_words, least_run).drop("tag")


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without the units at `spans`."""
    out, at = [], 0
    for start, end in sorted(set(spans)):
        out.append(text[at:start])
        at = end
    out.append(text[at:])
    return "".join(out)


def remove_repeated_units(docs: DataFrame, least_words: int = LEAST_WORDS, least_run: int = LEAST_RUN) -> DataFrame:
    """Rows (doc_id, text, removed_spans): each document without the units that go,
    and where they stood, as start:end joined by commas, empty where nothing goes.

    Which ones go, and what nulls, ties and repeated rows give, is said at repeated_units;
    a null text becomes an empty one, repeated rows are all returned, an empty table stays empty.
    """
    gone = repeated_units(docs, least_words, least_run).groupBy("doc_id", "tag").agg(F.sort_array(F.collect_set(F.struct("unit_start", "unit_end"))).alias("spans"))
    gone = gone.select(F.col("doc_id").alias("__id"), F.col("tag").alias("__tag"), "spans")
    rows = project(docs, doc_id="bigint", text="string").withColumn("tag", text_tag("text"))
    rows = rows.join(gone, same(F.col("doc_id"), F.col("__id")) & (F.col("tag") == F.col("__tag")), "left").select("doc_id", "text", "spans")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = texts_of(batch.column("text")).to_pylist()
            spans = [[(s["unit_start"], s["unit_end"]) for s in x or ()] for x in batch.column("spans").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([cut(t, s) for t, s in zip(texts, spans, strict=True)], pa.string()),
                    pa.array([",".join(f"{a}:{b}" for a, b in s) for s in spans], pa.string()),
                ],
                ["doc_id", "text", "removed_spans"],
            )

    return rows.mapInArrow(tidy(run), "doc_id bigint, text string, removed_spans string")


def oracle_sql(least_words: int = LEAST_WORDS, least_run: int = LEAST_RUN) -> str:
    blank = r" \t\r\x0b\x0c"
    stop = rf"[.!?]+(?:[{blank}]+\n?|\n|$)"
    return rf"""
with s as (
  select doc_id, regexp_extract_all(text, '[^.!?\n]*(?:[.!?]+[^.!?\n{blank}][^.!?\n]*)*(?:{stop}|\n|$)') as parts
  from documents where text is not null),
u as (
  select doc_id, unnest(parts) as unit, unnest(range(len(parts))) as pos from s),
o as (
  select doc_id, pos, unit,
    coalesce(sum(length(unit)) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0)::bigint as unit_start
  from u),
m as (
  select doc_id, pos, unit_start, unit_start + length(unit) as unit_end,
    translate(trim(regexp_replace(unit, '[\n{blank}]+', ' ', 'g'), ' '), '{_UPPER}', '{_LOWER}') as norm
  from o),
w as (
  select *, length(norm) - length(replace(norm, ' ', '')) + 1 as n_words from m where norm <> ''),
k as (
  select *, row_number() over (partition by doc_id order by pos) as unit_no from w where n_words >= {least_words}),
r as (
  select *, row_number() over (partition by norm order by doc_id, unit_start) as place,
    first_value(doc_id) over (partition by norm order by doc_id, unit_start) as keep_id,
    first_value(unit_start) over (partition by norm order by doc_id, unit_start) as keep_start
  from k),
g as (
  select *, unit_no - row_number() over (partition by doc_id order by unit_no) as run from r where place > 1)
select doc_id, unit_start, unit_end, n_words::bigint as n_words, keep_id, keep_start
from g qualify sum(n_words) over (partition by doc_id, run) >= {least_run}"""
