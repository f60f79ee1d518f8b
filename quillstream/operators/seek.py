"""Questions to a queue of cues: by page, by text, by heading, by position; and what is shown of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions import rx

NEEDLE, SHORT, LEAST_MATCH = 80, 40, 20


def seek_page(cues: DataFrame, probes: DataFrame) -> DataFrame:
    """probes (doc_id, page) with cue_index: the first cue of that page or a later one, else the last, -1 without cues.

    A nearest-forward join by aggregation: a document's cues shrink to the first cue of
    each page before they meet the probes.
    """
    firsts = cues.groupBy("doc_id", F.col("page").alias("cue_page")).agg(F.min("cue_index").alias("first"), F.max("cue_index").alias("last"))
    met = probes.select("doc_id", "page").distinct().join(firsts, "doc_id", "left")
    at = F.coalesce(F.min(F.when(F.col("cue_page") >= F.col("page"), F.col("first"))), F.max("last"), F.lit(-1))
    return met.groupBy("doc_id", "page").agg(at.cast("bigint").alias("cue_index"))


def normal(text: Column) -> Column:
    return rx.trim(rx.collapse(F.lower(text)))


def seek_text(cues: DataFrame, selections: DataFrame) -> DataFrame:
    """selections (doc_id, text, hint_page) with cue_index: the first matching cue on the hinted page, else from that page on, else anywhere, else -1."""
    probes = selections.withColumn("needle", F.substring(normal(F.col("text")), 1, NEEDLE))
    probes = probes.withColumn("short", F.substring("needle", 1, SHORT))
    speech = cues.where(F.col("kind") == "speech").select("doc_id", "cue_index", F.col("page").alias("cue_page"), normal(F.col("text")).alias("hay"))
    speech = speech.where(F.length("hay") >= LEAST_MATCH)
    hit = F.contains("hay", "short") | F.contains("needle", F.substring("hay", 1, SHORT))
    met = probes.join(speech, (probes["doc_id"] == speech["doc_id"]) & (F.col("needle") != "") & hit, "left").drop(speech["doc_id"])
    tier = F.when(F.col("cue_page") == F.col("hint_page"), 0).when(F.col("cue_page") >= F.col("hint_page"), 1).otherwise(2)
    best = F.min(F.when(F.col("cue_index").isNotNull(), F.struct(tier.alias("tier"), "cue_index")))
    return met.groupBy("doc_id", "text", "hint_page").agg(F.coalesce(best["cue_index"], F.lit(-1)).cast("bigint").alias("cue_index"))


def heading_neighbours(cues: DataFrame) -> DataFrame:
    """For each cue the nearest heading strictly after and strictly before it, null where there is none."""
    doc = Window.partitionBy("doc_id").orderBy("cue_index")
    here = F.when((F.col("type") == "heading") & F.col("seg_start"), F.col("cue_index"))
    return cues.select(
        "doc_id", "cue_index",
        F.min(here).over(doc.rowsBetween(1, Window.unboundedFollowing)).alias("next_heading"),
        F.max(here).over(doc.rowsBetween(Window.unboundedPreceding, -1)).alias("previous_heading"),
    )


def skip(index: Column, by: Column, total: Column) -> Column:
    """A step along the queue that stays within it."""
    return F.greatest(F.lit(0), F.least(total - 1, index + by))


def progress(index: Column, total: Column) -> Column:
    """Percent, rounded half up; 0 without cues."""
    return F.when(total > 0, F.floor(F.greatest(F.lit(0), index) / total * 100 + 0.5)).otherwise(0).cast("int")


def page_count(cues: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """The page count that is given for a document, else the page of its last cue."""
    last = cues.groupBy("doc_id").agg(F.max_by("page", "cue_index").alias("last_page"))
    if given is None:
        return last.select("doc_id", F.col("last_page").alias("page_count"))
    return last.join(given, "doc_id", "left").select("doc_id", F.coalesce("page_count", "last_page").alias("page_count"))


def status(cues: DataFrame, positions: DataFrame) -> DataFrame:
    """A snapshot for each position (doc_id, position): page, type, text, total, percent."""
    total = cues.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"))
    here = cues.select("doc_id", F.col("cue_index").alias("position"), "page", "type", "kind", "text")
    rows = positions.join(total, "doc_id", "left").join(here, ["doc_id", "position"], "left")
    count = F.coalesce("total", F.lit(0))
    return rows.select("doc_id", "position", "page", "type", "kind", "text", count.alias("total"), progress(F.col("position"), count).alias("percent"))


def debug_windows(cues: DataFrame, before: int = 8, after: int = 2) -> DataFrame:
    """(doc_id, cue_index, debug_text): the cues around each one, the cue itself between arrows if it is speech."""
    silent = F.format_string("{pause: %s, %dms}", F.coalesce("reason", F.lit("unlabeled")), F.col("ms"))
    tag = F.when(F.coalesce("debug_tag", F.lit("")) != "", F.format_string("[%s] ", F.col("debug_tag"))).otherwise("")
    said = F.concat(tag, F.col("text"))
    doc = Window.partitionBy("doc_id").orderBy("cue_index")
    rows = cues.select("doc_id", "cue_index", F.when(F.col("kind") == "silence", silent).otherwise(said).alias("shown"), (F.col("kind") == "speech").alias("speech"))
    last = F.max("cue_index").over(Window.partitionBy("doc_id"))
    current = F.when(F.col("speech"), F.concat(F.lit("▶"), "shown", F.lit("◀"))).otherwise(F.col("shown"))
    parts = F.array_compact(F.concat(
        F.array(F.when(F.col("cue_index") > before, "…")),
        F.collect_list("shown").over(doc.rowsBetween(-before, -1)),
        F.array(current),
        F.collect_list("shown").over(doc.rowsBetween(1, after)),
        F.array(F.when(F.col("cue_index") + after < last, "…")),
    ))
    return rows.select("doc_id", "cue_index", F.array_join(parts, " ").alias("debug_text"))


def preview(text: Column, most: int = 90) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def passage_link(base: Column, page: Column, pdf_ref: Column) -> Column:
    """A link to a page, and to the passage on it where the cue knows its place."""
    plain = F.format_string("[[%s#page=%d]]", base, page)
    exact = F.format_string("[[%s#page=%d&selection=%d,%d,%d,%d]]", base, page, *(pdf_ref[k] for k in ("begin_index", "begin_offset", "end_index", "end_offset")))
    return F.when(pdf_ref.isNotNull(), exact).otherwise(plain)
