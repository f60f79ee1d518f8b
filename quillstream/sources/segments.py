"""Where segments come from: text tables, positioned items, pages of files.

A segment is a row (doc_id, seq, sub, type, level, page, pdf_ref, tokens). seq orders
the segments of a document, sub the pause marker after a segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.functions import tokens as T

LINES_PER_PAGE = 20
SEGMENT = f"doc_id bigint, seq bigint, sub int, type string, level int, page int, pdf_ref {T.PDF_REF}, tokens {T.TOKENS}"
ITEM = "doc_id bigint, page int, item_index int, str string, x double, y double, width double, font_size double"


def segment(rows: DataFrame, text: Column, type_: Column, page: Column, seq: Column, pdf_ref: Column | None = None) -> DataFrame:
    """A segment of one text token for each row."""
    return rows.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        seq.cast("bigint").alias("seq"),
        F.lit(0).alias("sub"),
        type_.alias("type"),
        F.lit(None).cast("int").alias("level"),
        page.cast("int").alias("page"),
        (pdf_ref if pdf_ref is not None else F.lit(None)).cast(T.PDF_REF).alias("pdf_ref"),
        F.array(T.text(text)).alias("tokens"),
    )


def text_lines(documents: DataFrame) -> DataFrame:
    """(doc_id, pos, line): the lines of each document, from 0."""
    return documents.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))


def line_segments(documents: DataFrame) -> DataFrame:
    """Every line is a paragraph, twenty lines a page."""
    page = F.floor(F.col("pos") / LINES_PER_PAGE) + 1
    return segment(text_lines(documents), F.col("line"), F.lit("paragraph"), page, F.col("pos"))


def selection_segment(selections: DataFrame) -> DataFrame:
    """One paragraph for each selected text, from rows (doc_id, text, hint_page)."""
    return segment(selections, F.col("text"), F.lit("paragraph"), F.col("hint_page"), F.lit(0))


#: Synthetic: a text table has hardly a caption, bracket or heading, so lines are dressed up by a fixed rule
#: on (doc_id, pos). The same expressions run in Spark and in the SQL that results are compared with.
DECORATED_KIND = "(doc_id * 31 + pos) % 13"
DECORATED_TEXT = """case (doc_id * 31 + pos) % 13
  when 0 then concat('Figure ', cast(pos as varchar(20)), ': ', line)
  when 1 then concat('As shown [12, 13], ', line, ' (Smith et al., 2020) ends')
  when 2 then concat(line, ' as in (see Fig. 3) here e.g. Eq. 2 vs. cf. done.')
  when 3 then concat('3.2 ', line)
  when 4 then line
  when 5 then 'RUNNING HEAD'
  when 6 then case when doc_id % 5 = 0 then 'References' else '1. Intro (part two) here' end
  when 7 then concat(line, ' {a note of two [7] parts} [see (Doe, 2001)] tail (open')
  when 8 then concat('cell ', cast(pos as varchar(20)))
  when 9 then concat('cell ', cast(pos as varchar(20)))
  when 10 then concat('cell ', cast(pos as varchar(20)))
  when 11 then 'Page 3 of 9'
  else line end"""
DECORATED_TYPE = """case (doc_id * 31 + pos) % 13
  when 3 then 'heading' when 6 then 'heading' when 4 then 'list-item'
  when 8 then 'table-row' when 9 then 'table-row' when 10 then 'table-row' else 'paragraph' end"""


def decorated_segments(documents: DataFrame) -> DataFrame:
    page = F.floor(F.col("pos") / LINES_PER_PAGE) + 1
    return segment(text_lines(documents), F.expr(DECORATED_TEXT), F.expr(DECORATED_TYPE), page, F.col("pos"))


def host_segments(pages: DataFrame) -> DataFrame:
    """Web pages as the pages of a document that is their host: a paragraph for each text between tags."""
    host = F.regexp_extract("url", "://([^/?#]*)", 1)
    doc = F.conv(F.substring(F.md5(host), 1, 15), 16, 10).cast("bigint")
    rows = pages.select("page_id", doc.alias("doc_id"), F.posexplode(F.split("html", "<[^>]*>", -1)).alias("pos", "line"))
    rows = rows.where(F.col("line").rlike(r"\S"))
    return segment(rows, F.col("line"), F.lit("paragraph"), F.col("page_id"), F.col("page_id") * 1_000_000 + F.col("pos"))


#: Synthetic geometry for text tables: words of 6 points a character, lines 12 points apart, fifty a page.
#: Some lines have a large font, an indent, or wide gaps, by the rule of the decorated lines.
ITEM_LINES = 50


def line_items(documents: DataFrame) -> DataFrame:
    """Every word of a text table as a positioned item, in the shape of ITEM."""
    m = F.expr(DECORATED_KIND)
    rows = text_lines(documents).withColumn("m", m)
    rows = rows.select("doc_id", "pos", "m", F.posexplode(F.split("line", " ", -1)).alias("k", "str"))
    table = F.col("m").isin(8, 9, 10)
    step = 6 * F.length("str") + 3 + F.when(table, 40).otherwise(0)
    run = Window.partitionBy("doc_id", "pos").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    x = 50 + F.when(F.col("m") == 4, 20).otherwise(0) + F.coalesce(F.sum(step).over(run), F.lit(0))
    return rows.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.floor(F.col("pos") / ITEM_LINES) + 1).cast("int").alias("page"),
        ((F.col("pos") % ITEM_LINES) * 100_000 + F.col("k")).cast("int").alias("item_index"),
        "str",
        x.cast("double").alias("x"),
        (700 - 12 * (F.col("pos") % ITEM_LINES) - F.when(F.col("m") == 12, 6).otherwise(0)).cast("double").alias("y"),
        (6 * F.length("str")).cast("double").alias("width"),
        F.when(F.col("m") == 3, 14.0).otherwise(10.0).alias("font_size"),
    )


def read_items(spark: SparkSession, path: str, fmt: str = "parquet", max_pages: int | None = None) -> DataFrame:
    """Decoded text items of documents; raw ones carry the six numbers of a transform instead of x, y and font_size."""
    rows = spark.read.format(fmt).load(path)
    if max_pages is not None:
        rows = rows.where(F.col("page") <= max_pages)
    return project_items(rows)


def read_pdf_bytes(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of PDF files; decoding them into items takes a parser outside of this package."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content")


def project_items(rows: DataFrame) -> DataFrame:
    """Items in the shape of ITEM: items without str go, the index stays as it was before.

    From a transform t: x = t[4], y = t[5], font_size is the length of (t[2], t[3]), else
    the size of t[3], else 10; a missing width is the size of t[0] for each character.
    """
    if "item_index" not in rows.columns:
        raise ValueError("items need an item_index, their place in the page before any is dropped")
    rows = rows.where(F.col("str").isNotNull())
    if "transform" in rows.columns:
        t = F.col("transform")
        width = F.col("width") if "width" in rows.columns else F.lit(None)
        size = F.coalesce(F.nullif(F.hypot(t[2], t[3]), F.lit(0.0)), F.nullif(F.abs(t[3]), F.lit(0.0)), F.lit(10.0))
        rows = rows.withColumns({"x": t[4], "y": t[5], "font_size": size, "width": F.coalesce(width.cast("double"), F.abs(t[0]) * F.length("str"))})
    fields = [f.strip().split(" ") for f in ITEM.split(",")]
    return rows.select(*[F.col(n).cast(k).alias(n) for n, k in fields])
