"""From positioned items to lines, and from lines to segments, with windows.

Items are dealt once by (doc_id, page) and lines once by doc_id. Classification reads
neighbouring lines only, never a class that was given before, so it is one projection;
paragraphs are gaps and islands.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions import rx
from quillstream.functions import tokens as T
from quillstream.functions.tokens import let

SAME_LINE_PT, INDENT_PT = 2.5, 8
WIDE_GAP_FONTS, WIDE_GAP_PT, WIDE_GAPS, ROW_WORDS, ROW_RUN = 1.8, 10, 2, 24, 3
LARGE_FONT, BIG_GAP = 1.15, 1.4
BULLET = rx.to_java(r"^[•‣◦⁃∙●▪◾\-\*]\s+")
NUMBERED_ITEM = rx.to_java(r"^(?:\(?[0-9]{1,3}[\).]|\(?[a-zA-Z][\).]|\(?[ivxlcdmIVXLCDM]{1,6}[\).])\s+")
NUMBERED_HEADING = rx.to_java(r"^(\d+(?:\.\d+){0,3})\.?\s+\S")
BARE_NUMBER = rx.to_java(r"^\d{1,4}$")
MULTI_LEVEL = rx.to_java(r"^\d+(?:\.\d+){1,3}\.?\s+\S")
ALL_CAPS = rx.to_java(r"^(?=(?:.*[A-Z]){2,})[A-Z0-9][A-Z0-9\s\-:,.'&]{0,70}$")
SENTENCE_END = rx.to_java(r"[.!?]['\")”’]*\s*$")
HYPHEN_END = rx.to_java(r"[a-z]-$")
#: Headings that are known by their words.
HEADING_WORDS = (
    "abstract", "introduction", "conclusion", "conclusions", "references", "bibliography", "acknowledgments", "acknowledgements", "appendix", "appendices",
    "related work", "prior work", "background", "discussion", "results", "methodology", "methods", "materials and methods", "summary", "overview",
    "preface", "contents", "table of contents", "literature review", "future work", "limitations", "notation", "nomenclature", "glossary", "index",
    "motivation", "evaluation", "experiments", "experimental setup", "implementation", "design", "problem statement", "related literature",
)


def assign_lines(items: DataFrame) -> DataFrame:
    """Items with _run and _sub, which tell a page's lines apart and order them: an item joins the current line while it lies within 2.5 pt of the line's first item.

    A gap to the item before of more than that always starts a line and a run; only where a run
    spreads further are the heights in it folded, once, to those at which lines start.
    """
    down = (F.col("y").desc(), "x", "item_index")
    page = Window.partitionBy("doc_id", "page").orderBy(*down)
    rows = items.withColumn("_far", F.coalesce(F.lag("y").over(page) - F.col("y") > SAME_LINE_PT, F.lit(False)).cast("int"))
    rows = rows.withColumn("_run", F.sum("_far").over(page))
    run = Window.partitionBy("doc_id", "page", "_run")
    rows = rows.withColumn("_first", F.row_number().over(run.orderBy(*down)) == 1)
    rows = rows.withColumn("_wide", F.coalesce(F.max("y").over(run) - F.min("y").over(run) > SAME_LINE_PT, F.lit(False)))
    rows = rows.withColumn("_ys", F.collect_set(F.when(F.col("_wide"), F.col("y"))).over(run))
    begin = F.struct(F.lit(None).cast("double").alias("anchor"), F.expr("cast(array() as array<double>)").alias("out"))

    def step(a: Column, y: Column) -> Column:
        new = F.coalesce(a["anchor"] - y > SAME_LINE_PT, F.lit(False))
        anchor = F.when(new | a["anchor"].isNull(), y).otherwise(a["anchor"])
        return F.struct(anchor.alias("anchor"), F.when(new, F.concat(a["out"], F.array(y))).otherwise(a["out"]).alias("out"))

    starts = F.aggregate(F.sort_array("_ys", asc=False), begin, step, lambda a: a["out"])
    rows = rows.withColumn("_starts", F.when(F.col("_first") & F.col("_wide"), starts)).drop("_ys")
    rows = rows.withColumn("_starts", F.first("_starts", ignorenulls=True).over(run))
    # an item without a height comes last
    sub = F.size(F.filter("_starts", lambda s: F.coalesce(s >= F.col("y"), F.lit(True))))
    return rows.withColumn("_sub", F.when(F.col("_wide"), sub).otherwise(0)).drop("_far", "_first", "_wide", "_starts")


def median_of(values: Column) -> Column:
    """The exact median of an array's values that are not null."""

    def middle(v: Column) -> Column:
        n = F.size(v)
        return F.get(v, F.floor((n - 1) / 2).cast("int")) * 0.5 + F.get(v, F.floor(n / 2).cast("int")) * 0.5

    return let(F.sort_array(F.array_compact(values)), middle)


def group_lines(items: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, text, font_size, x, y, gap_before, first_item, last_item, last_item_len, gap_widths), without blank lines."""
    rows = assign_lines(items)
    across = Window.partitionBy("doc_id", "page", "_run", "_sub").orderBy("x", F.col("y").desc(), "item_index")
    blank = F.col("str").rlike(f"^{rx.SPACE}+\\z")
    prev_end, prev_font = F.lag(F.col("x") + F.col("width")).over(across), F.lag("font_size").over(across)
    gap = F.when(prev_end.isNotNull(), F.when(blank, F.col("width")).otherwise(F.col("x") - prev_end))
    rows = rows.withColumns({"_gap": gap, "_font": F.coalesce(F.nullif(prev_font, F.lit(0.0)), F.col("font_size")), "_blank": blank, "_k": F.row_number().over(across)})
    parted = ~F.col("_blank") & (F.col("_gap") > F.greatest(F.col("_font") * 0.2, F.lit(1.0)))
    piece = F.concat(F.when(F.coalesce(parted, F.lit(False)), " ").otherwise(""), F.col("str"))
    wide = F.when(F.col("_gap") > 0, F.col("_gap"))
    parts = F.struct("_k", piece.alias("t"), wide.alias("g"), F.col("font_size").alias("f"), "x", "item_index", F.length("str").alias("n"))
    lines = rows.groupBy("doc_id", "page", "_run", "_sub").agg(F.sort_array(F.collect_list(parts)).alias("_p"), F.max("y").alias("y"))
    first, last = F.col("_p")[0], F.element_at("_p", -1)
    lines = lines.withColumns({
        "font_size": median_of(F.col("_p")["f"]), "x": first["x"], "first_item": first["item_index"], "last_item": last["item_index"], "last_item_len": last["n"],
    })
    text = rx.trim(rx.collapse(F.array_join(F.transform("_p", lambda p: p["t"]), "")))
    page = Window.partitionBy("doc_id", "page").orderBy("_run", "_sub")
    before = F.lag("y").over(page) - F.col("y")
    lines = lines.withColumns({"line_no": F.row_number().over(page) - 1, "text": text, "gap_before": before, "gap_widths": F.array_compact(F.transform("_p", lambda p: p["g"]))})
    return lines.where(F.col("text") != "").select("doc_id", "page", "line_no", "text", "font_size", "x", "y", "gap_before", "first_item", "last_item", "last_item_len", "gap_widths")


def mark_table_rows(lines: DataFrame) -> DataFrame:
    """is_table_row for runs of three lines or more on a page that have two wide gaps and 1 to 24 words each."""
    least = F.greatest(F.col("font_size") * WIDE_GAP_FONTS, F.lit(float(WIDE_GAP_PT)))
    wide = F.size(F.filter("gap_widths", lambda g: g > least))
    words = rx.count_words(F.col("text"))
    rows = lines.withColumn("_row", (wide >= WIDE_GAPS) & (words >= 1) & (words <= ROW_WORDS))
    page = Window.partitionBy("doc_id", "page").orderBy("line_no")
    kind = Window.partitionBy("doc_id", "page", "_row").orderBy("line_no")
    rows = rows.withColumn("_island", F.row_number().over(page) - F.row_number().over(kind))
    run = F.count(F.lit(1)).over(Window.partitionBy("doc_id", "page", "_row", "_island"))
    return rows.withColumn("is_table_row", F.col("_row") & (run >= ROW_RUN)).drop("_row", "_island")


def stats(median: Callable[[Column], Column]) -> dict[str, Column]:
    """body_size, body_margin and typical_gap of a document's lines, 10 for a body size of none."""
    gap = F.col("gap_before")
    return {
        "body_size": F.coalesce(F.nullif(median(F.col("font_size")), F.lit(0.0)), F.lit(10.0)),
        "body_margin": F.coalesce(median(F.col("x")), F.lit(0.0)),
        "typical_gap": F.coalesce(median(F.when(gap > 0, gap)), F.lit(0.0)),
    }


def document_stats(lines: DataFrame) -> DataFrame:
    """(doc_id, body_size, body_margin, typical_gap): exact medians."""
    return lines.groupBy("doc_id").agg(*[c.alias(n) for n, c in stats(F.median).items()])


def ends_sentence(text: Column) -> Column:
    return rx.trim(text).rlike(SENTENCE_END)


def classify_lines(lines: DataFrame) -> DataFrame:
    """Lines with kind: heading, list-item, table-row, standalone-short or paragraph-line."""
    whole = Window.partitionBy("doc_id")
    rows = lines.withColumns(stats(lambda c: F.median(c).over(whole)))
    doc = Window.partitionBy("doc_id").orderBy("page", "line_no")
    page = Window.partitionBy("doc_id", "page").orderBy("line_no")
    rows = rows.withColumns({
        "prev_ends": F.lag(ends_sentence(F.col("text"))).over(doc), "_prev_x": F.lag("x").over(doc),
        "_next_text": F.lead("text").over(page), "_next_x": F.lead("x").over(page), "_words": rx.count_words(F.col("text")), "_t": rx.trim(F.col("text")),
    })
    t, words, x = F.col("_t"), F.col("_words"), F.col("x")
    false = F.lit(False)
    lower = t.rlike("^[a-z]")
    weak = ~lower & F.coalesce(F.col("prev_ends"), F.lit(True))
    large = F.col("font_size") >= F.col("body_size") * LARGE_FONT
    strong = ~lower & (F.col("text").rlike(MULTI_LEVEL) | (large & (F.col("text").rlike(NUMBERED_HEADING) | (words <= 14)))) & (words <= 20)
    caps = weak & (words <= 8) & ~t.rlike("[a-z]") & t.rlike(ALL_CAPS)
    named = rx.trim(rx.collapse(F.regexp_replace(F.lower(t), f"[^a-z{rx.SPACE_SIGNS}]", "")))
    common = weak & (words <= 5) & named.isin(*HEADING_WORDS)
    big_gap = F.coalesce((F.col("typical_gap") > 0) & (F.col("gap_before") > F.col("typical_gap") * BIG_GAP), false)
    goes_on = F.coalesce(rx.trim(F.col("_next_text")).rlike("^[a-z]"), false)
    spaced = weak & ~goes_on & big_gap & (words <= 10) & ~t.rlike(r"[.!?,;:]\z")
    marked = F.col("text").rlike(BULLET) | F.col("text").rlike(NUMBERED_ITEM)
    indented = (x > F.col("body_margin") + INDENT_PT) & (words <= 30)
    same_indent = F.coalesce(F.abs(x - F.col("_prev_x")) <= INDENT_PT, false)
    shallower = F.coalesce(x - F.col("_next_x") > INDENT_PT, false)
    kind = (
        F.when(F.col("is_table_row"), "table-row").when(t.rlike(BARE_NUMBER), "standalone-short").when(strong | caps | common | spaced, "heading")
        .when(marked, "list-item").when(indented & (same_indent | ~shallower), "list-item").otherwise("paragraph-line")
    )
    return rows.withColumn("kind", kind).drop("_prev_x", "_next_text", "_next_x", "_words", "_t", "body_size", "typical_gap")


def line_ref(first: Column, last: Column, length: Column) -> Column:
    return F.struct(first.cast("int").alias("begin_index"), F.lit(0).alias("begin_offset"), last.cast("int").alias("end_index"), length.cast("int").alias("end_offset"))


def assemble(lines: DataFrame) -> DataFrame:
    """Segments from classified lines: body lines are joined to paragraphs, all others stand alone.

    A body line starts a paragraph when the line before is none, or when that line ends
    its sentence and either this one is indented or the page has changed.
    """
    body = F.col("kind") == "paragraph-line"
    doc = Window.partitionBy("doc_id").orderBy("page", "line_no")
    was_body = F.coalesce(F.lag(body).over(doc), F.lit(False))
    broken = F.coalesce(F.col("prev_ends"), F.lit(False)) & ((F.col("x") > F.col("body_margin") + INDENT_PT) | (F.lag("page").over(doc) != F.col("page")))
    rows = lines.withColumn("_start", (~body | ~was_body | broken).cast("int")).withColumn("seq", F.sum("_start").over(doc) - 1)
    rows = rows.withColumn("_first_page", F.min("page").over(Window.partitionBy("doc_id", "seq")))
    order = F.struct("page", "line_no")
    here = F.col("page") == F.col("_first_page")
    parts = F.array_sort(F.collect_list(F.struct("page", "line_no", "text")))
    grouped = rows.groupBy("doc_id", "seq").agg(
        parts.alias("_p"), F.first("kind").alias("kind"), F.min("page").alias("page"),
        F.min_by("first_item", order).alias("_b"), F.max_by("last_item", F.when(here, order)).alias("_e"), F.max_by("last_item_len", F.when(here, order)).alias("_l"),
    )
    hyphen = lambda t: rx.trim(t).rlike(HYPHEN_END)
    joined = F.array_join(F.transform("_p", lambda p, i: F.when(i == F.size("_p") - 1, p["text"]).when(hyphen(p["text"]), F.regexp_replace(p["text"], r"-\z", "")).otherwise(F.concat(p["text"], F.lit(" ")))), "")
    grouped = grouped.withColumn("_j", joined)
    whole, kind = F.col("_j"), F.col("kind")
    item = F.regexp_replace(F.regexp_replace(whole, BULLET, ""), NUMBERED_ITEM, "")
    text = F.when(kind == "list-item", item).when(kind == "paragraph-line", rx.trim(whole)).otherwise(whole)
    type_ = F.when(kind.isin("heading", "list-item", "table-row"), kind).otherwise("paragraph")
    ref = line_ref(F.col("_b"), F.col("_e"), F.col("_l"))
    return grouped.select(
        "doc_id", F.col("seq").cast("bigint").alias("seq"), F.lit(0).alias("sub"), type_.alias("type"), F.lit(None).cast("int").alias("level"),
        F.col("page").cast("int").alias("page"), ref.cast(T.PDF_REF).alias("pdf_ref"), F.array(T.text(text)).alias("tokens"),
    )


def extract_segments(items: DataFrame, max_pages: int | None = None) -> DataFrame:
    """The whole layout layer: items to segments."""
    if max_pages is not None:
        items = items.where(F.col("page") <= max_pages)
    return assemble(classify_lines(mark_table_rows(group_lines(items))))
