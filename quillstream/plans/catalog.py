"""Registered queries of the document-flow engine, by operator; plans.oracle has their SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.functions import tokens as T
from quillstream.functions.config import Brackets, Config
from quillstream.operators import cues as C
from quillstream.operators import layout as L
from quillstream.operators import models as M
from quillstream.operators import positions as P
from quillstream.operators import rules as R
from quillstream.operators import seek as S
from quillstream.plans import narrate, oracle
from quillstream.sources import segments as X

DEFAULT = Config()
FLAGSHIP = "pipeline_cues"
QUERIES: dict = {}
ORACLE_SQL = oracle.SQL


def query(f):
    QUERIES[f.__name__] = f
    return f


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def plain(spark: SparkSession, d: str) -> DataFrame:
    return X.line_segments(docs(spark, d))


def dressed(spark: SparkSession, d: str) -> DataFrame:
    return X.decorated_segments(docs(spark, d))


def shown(segments: DataFrame, *more: Column) -> DataFrame:
    return segments.select("doc_id", "seq", "type", "page", T.plain_text(F.col("tokens")).alias("text"), *more)


def pauses() -> Column:
    """Milliseconds of silence among a segment's tokens."""
    return F.aggregate(F.filter("tokens", lambda t: t["kind"] == "pause"), F.lit(0), lambda a, t: a + t["ms"]).cast("bigint").alias("pause_ms")


def n_tokens() -> Column:
    return F.size("tokens").cast("bigint").alias("n_tokens")


@query
def lines_scan(spark, d):
    return shown(plain(spark, d))


@query
def word_count(spark, d):
    rows = plain(spark, d).select("doc_id", R.rx.count_words(T.plain_text(F.col("tokens"))).alias("n"))
    return rows.groupBy("doc_id").agg(F.sum("n").cast("bigint").alias("n_words"), F.count(F.lit(1)).alias("n_lines"))


@query
def page_limit(spark, d):
    return shown(plain(spark, d).where(F.col("page") <= 2))


@query
def boilerplate_filter(spark, d):
    return shown(R.filter_boilerplate(dressed(spark, d), DEFAULT.removeBoilerplate))


@query
def repeated_lines(spark, d):
    return shown(R.filter_repeated(dressed(spark, d), DEFAULT.removeRepeatedHeadersFooters))


@query
def repeated_lines_by_host(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet")
    return shown(R.filter_repeated_wide(X.host_segments(pages), DEFAULT.removeRepeatedHeadersFooters))


@query
def stop_at_references(spark, d):
    return shown(R.stop_at_references(dressed(spark, d), replace(DEFAULT.stopAtReferences, enabled=True)))


@query
def table_runs_replace(spark, d):
    return shown(R.collapse_tables(dressed(spark, d), DEFAULT.tables))


@query
def table_runs_skip(spark, d):
    return shown(R.collapse_tables(dressed(spark, d), replace(DEFAULT.tables, mode="skip")))


@query
def captions_skip(spark, d):
    return shown(R.standalone_captions(dressed(spark, d), DEFAULT.figuresAndTables))


@query
def captions_replace(spark, d):
    return shown(R.standalone_captions(dressed(spark, d), replace(DEFAULT.figuresAndTables, mode="replace")))


@query
def captions_silent(spark, d):
    return shown(R.standalone_captions(dressed(spark, d), replace(DEFAULT.figuresAndTables, mode="replace", replacement=""), 250), pauses())


@query
def captions_inline(spark, d):
    return shown(R.inline_captions(dressed(spark, d), DEFAULT.figuresAndTables), n_tokens())


@query
def bracket_spans(spark, d):
    parts = R.bracket_parts(T.plain_text(F.col("tokens")), "(", ")")
    spans = F.transform(F.filter(parts, lambda p: p["span"]), lambda p: p["text"])
    rows = dressed(spark, d).select("doc_id", "seq", F.posexplode(spans).alias("k", "span"))
    return rows.select("doc_id", "seq", F.col("k").cast("bigint").alias("k"), "span")


@query
def brackets_cut(spark, d):
    return shown(R.apply_brackets(dressed(spark, d), DEFAULT.brackets), n_tokens())


@query
def brackets_parens(spark, d):
    only = Brackets(parens=replace(DEFAULT.brackets.parens, enabled=True, replacement="aside"), square=replace(DEFAULT.brackets.square, enabled=False), curly=replace(DEFAULT.brackets.curly, enabled=False))
    return shown(R.apply_brackets(dressed(spark, d), only), n_tokens())


@query
def citation_shape(spark, d):
    rows = spark.createDataFrame([(s,) for s in oracle.CITATIONS], "content string")
    return rows.select("content", F.col("content").rlike(R.CITATION).alias("is_citation"))


@query
def heading_normalize(spark, d):
    return shown(R.normalize_headings(dressed(spark, d), DEFAULT.headings), pauses())


@query
def substitutions(spark, d):
    return shown(R.apply_substitutions(dressed(spark, d), DEFAULT.substitutions))


@query
def substitutions_tracked(spark, d):
    rows = R.apply_substitutions(dressed(spark, d), DEFAULT.substitutions)
    return rows.select("doc_id", "seq", F.col("tokens")[0]["debug_tag"].alias("debug_tag")).where("debug_tag is not null")


@query
def structural_pauses(spark, d):
    rows = R.structural_pauses(dressed(spark, d), DEFAULT.structuralPauses)
    return rows.select("doc_id", "seq", F.col("sub").cast("bigint").alias("sub"), "type", "page", F.col("tokens")[0]["ms"].alias("ms"), F.col("tokens")[0]["reason"].alias("reason"))


@query
def cue_split_punct(spark, d):
    pieces = C.split_text(T.plain_text(F.col("tokens")), DEFAULT.punctuationPauses, capped=False)
    rows = dressed(spark, d).select("doc_id", "seq", F.posexplode(pieces).alias("k", "p"))
    return rows.select("doc_id", "seq", F.col("k").cast("bigint").alias("k"), "p.text", F.col("p.pause_after_ms").alias("ms"), F.col("p.pause_reason").alias("reason"))


@query
def cue_split_legacy(spark, d):
    pieces = C.split_text(T.plain_text(F.col("tokens")), replace(DEFAULT.punctuationPauses, enabled=False))
    rows = dressed(spark, d).select("doc_id", "seq", F.posexplode(pieces).alias("k", "p"))
    return rows.select("doc_id", "seq", F.col("k").cast("bigint").alias("k"), "p.text")


@query
def cap_length(spark, d):
    whole = C.piece(R.rx.trim(T.plain_text(F.col("tokens"))), F.lit(80), F.lit("period"))
    rows = dressed(spark, d).select("doc_id", "seq", F.posexplode(C.cap_length(whole)).alias("k", "p"))
    return rows.select("doc_id", "seq", F.col("k").cast("bigint").alias("k"), "p.text", F.col("p.pause_after_ms").alias("ms"))


@query
def cue_queue(spark, d):
    return C.build_cues(plain(spark, d), DEFAULT.punctuationPauses).select("doc_id", "cue_index", "kind", "text", "ms", "page", "type", "seg_start", "reason")


@query
def pipeline_segments(spark, d):
    return shown(narrate.clean(dressed(spark, d)), pauses(), n_tokens())


@query
def pipeline_tokens(spark, d):
    return narrate.process(dressed(spark, d))


@query
def pipeline_cues(spark, d):
    return narrate.cues(dressed(spark, d)).drop("pdf_ref")


@query
def narrate_selections(spark, d):
    rows = spark.read.parquet(f"{d}/conversations.parquet").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text", F.lit(1).alias("hint_page"))
    return narrate.narrate_selections(rows).drop("pdf_ref")


@query
def narrate_items(spark, d):
    rows = narrate.narrate_items(X.line_items(docs(spark, d)))
    return rows.select("doc_id", "cue_index", "kind", "text", "ms", "page", "type", "seg_start", "debug_tag", "reason")


def line_cues(spark, d) -> DataFrame:
    """A queue in which every decorated line is a cue: running heads are silence."""
    rows = dressed(spark, d)
    text, head = T.plain_text(F.col("tokens")), F.col("seq")
    silent = text == "RUNNING HEAD"
    return rows.select(
        "doc_id", head.alias("cue_index"), F.when(silent, "silence").otherwise("speech").alias("kind"), F.when(~silent, text).alias("text"),
        F.when(silent, 80).alias("ms"), "page", "type", (~silent).alias("seg_start"), F.when(F.col("type") == "list-item", "item").alias("debug_tag"),
        F.when(silent & (head % 2 == 0), "period").alias("reason"),
        F.when(head % 3 != 0, F.struct(head.cast("int").alias("begin_index"), F.lit(0).alias("begin_offset"), (head + 1).cast("int").alias("end_index"), F.length(text).alias("end_offset"))).alias("pdf_ref"),
    )


@query
def seek_page(spark, d):
    probes = docs(spark, d).select("doc_id", F.explode(F.array(*[F.lit(x) for x in (1, 2, 3, 9)])).alias("page"))
    return S.seek_page(line_cues(spark, d), probes)


@query
def seek_text(spark, d):
    lines = X.text_lines(docs(spark, d)).select("doc_id", F.concat(F.lit("  "), F.lower("line")).alias("text"), F.lit(2).alias("hint_page")).distinct()
    return S.seek_text(line_cues(spark, d), lines)


@query
def seek_heading(spark, d):
    return S.heading_neighbours(line_cues(spark, d))


@query
def seek_skip(spark, d):
    total = F.count(F.lit(1)).over(R.Window.partitionBy("doc_id"))
    rows = line_cues(spark, d).withColumn("total", total)
    return rows.select(
        "doc_id", "cue_index", S.skip(F.col("cue_index"), F.lit(1), F.col("total")).alias("forth"),
        S.skip(F.col("cue_index"), F.lit(-1), F.col("total")).alias("back"), S.progress(F.col("cue_index"), F.col("total")).alias("percent"),
    )


@query
def seek_status(spark, d):
    positions = docs(spark, d).select("doc_id", F.lit(3).cast("bigint").alias("position"))
    return S.status(line_cues(spark, d), positions)


@query
def seek_page_count(spark, d):
    given = docs(spark, d).where("doc_id % 4 = 0").select("doc_id", F.lit(77).alias("page_count")).distinct()
    return S.page_count(line_cues(spark, d), given)


@query
def debug_window(spark, d):
    return S.debug_windows(line_cues(spark, d))


@query
def text_preview(spark, d):
    return line_cues(spark, d).where("text is not null").select("doc_id", "cue_index", S.preview(F.col("text")).alias("preview"))


@query
def passage_links(spark, d):
    base = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    return line_cues(spark, d).select("doc_id", "cue_index", S.passage_link(base, F.col("page"), F.col("pdf_ref")).alias("link"))


@query
def project_items(spark, d):
    """Words as raw items: some without text, width or a usable transform."""
    rows = X.text_lines(docs(spark, d)).select("doc_id", "pos", F.posexplode(F.split("line", " ", -1)).alias("k", "word"))
    n, k = F.length("word"), F.col("k")
    side = F.when(n % 4 == 0, 0).otherwise(n).cast("double")
    raw = rows.select(
        "doc_id", F.col("pos").alias("page"), k.alias("item_index"), F.when(n % 5 != 0, F.col("word")).alias("str"), F.when(k % 3 != 0, 6.5 * n).alias("width"),
        F.array(F.lit(-6.0), F.lit(0.0), F.when(k % 2 == 0, 3.0).otherwise(0.0), side, k * 10.0, F.col("pos") * 12.0).alias("transform"),
    )
    return X.project_items(raw)


def grouped(spark, d) -> DataFrame:
    return L.group_lines(X.line_items(docs(spark, d)))


@query
def layout_lines(spark, d):
    rows = grouped(spark, d)
    return rows.select("doc_id", "page", F.col("line_no").cast("bigint").alias("line_no"), "text", "font_size", "x", "y", "gap_before", F.size("gap_widths").cast("bigint").alias("n_gaps"))


@query
def layout_stats(spark, d):
    return L.document_stats(grouped(spark, d))


@query
def layout_table_rows(spark, d):
    rows = L.mark_table_rows(grouped(spark, d))
    return rows.select("doc_id", "page", F.col("line_no").cast("bigint").alias("line_no"), "is_table_row")


@query
def layout_classes(spark, d):
    rows = L.classify_lines(L.mark_table_rows(grouped(spark, d)))
    return rows.select("doc_id", "page", F.col("line_no").cast("bigint").alias("line_no"), "kind")


@query
def layout_segments(spark, d):
    rows = L.extract_segments(X.line_items(docs(spark, d)))
    return shown(rows, *[F.col(f"pdf_ref.{k}").alias(k) for k in ("begin_index", "end_index", "end_offset")])


def page_events(spark, d) -> DataFrame:
    events = spark.read.parquet(f"{d}/events.parquet")
    return events.select(F.col("user_id").alias("file"), F.col("ts").cast("timestamp").alias("ts"), (F.floor("value") % 7).cast("int").alias("page"))


@query
def saved_positions(spark, d):
    rows = P.saved_positions(page_events(spark, d), 3_600_000)
    return rows.select("file", F.unix_micros("ts").alias("ts_us"), "page")


@query
def last_positions(spark, d):
    return P.last_positions(page_events(spark, d), 3_600_000)


@query
def resume_hints(spark, d):
    saved = P.last_positions(page_events(spark, d), 3_600_000)
    now = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("file"), F.lit(3).alias("page"), (F.col("c_custkey") % 5 == 0).alias("selection_mode"))
    return P.resume_hints(now, saved)


@query
def model_resolve(spark, d):
    files = spark.createDataFrame(oracle.MODEL_FILES, "model_dir string, file_name string, is_dir boolean")
    manifests = spark.createDataFrame(oracle.MANIFESTS, "model_dir string, manifest string")
    overrides = spark.createDataFrame(oracle.OVERRIDES, "model_dir string, override string")
    rows = M.resolve(files, manifests, overrides)
    return rows.select("model_dir", "engine", "detected_by", "status", F.col("n_onnx").cast("bigint").alias("n_onnx"), F.element_at("model_files", "model").alias("model_file"), "rule_fsts")
