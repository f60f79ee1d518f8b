"""Cleaning rules: functions from segments to segments, in a fixed order.

What needs a whole document is a window over doc_id; all of them share one exchange.
Rules on single segments are expressions. A disabled rule adds nothing to the plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.functions import rx
from quillstream.functions import tokens as T
from quillstream.functions.config import BOILERPLATE, Boilerplate, Bracket, Brackets, Captions, Config, CutPauses, Headings, Repeated, StructuralPauses, Substitution, Switch, Tables

ORDER = ("seq", "sub")
REFERENCES = rx.ignoring_case(rx.to_java(r"^(references|bibliography|works cited|literature cited)\b"))
NUMBERED = rx.to_java(r"^(\d+(?:\.\d+)*)\.?\s+(.*)$")
_AUTHOR = r"[A-Z][\w.\-]+(?:\s+(?:&|and)\s+[A-Z][\w.\-]+)?(?:\s+et al\.?)?"
_ONE = _AUTHOR + r",?\s*\d{4}[a-z]?"
CITATION = rx.to_java(rf"^\s*(?:{_ONE}(?:\s*;\s*{_ONE})*|\d+(?:\s*[,;\-–]\s*\d+)*)\s*$")
BRACKETS = (("parens", "(", ")"), ("square", "[", "]"), ("curly", "{", "}"))


def plain() -> Column:
    return T.plain_text(F.col("tokens"))


def stop_at_references(segments: DataFrame, config: Switch) -> DataFrame:
    """Keep what stands before the first heading that opens the references."""
    if not config.enabled:
        return segments
    opens = (F.col("type") == "heading") & rx.trim(plain()).rlike(REFERENCES)
    cut = F.min(F.when(opens, F.col("seq"))).over(Window.partitionBy("doc_id"))
    return segments.withColumn("_cut", cut).where(F.col("_cut").isNull() | (F.col("seq") < F.col("_cut"))).drop("_cut")


def short_text() -> Column:
    """A segment's text if it is short enough to be a running head, else null."""
    text = rx.trim(plain())
    return F.when((F.length(text) > 0) & (F.length(text) <= 80), text)


def least_repeats(pages: Column, config: Repeated) -> Column:
    fraction = 0.3 if config.minRepeatFraction is None else config.minRepeatFraction
    return F.greatest(F.lit(3), F.ceil(F.greatest(pages, F.lit(1)) * F.lit(fraction)))


def filter_repeated(segments: DataFrame, config: Repeated) -> DataFrame:
    """Drop short texts that occur max(3, pages * fraction) times in their document."""
    if not config.enabled:
        return segments
    rows = segments.withColumn("_t", short_text())
    # before the next window, as its sort would carry the set of pages with each row
    pages = F.size(F.collect_set("page").over(Window.partitionBy("doc_id")))
    rows = rows.withColumn("_least", least_repeats(pages, config))
    rows = rows.withColumn("_n", F.count("_t").over(Window.partitionBy("doc_id", "_t")))
    return rows.where(F.col("_t").isNull() | (F.col("_n") < F.col("_least"))).drop("_t", "_n", "_least")


def filter_repeated_wide(segments: DataFrame, config: Repeated) -> DataFrame:
    """filter_repeated for documents of any size, such as all pages of a host.

    Texts are counted by partial sums and found by a join that can be split, so a document's rows never meet in
    one task; long texts do not move. Texts and pages are counted in one pass, with a row for each.
    """
    if not config.enabled:
        return segments
    rows = segments.withColumn("_t", short_text())
    none, text, page = F.lit(None), F.col("_t"), F.col("page")
    keys = F.array(F.struct(text.alias("t"), none.cast("int").alias("p")), F.struct(none.cast("string").alias("t"), page.alias("p")))
    keyed = rows.select("doc_id", F.explode(keys).alias("k")).groupBy("doc_id", "k.t", "k.p").agg(F.count("k.t").alias("n"))
    # both sides filter by the sum alone, and no join implies that a text is not null, so that they share the exchange
    least = keyed.where("n = 0").groupBy(F.col("doc_id").alias("_doc")).agg(least_repeats(F.count("p"), config).alias("_least"))
    often = keyed.where("n >= 3").join(least, F.col("doc_id").eqNullSafe(F.col("_doc"))).where(F.col("n") >= F.col("_least"))
    often = often.select("_doc", F.col("t").alias("_often"))
    long, short = rows.where(text.isNull()), rows.where(text.isNotNull())
    kept = short.join(often, short["doc_id"].eqNullSafe(often["_doc"]) & short["_t"].eqNullSafe(often["_often"]), "left_anti")
    return long.union(kept).drop("_t")


def collapse_tables(segments: DataFrame, config: Tables, ms: int = 0) -> DataFrame:
    """A run of table rows becomes its first row with a marker or silence in place of its text, or goes."""
    if not config.enabled or config.mode == "keep":
        return segments
    row = F.col("type") == "table-row"
    if config.mode != "replace":
        return segments.where(~row)
    before = F.lag("type").over(Window.partitionBy("doc_id").orderBy(*ORDER))
    rows = segments.withColumn("_first", ~row | ~F.coalesce(before == "table-row", F.lit(False))).where("_first").drop("_first")
    marker = F.array(T.marker_or_pause(config.replacement.strip(), "table-replaced", ms, "table"))
    return rows.withColumn("tokens", F.when(row, marker).otherwise(F.col("tokens")))


def filter_boilerplate(segments: DataFrame, config: Boilerplate) -> DataFrame:
    """Drop segments that a pattern finds; patterns that do not compile are skipped."""
    if not config.enabled:
        return segments
    spark = segments.sparkSession
    patterns = [p for p in (rx.ignoring_case(rx.to_java(p)) for p in config.patterns or BOILERPLATE) if rx.is_valid(spark, p)]
    if not patterns:
        return segments
    # one pattern for all, as every mention of the text in a filter computes it again
    text, any_of = rx.trim(plain()), "|".join(f"(?:{p})" for p in patterns)
    return segments.where((text == "") | ~text.rlike(any_of))


def caption_patterns(keywords: tuple[str, ...]) -> tuple[str, str]:
    """Patterns of a caption that opens a segment, and of one in parentheses."""
    any_of = "|".join(rx.escape(k) for k in keywords)
    number = r"\.?\s*\d+[a-z]?(?:\.\d+)?\s*"
    alone = rx.to_java(rf"^(?:{any_of}){number}[:.\-–]?\s*")
    inline = rx.to_java(rf"\(\s*(?:see\s+)?(?:{any_of}){number}\)")
    return rx.ignoring_case(alone), rx.ignoring_case(inline)


def standalone_captions(segments: DataFrame, config: Captions, ms: int = 0) -> DataFrame:
    if not config.enabled or not config.keywords or config.mode == "keep":
        return segments
    hit = rx.trim(plain()).rlike(caption_patterns(config.keywords)[0])
    if config.mode == "skip":
        return segments.where(~hit)
    marker = F.array(T.marker_or_pause(config.replacement.strip(), "caption-replaced", ms, "caption"))
    return segments.withColumn("tokens", F.when(hit, marker).otherwise(F.col("tokens")))


def inline_captions(segments: DataFrame, config: Captions, ms: int = 0) -> DataFrame:
    """Each caption in parentheses becomes a marker or silence between the texts around it."""
    if not config.enabled or not config.keywords or config.mode == "keep":
        return segments
    pattern = caption_patterns(config.keywords)[1]
    marker = T.marker_or_pause(config.replacement.strip(), "caption-inline-replaced", ms, "caption-inline")

    def pieces(t: Column) -> Column:
        texts = F.transform(F.split(t["value"], pattern, -1), lambda p, i: F.when(i == 0, F.array(T.text(p))).otherwise(F.array(marker, T.text(p))))
        parts = F.filter(F.flatten(texts), lambda x: (x["kind"] == "pause") | (x["value"] != ""))
        return F.when(t["value"].rlike(pattern), parts).otherwise(F.array(t))

    return segments.withColumn("tokens", T.expand_text(F.col("tokens"), pieces))


def bracket_parts(text: Column, open_: str, close: str) -> Column:
    """The text as parts (text, span): outermost pairs of one kind of bracket are spans.

    A closing bracket without an opening one is plain text, and so is everything from
    an opening bracket that nothing closes.
    """
    signs = f"[{rx.escape(open_)}{rx.escape(close)}]"
    pieces = F.split(text, signs, -1)
    marks = F.regexp_extract_all(text, F.lit(f"({signs})"), F.lit(1))
    none = F.expr("cast(array() as array<struct<text:string,span:boolean>>)")
    start = F.struct(F.lit(0).alias("depth"), pieces[0].alias("before"), F.lit("").alias("inside"), none.alias("out"))
    steps = F.arrays_zip(marks.alias("mark"), F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(1))).alias("piece"))

    def state(depth: Column, before: Column, inside: Column, out: Column) -> Column:
        return F.struct(depth.alias("depth"), before.alias("before"), inside.alias("inside"), out.alias("out"))

    def part(t: Column, span: bool) -> Column:
        return F.struct(t.alias("text"), F.lit(span).alias("span"))

    def step(a: Column, x: Column) -> Column:
        both = F.concat(x["mark"], F.coalesce(x["piece"], F.lit("")))
        opened = state(a["depth"] + 1, a["before"], F.concat(a["inside"], both), a["out"])
        stray = state(a["depth"], F.concat(a["before"], both), a["inside"], a["out"])
        inner = state(a["depth"] - 1, a["before"], F.concat(a["inside"], both), a["out"])
        done = F.concat(a["out"], F.array(part(a["before"], False), part(F.concat(a["inside"], x["mark"]), True)))
        closed = state(F.lit(0), F.coalesce(x["piece"], F.lit("")), F.lit(""), done)
        return F.when(x["mark"] == open_, opened).when(a["depth"] == 0, stray).when(a["depth"] == 1, closed).otherwise(inner)

    return F.aggregate(steps, start, step, lambda a: F.concat(a["out"], F.array(part(F.concat(a["before"], a["inside"]), False))))


def is_cut(inner: Column, config: Bracket) -> Column:
    """Whether a bracket goes: its content looks like a citation, or has enough words."""
    enough = F.lit(True) if not config.minWords else rx.count_words(inner) >= config.minWords
    return (rx.trim(inner).rlike(CITATION) | enough) if config.alwaysStripCitations else enough


def apply_brackets(segments: DataFrame, config: Brackets, ms: int = 0) -> DataFrame:
    """Parentheses, then square, then curly brackets; each reads what the one before has left.

    A bracket that stays still becomes a token of its own, and every text token is made
    anew, without the tag that it had, as soon as one kind of bracket is enabled.
    """
    out = F.col("tokens")
    for key, open_, close in BRACKETS:
        one: Bracket = getattr(config, key)
        if not one.enabled:
            continue
        marker = T.marker_or_pause(one.replacement.strip(), f"bracket-{key}-replaced", ms, f"bracket-{key}")

        def pieces(t: Column, one=one, open_=open_, close=close, marker=marker) -> Column:
            def token(p: Column) -> Column:
                inner = F.substr(p["text"], F.lit(2), F.greatest(F.length(p["text"]) - 2, F.lit(0)))
                return F.when(p["span"] & is_cut(inner, one), marker).otherwise(T.text(p["text"]))

            found = F.filter(bracket_parts(t["value"], open_, close), lambda p: p["span"] | (p["text"] != ""))
            whole = F.array(T.text(t["value"]))
            made = F.when(F.exists(found, lambda p: p["span"]), F.transform(found, token)).otherwise(whole)
            return F.when(F.contains(t["value"], F.lit(open_)) & F.contains(t["value"], F.lit(close)), made).otherwise(whole)

        out = T.expand_text(out, pieces)
        segments = segments.withColumn("tokens", out)
        out = F.col("tokens")
    return segments


def normalize_headings(segments: DataFrame, config: Headings) -> DataFrame:
    """A leading number of a heading is announced as a section."""
    if not config.enabled:
        return segments
    t = rx.trim(plain())
    made = F.array(
        T.text(F.concat(F.lit("Section "), F.regexp_extract(t, NUMBERED, 1), F.lit("."))),
        T.pause(config.pauseAfterNumberMs or 150, "section-number"),
        T.text(F.regexp_extract(t, NUMBERED, 2)),
    )
    return segments.withColumn("tokens", F.when((F.col("type") == "heading") & t.rlike(NUMBERED), made).otherwise(F.col("tokens")))


def substitution_pattern(entry: Substitution) -> str:
    body = rx.escape(entry.match)
    body = rf"\b{body}\b" if entry.wholeWord else body
    java = rx.to_java(body)
    return java if entry.caseSensitive else rx.ignoring_case(java)


def substitute(text: Column, entries: tuple[Substitution, ...]) -> Column:
    """A struct (text, fired): entries applied in order, each on what the one before has left; fired lists those that matched.

    One fold over the entries as a constant array, so that no step is computed twice.
    """
    rows = [F.struct(F.lit(substitution_pattern(e)).alias("p"), F.lit(rx.java_replacement(e.replace)).alias("r"), F.lit(f"{e.match}→{e.replace}").alias("t")) for e in entries]
    start = F.struct(text.alias("text"), F.expr("cast(array() as array<string>)").alias("fired"))

    def step(a: Column, e: Column) -> Column:
        hit = F.regexp(a["text"], e["p"])
        new = F.struct(F.regexp_replace(a["text"], e["p"], e["r"]).alias("text"), F.concat(a["fired"], F.array(e["t"])).alias("fired"))
        return F.when(hit, new).otherwise(a)

    return F.aggregate(F.array(*rows), start, step)


def apply_substitutions(segments: DataFrame, entries: tuple[Substitution, ...]) -> DataFrame:
    """Rewrite text tokens and tag those in which something was replaced.

    A text that no entry matches as it stands is not changed by any, as entries write
    only where they match; one pattern for all of them tells, and the fold runs on the rest.
    """
    used = tuple(e for e in entries if e.match.strip())
    if not used:
        return segments
    first = "(?iu)" + "|".join(rx.to_java(rx.escape(e.match)) for e in used)

    def change(t: Column) -> Column:
        made = T.let(substitute(t["value"], used), lambda r: T.text(r["text"], F.when(F.size(r["fired"]) > 0, F.concat(F.lit("substituted: "), F.array_join(r["fired"], ", "))).otherwise(t["debug_tag"])))
        return F.when((t["kind"] == "text") & t["value"].rlike(first), made).otherwise(t)

    return segments.withColumn("tokens", F.transform("tokens", change))


def structural_pauses(segments: DataFrame, config: StructuralPauses) -> DataFrame:
    """A pause marker after each segment but the last, by the types of the two that it parts."""
    if not config.enabled:
        return segments
    nxt = F.lead("type").over(Window.partitionBy("doc_id").orderBy(*ORDER))
    rows = segments.withColumn("_next", nxt)
    cur, nxt, item = F.col("type"), F.col("_next"), F.lit("list-item")
    kinds = (
        ((cur == item) & (nxt == item), config.betweenListItemsMs, "between-list-items"),
        (nxt == item, config.beforeListMs, "before-list"),
        (cur == "heading", config.afterHeadingMs, "after-heading"),
        (nxt == "heading", config.beforeHeadingMs, "before-heading"),
        (F.lit(True), config.betweenParagraphsMs, "paragraph-gap"),
    )
    ms, reason = F.lit(None).cast("int"), F.lit(None).cast("string")
    for test, m, r in reversed(kinds):
        ms, reason = F.when(test, m or 0).otherwise(ms), F.when(test, r).otherwise(reason)
    rows = rows.withColumn("_ms", F.when(nxt.isNotNull(), ms)).withColumn("_reason", reason)
    rows = rows.withColumn("_add", F.explode(F.when(F.coalesce(F.col("_ms") > 0, F.lit(False)), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    mark = F.col("_add") == 1
    return rows.select(
        "doc_id", "seq", F.when(mark, 1).otherwise(F.col("sub")).alias("sub"),
        F.when(mark, "pause-marker").otherwise(cur).alias("type"),
        F.when(~mark, F.col("level")).alias("level"), "page",
        F.when(~mark, F.col("pdf_ref")).alias("pdf_ref"),
        F.when(mark, F.array(T.pause(F.col("_ms"), F.col("_reason")))).otherwise(F.col("tokens")).alias("tokens"),
    )


def process_segments(segments: DataFrame, config: Config) -> DataFrame:
    """All rules in their order; segments that rules have emptied stay and still get pauses."""
    cut: CutPauses = config.pauses
    out = stop_at_references(segments, config.stopAtReferences)
    out = filter_repeated(out, config.removeRepeatedHeadersFooters)
    out = collapse_tables(out, config.tables, cut.tableMs)
    out = filter_boilerplate(out, config.removeBoilerplate)
    out = standalone_captions(out, config.figuresAndTables, cut.captionMs)
    out = inline_captions(out, config.figuresAndTables, cut.captionMs)
    out = apply_brackets(out, config.brackets, cut.bracketMs)
    out = normalize_headings(out, config.headings)
    out = apply_substitutions(out, config.substitutions)
    return structural_pauses(out, config.structuralPauses)


def token_stream(segments: DataFrame) -> DataFrame:
    """(doc_id, seq, sub, pos, kind, value, ms, debug_tag, reason): the tokens of all segments."""
    return segments.select("doc_id", "seq", "sub", F.posexplode("tokens").alias("pos", "t")).select("doc_id", "seq", "sub", "pos", "t.*")
