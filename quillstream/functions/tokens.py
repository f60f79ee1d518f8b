"""Token columns: a tagged union of spoken text and silence, in arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "struct<kind:string,value:string,ms:int,debug_tag:string,reason:string>"
TOKENS = f"array<{TOKEN}>"
PDF_REF = "struct<begin_index:int,begin_offset:int,end_index:int,end_offset:int>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often `body` names it; lambdas share nothing otherwise."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _token(kind: str, value: Column, ms: Column, tag: Column, reason: Column) -> Column:
    return F.struct(
        F.lit(kind).alias("kind"), value.cast("string").alias("value"), ms.cast("int").alias("ms"),
        tag.cast("string").alias("debug_tag"), reason.cast("string").alias("reason"),
    )


def text(value: Column, tag: Column | None = None) -> Column:
    """A text token; an empty tag is none."""
    return _token("text", value, F.lit(None), F.nullif(tag, F.lit("")) if tag is not None else F.lit(None), F.lit(None))


def pause(ms: Column | int, reason: Column | str | None = None) -> Column:
    ms = F.lit(ms) if isinstance(ms, int) else ms
    reason = F.lit(reason) if not isinstance(reason, Column) else reason
    return _token("pause", F.lit(None), ms, F.lit(None), F.nullif(reason, F.lit("")))


def marker_or_pause(marker: str, tag: str, ms: int, reason: str) -> Column:
    """What stands for removed text: a spoken marker, or silence where the marker is blank."""
    return text(F.lit(marker), F.lit(tag)) if marker else pause(ms, reason)


def plain_text(tokens: Column) -> Column:
    """The values of the text tokens, joined without separator."""
    return F.array_join(F.transform(F.filter(tokens, lambda t: t["kind"] == "text"), lambda t: t["value"]), "")


def is_blank(tokens: Column) -> Column:
    from quillstream.functions.rx import trim

    return ~F.exists(tokens, lambda t: (t["kind"] == "text") & (trim(t["value"]) != ""))


def map_text(tokens: Column, change: Callable[[Column], tuple[Column, Column]]) -> Column:
    """Replace the value of text tokens; `change` gives the new value and a tag, which stays as it was where null."""

    def one(t: Column) -> Column:
        value, tag = change(t["value"])
        return F.when(t["kind"] == "text", text(value, F.coalesce(tag, t["debug_tag"]))).otherwise(t)

    return F.transform(tokens, one)


def expand_text(tokens: Column, change: Callable[[Column], Column]) -> Column:
    """Replace each text token by the array of tokens that `change` makes of it."""
    return F.flatten(F.transform(tokens, lambda t: F.when(t["kind"] == "text", change(t)).otherwise(F.array(t))))
