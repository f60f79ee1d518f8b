"""The page where a reader stopped: change detection with a trailing pause, and resume hints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEBOUNCE_MS = 2000


def saved_positions(events: DataFrame, debounce_ms: int = DEBOUNCE_MS) -> DataFrame:
    """(file, ts, page): the saves that events (file, ts, page) lead to.

    A page that differs from the one saved before starts a wait; the last such page is
    saved when nothing new came for `debounce_ms`. Pages are compared within a file.
    """
    by = Window.partitionBy("file").orderBy("ts", "page")
    changes = events.withColumn("was", F.lag("page").over(by)).where(F.col("was").isNull() | (F.col("was") != F.col("page")))
    quiet = F.unix_millis(F.lead("ts").over(by)) - F.unix_millis("ts")
    return changes.withColumn("quiet", quiet).where(F.col("quiet").isNull() | (F.col("quiet") > debounce_ms)).select("file", "ts", "page")


def last_positions(events: DataFrame, debounce_ms: int = DEBOUNCE_MS) -> DataFrame:
    """(file, page): the last save of each file wins."""
    saves = saved_positions(events, debounce_ms)
    return saves.groupBy("file").agg(F.max(F.struct("ts", "page")).alias("s")).select("file", F.col("s.page").alias("page"))


def resume_hints(current: DataFrame, saved: DataFrame) -> DataFrame:
    """current (file, page, selection_mode) with hint_page: the saved page unless there is none, a selection is read, or it is open already."""
    met = current.join(saved.select("file", F.col("page").alias("saved_page")), "file", "left")
    show = ~F.col("selection_mode") & F.col("saved_page").isNotNull() & ~F.col("saved_page").eqNullSafe(F.col("page"))
    return met.select("file", "page", "selection_mode", F.when(show, F.col("saved_page")).alias("hint_page"))
