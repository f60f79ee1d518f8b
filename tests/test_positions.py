import datetime as dt
import random

from quillstream.operators import positions as P
from quillstream.streaming import positions as S

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "file string, ts timestamp, page int"


def events(spark, rows):
    return spark.createDataFrame([(f, T0 + dt.timedelta(milliseconds=ms), p) for f, ms, p in rows], SCHEMA)


def test_trailing_pause(spark):
    df = events(spark, [("a", 0, 1), ("a", 500, 2), ("a", 900, 3), ("a", 5000, 3), ("a", 6000, 4), ("b", 700, 9)])
    got = sorted((r.file, round((r.ts - T0).total_seconds() * 1000), r.page) for r in P.saved_positions(df).collect())
    assert got == [("a", 900, 3), ("a", 6000, 4), ("b", 700, 9)]
    assert {r.file: r.page for r in P.last_positions(df).collect()} == {"a": 4, "b": 9}


def test_against_a_timer(spark):
    rng = random.Random(5)
    rows, ms = [], 0
    for _ in range(300):
        ms += rng.choice([100, 700, 1900, 2100, 5000])
        rows.append(("f", ms, rng.randint(1, 3)))
    want, prev, wait = [], None, None
    for _, t, p in rows:
        if p == prev:
            continue
        if wait and t - wait[0] > 2000:
            want.append(wait)
        prev, wait = p, (t, p)
    want.append(wait)
    got = sorted((round((r.ts - T0).total_seconds() * 1000), r.page) for r in P.saved_positions(events(spark, rows)).collect())
    assert got == want


def test_resume_hints(spark):
    now = spark.createDataFrame([("a", 1, False), ("b", 2, False), ("c", 1, True), ("d", 1, False)], "file string, page int, selection_mode boolean")
    saved = spark.createDataFrame([("a", 5), ("b", 2), ("c", 7)], "file string, page int")
    assert {r.file: r.hint_page for r in P.resume_hints(now, saved).collect()} == {"a": 5, "b": None, "c": None, "d": None}


def test_stream_saves_each_change_once(spark, tmp_path):
    rows = [("a", 0, 1), ("a", 500, 2), ("a", 900, 3), ("a", 9000, 4), ("b", 700, 9), ("z", 60_000, 1)]
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    events(spark, rows).write.parquet(source)
    stream = S.saved_positions(S.read_events(spark, source, SCHEMA))
    S.write_positions(stream, out, state, once=True).awaitTermination(120)
    # a page that stays the same is not saved again
    events(spark, [("a", 70_000, 4), ("b", 70_500, 9), ("b", 70_600, 8), ("b", 70_700, 9)]).write.mode("append").parquet(source)
    S.write_positions(S.saved_positions(S.read_events(spark, source, SCHEMA)), out, state, once=True).awaitTermination(120)
    # later events move the watermark on, over a restart
    events(spark, [("z", 200_000, 2)]).write.mode("append").parquet(source)
    S.write_positions(S.saved_positions(S.read_events(spark, source, SCHEMA)), out, state, once=True).awaitTermination(120)
    got = sorted((r.file, r.page) for r in spark.read.parquet(out).collect())
    assert got == [("a", 3), ("a", 4), ("b", 9), ("b", 9), ("z", 1)]


def test_stream_against_the_table(spark, tmp_path):
    """Events out of order within the lateness, over many batches, give the saves of the whole table."""
    rng = random.Random(6)
    rows, ms = [], 0
    for _ in range(120):
        ms += rng.choice([100, 700, 1900, 2100, 5000])
        rows.append((rng.choice("ab"), ms, rng.randint(1, 3)))
    late = sorted(rows, key=lambda r: r[1] + rng.randint(0, 4000)) + [("z", ms + 10**6, 1)]
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    for at in range(0, len(late), 45):
        events(spark, late[at : at + 45]).coalesce(1).write.mode("append").parquet(source)
        S.write_positions(S.saved_positions(S.read_events(spark, source, SCHEMA)), out, state, once=True).awaitTermination(120)
    events(spark, [("z", ms + 2 * 10**6, 2)]).write.mode("append").parquet(source)
    S.write_positions(S.saved_positions(S.read_events(spark, source, SCHEMA)), out, state, once=True).awaitTermination(120)
    want = P.saved_positions(events(spark, rows)).collect()
    got = [r for r in spark.read.parquet(out).collect() if r.file != "z"]
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 20


def test_only_the_newest_generation_counts(spark):
    df = spark.createDataFrame([(1, 1, "old"), (1, 2, "new"), (2, 1, "only")], "token int, generation int, v string")
    assert sorted(r.v for r in S.keep_latest(df).collect()) == ["new", "only"]
