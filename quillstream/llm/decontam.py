"""Benchmark decontamination over typed templates.

Numbers, names and units become typed placeholders; windows of template tokens are
hashed. Benchmark windows fill a Bloom filter of bounded size that documents are
read against, and what passes is hash-joined with the benchmark's windows. Windows
of one item that lie on one diagonal or on neighbouring ones in a document form an alignment. It counts when
it covers enough of the item and when its slots are consistent: a name of the item always
stands for one name of the document, and no other name does; a number or unit stands for one in each of its roles,
a role being the number and the token after it. So re-parameterised questions are
caught and chance meetings of placeholders are not. Windows of plain lower-cased words go the
same way beside them, for copies of whole items.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.kernels import WORD, buffer_of, hash_spans, mix, powers, slices, spans, tidy, windows, words
from quillstream.llm.shared import project, retain, stage_table, text_tag

SIZE = 8
#: Template tokens that are no placeholders in a window, at least.
LEAST_LITERALS = 4
#: Share of an item's windows that an alignment has to cover.
COVER = 0.5
#: Diagonals of one place lie so many tokens apart at most, or a quarter of the item's windows.
DRIFT = 16
#: Bits of the Bloom filter: 16 for each benchmark window, within these bounds.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 28
#: Units of measure and money.
UNITS = (
    "mm cm m km in ft yd mi mg g kg lb oz ml l gal s sec min h hr day days week weeks month months year years hour hours minute minutes "
    "second seconds meter meters metre metres mile miles inch inches foot feet gram grams kilogram kilograms liter liters litre litres "
    "km/h mph percent dollar dollars cent cents euro euros usd eur gbp degree degrees"
)

_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:;\n\r\"'(["]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 11, 12, 32]] = True


def _single(word: str) -> np.uint64:
    raw = np.frombuffer(word.encode(), np.uint8)
    return hash_spans(raw, np.array([0]), np.array([len(raw)]))[0]


_UNIT = np.sort(np.array([_single(u) for u in UNITS.split()], np.uint64))
NUM, NAME, UNIT = (_single(w) for w in ("<number>", "<name>", "<unit>"))


#: Kinds of windows.
NARROW, WIDE, PLAIN = range(3)


def lowered(buf: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and Latin-1 letters, byte for byte."""
    out = buf.copy()
    out[(buf >= 65) & (buf <= 90)] += 32
    two = np.flatnonzero((buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97) & (buf[:-1] == 0xC3)) + 1 if len(buf) > 1 else np.zeros(0, np.int64)
    out[two] += 32
    return out


def template(col: pa.Array, wide: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(template hashes, word hashes, whether a token is a placeholder, borders of the texts).

    A number is a run of digits with points or commas between digits; a unit is one of
    UNITS after a number; a name is a run of capitalised words with blanks between that do
    not start a sentence, and one token however many words it has. `wide`: a name may start a sentence.
    """
    return templates(col)[int(wide)]


def templates(col: pa.Array) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """What template gives of a slice, narrow and wide."""
    buf, offs = buffer_of(col)
    low = lowered(buf)
    inside = WORD[buf]
    digit = _DIGIT[buf]
    if len(buf) > 2:
        inside[1:-1] |= ((buf[1:-1] == 46) | (buf[1:-1] == 44)) & digit[:-2] & digit[2:]
    s, e = spans(buf, offs, inside)
    at = np.searchsorted(s, offs)
    h = hash_spans(low, s, e)
    if not len(s):
        return [(h, h, np.zeros(0, bool), at)] * 2
    digits = np.concatenate([[0], np.cumsum(digit | (buf == 46) | (buf == 44))])
    number = digit[s] & (digits[e] - digits[s] == e - s)
    first = buf[s]
    capital = (first >= 65) & (first <= 90)
    nxt = buf[np.minimum(s + 1, len(buf) - 1)]
    capital |= (first == 0xC3) & (nxt >= 0x80) & (nxt <= 0x9E) & (nxt != 0x97)
    starts_text = np.zeros(len(s) + 1, bool)
    starts_text[at] = True
    starts_text = starts_text[: len(s)]
    # a sentence starts after a stop, blanks between
    gap_stop = np.concatenate([[0], np.cumsum(_STOP[buf])])
    since = np.concatenate([[0], e[:-1]])
    opened = starts_text | (gap_stop[s] - gap_stop[since] > 0)
    blanks = np.concatenate([[0], np.cumsum(_BLANK[buf])])
    joined = ~opened & (blanks[s] - blanks[since] == s - since)
    after_number = np.concatenate([[False], number[:-1]]) & ~starts_text
    unit = after_number & np.isin(h, _UNIT)
    out = []
    for name in (capital & ~opened & ~number, capital & ~number):
        name = name & ~unit
        typed = number | name | unit
        t = np.where(number, NUM, np.where(unit, UNIT, np.where(name, NAME, h)))
        # a run of names is one token, its value made of all its words
        heads = np.flatnonzero(~(name & joined & np.concatenate([[False], name[:-1]])))
        place = np.arange(len(s)) - np.repeat(heads, np.diff(np.append(heads, len(s))))
        with np.errstate(over="ignore"):
            value = np.add.reduceat(h * powers(int(place.max()) + 1)[0][place], heads)
        out.append((t[heads], value, typed[heads], np.searchsorted(heads, at)))
    return out


def plain(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As template, of lower-cased words alone: nothing is a placeholder."""
    h, at = words(col)
    return h, h, np.zeros(len(h), bool), at


def roles(t: np.ndarray, value: np.ndarray) -> np.ndarray:
    """What a placeholder is known by: a name by its value, with the last bit 0, and all else by value and next token, with the last bit 1."""
    after = np.append(t[1:], np.uint64(0))
    return np.where(t == NAME, value & ~np.uint64(1), mix(value ^ mix(after)) | np.uint64(1))


def text_windows(t: np.ndarray, typed: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the windows inside texts that have enough literal tokens."""
    hashes = windows(t, size)
    keep = np.ones(len(hashes), bool)
    literal = np.concatenate([[0], np.cumsum(~typed)])
    keep &= (literal[size:] - literal[:-size] if len(hashes) else literal[:0]) >= min(LEAST_LITERALS, size)
    ends = np.repeat(at[1:], np.diff(at))[: len(hashes)]
    keep &= np.arange(len(hashes)) + size <= ends
    place = np.flatnonzero(keep)
    return place, hashes[place]


def bloom_rows(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    with np.errstate(over="ignore"):
        return [mix(hashes + np.uint64(k) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(bits - 1) for k in range(4)]


def window_rows(table: DataFrame, key: str, sizes: tuple[tuple[int, int], ...] = (), bloom=None, bits: int = 0) -> DataFrame:
    """(key, tag, kind, size, hash, pos, values, roles, total, ahead) of the windows of each text, or of those a Bloom filter lets pass.

    kind tells narrow and wide templates and plain words apart; `sizes` are the pairs of kind and size that a filter knows. values are the word hashes at the
    placeholders of a window, in order, and roles what they are known by; total is the number of the text's windows of that kind and size; bit i of ahead tells that there is a window i + 1
    tokens on. A text of fewer than SIZE tokens has one window of its own length, three at least but for plain words, where no filter is given.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, part in slices(batch.column("text")):
                rows: list[list] = [[] for _ in range(9)]
                for kind, (t, h, typed, at) in enumerate([*templates(part), plain(part)]):
                    role = roles(t, h)
                    long = np.diff(at)
                    if bloom is not None:
                        own = [s for k, s in sizes if k == kind]
                    else:
                        own = sorted({min(n, SIZE) for n in long.tolist() if n >= (1 if kind == PLAIN else 3)})
                    for size in own:
                        place, hashes = text_windows(t, typed, at, size)
                        owner = np.searchsorted(at, place, "right") - 1
                        if bloom is None and size < SIZE:
                            whole = long[owner] == size
                            place, hashes, owner = place[whole], hashes[whole], owner[whole]
                        total = np.bincount(owner, minlength=len(part))
                        stands = np.zeros(len(t) + SIZE, bool)
                        stands[place] = True
                        if bloom is not None and len(place):
                            hit = np.ones(len(place), bool)
                            for index in bloom_rows(hashes, bits):
                                hit &= (bloom.value[(index >> np.uint64(3)).astype(np.int64)] >> (index & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                            place, hashes, owner = place[hit], hashes[hit], owner[hit]
                        if bloom is not None and kind == PLAIN and size < SIZE and len(place):
                            # a short item is one window: where it stands first is enough
                            once = np.unique(np.stack([owner, hashes.view(np.int64)]), axis=1, return_index=True)[1]
                            once.sort()
                            place, hashes, owner = place[once], hashes[once], owner[once]
                        ahead = np.zeros(len(place), np.int64)
                        for i in range(SIZE - 1):
                            ahead |= (stands[place + i + 1] & (place + i + 1 < at[owner + 1])).astype(np.int64) << i
                        for p, k, x, a in zip(place.tolist(), owner.tolist(), hashes.view(np.int64).tolist(), ahead.tolist(), strict=True):
                            slot = np.flatnonzero(typed[p : p + size])
                            for column, value in zip(rows, (k, kind, size, x, p - int(at[k]), h[p + slot].view(np.int64), role[p + slot].view(np.int64), int(total[k]), a), strict=True):
                                column.append(value)
                if rows[0]:
                    take = pa.array(np.array(rows[0], np.int64) + start)
                    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("key").take(take), batch.column("tag").take(take), *[pa.array(c, k) for c, k in zip(rows[1:], kinds, strict=True)]],
                        ["key", "tag", "kind", "size", "hash", "pos", "values", "roles", "total", "ahead"],
                    )

    rows = project(table, **{key: "bigint", "text": "string"})
    rows = rows.select(F.col(key).alias("key"), "text").withColumn("tag", text_tag("text"))
    return rows.mapInArrow(tidy(run), "key bigint, tag bigint, kind int, size int, hash bigint, pos bigint, values array<bigint>, roles array<bigint>, total bigint, ahead bigint")


def make_bloom(item_windows: DataFrame, bits: int) -> np.ndarray:
    """Or of the filters that tasks build; `bits` bounds what is sent to the driver and broadcast."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            hashes = batch.column("hash").to_numpy(zero_copy_only=False).view(np.uint64)
            for index in bloom_rows(hashes, bits):
                np.bitwise_or.at(own, (index >> np.uint64(3)).astype(np.int64), np.left_shift(np.uint8(1), (index & np.uint64(7)).astype(np.uint8)))
        yield pa.RecordBatch.from_arrays([pa.array([own.tobytes()], pa.binary())], ["part"])

    out = np.zeros(bits // 8, np.uint8)
    # a few parts, however many tasks the benchmark is read by
    for row in item_windows.select("hash").distinct().coalesce(2).mapInArrow(tidy(run), "part binary").toLocalIterator():
        out |= np.frombuffer(row[0], np.uint8)
    return out


def chained(points: list[tuple[int, int, int, int, list[int], list[int]]]) -> int:
    """How many windows of the item a chain of diagonals matches, from (item_pos, doc_pos, size, ahead, item_roles, doc_values).

    Diagonals that are consistent by themselves are taken by their number of windows; of each one those windows are
    added that are in order with what is there, if their slots are consistent with it. A window of the
    item counts, too, when matched windows hold all its tokens: what the document inserts breaks none of the item's own.
    """
    lines: dict[int, dict[int, tuple]] = {}
    for p in points:
        lines.setdefault(p[1] - p[0], {})[p[0]] = p

    def slots(these: list[tuple], known: dict[tuple[int, int], int]) -> dict[tuple[int, int], int] | None:
        known = dict(known)
        for p in these:
            for a, b in zip(p[4], p[5], strict=True):
                if known.setdefault((0, a), b) != b or not a & 1 and known.setdefault((1, b), a) != a:
                    return None
        return known

    at: list[int] = []
    chain: dict[int, tuple] = {}
    known: dict[tuple[int, int], int] = {}
    for line in sorted(lines.values(), key=lambda x: (-len(x), min(x))):
        if slots(list(line.values()), {}) is None:
            continue
        fit = []
        for i, p in line.items():
            k = bisect_left(at, i)
            before = k == 0 or chain[at[k - 1]][1] < p[1]
            if i not in chain and before and (k == len(at) or chain[at[k]][1] > p[1]):
                fit.append(p)
        more = slots(fit, known)
        if fit and more is not None:
            known = more
            chain |= {p[0]: p for p in fit}
            at = sorted(chain)
    held = {i + j for i, p in chain.items() for j in range(p[2])}
    extra = {i + j + 1 for i, p in chain.items() for j in range(SIZE - 1) if p[3] >> j & 1} - set(chain)
    return len(chain) + sum(all(i + j in held for j in range(SIZE)) for i in extra)


def chains(met: DataFrame) -> DataFrame:
    """Alignments over more than one diagonal: words that a document inserts or leaves out move the rest of the item.

    Diagonals of one place are those whose distance is at most DRIFT, or a quarter of the item's windows where that is
    more. Each window goes to two blocks of twice that breadth, so that a place lies in one of them whole and
    a group is bounded by the item, however long the document.
    """
    on = ("doc_id", "tag", "item_id", "item_tag", "kind", "place")
    drift = F.greatest(F.lit(DRIFT), F.floor(F.col("total") / 4))
    block = F.floor(F.col("diagonal") / drift)
    dealt = met.where((F.col("size") == SIZE) & (F.col("kind") != PLAIN)).withColumn("place", F.explode(F.array(block, block - 1)))
    many = dealt.groupBy(*on).agg(F.count_distinct("diagonal").alias("lines"), F.count_distinct("item_pos").alias("n"), F.max("total").alias("t"))
    many = many.where((F.col("lines") > 1) & (F.col("n") + (SIZE - 1) * (F.col("lines") - 1) >= F.lit(COVER) * F.col("t")))
    l, r = dealt.alias("l"), many.alias("r")
    some = l.join(r, [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in on], "left_semi")

    def best(rows: pa.Table) -> pa.Table:
        names = ("item_pos", "doc_pos", "size", "ahead", "item_roles", "doc_values")
        n, total = chained(list(zip(*[rows.column(c).to_pylist() for c in names], strict=True))), max(rows.column("total").to_pylist())
        out = rows.slice(0, 1 if n >= COVER * total else 0).select(["doc_id", "tag", "item_id"])
        full = [pa.array([v] * len(out), pa.int64()) for v in (n, total)]
        return out.append_column("matched", full[0]).append_column("item_windows", full[1])

    return some.groupBy(*on).applyInArrow(best, "doc_id bigint, tag bigint, item_id bigint, matched bigint, item_windows bigint")


def alignments(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, tag, item_id, matched, item_windows) of the alignments that count, the best of each document and item."""
    spark = docs.sparkSession
    items = stage_table(window_rows(benchmark, "item_id"), "bench-windows")
    known = items.agg(F.approx_count_distinct("hash").alias("n"), F.collect_set(F.struct("kind", "size")).alias("sizes")).first()
    bits = max(LEAST_BITS, min(MOST_BITS, 1 << (16 * int(known["n"] or 1)).bit_length()))
    bloom = spark.sparkContext.broadcast(make_bloom(items, bits))
    found = window_rows(docs, "doc_id", tuple(sorted(tuple(x) for x in known["sizes"] or ())), bloom, bits).drop("roles", "total", "ahead")
    found = stage_table(found, "doc-windows").withColumnsRenamed({"key": "doc_id", "pos": "doc_pos", "values": "doc_values"})
    items = items.select(
        F.col("key").alias("item_id"), F.col("tag").alias("item_tag"), "kind", "size", "hash", F.col("pos").alias("item_pos"), F.col("roles").alias("item_roles"), "total", "ahead"
    )
    met = found.join(items, ["hash", "kind", "size"]).withColumn("diagonal", F.col("doc_pos") - F.col("item_pos"))
    on = ("doc_id", "tag", "item_id", "item_tag", "kind", "diagonal")
    met = stage_table(met.select(*on, "size", "item_pos", "doc_pos", "total", "ahead", "item_roles", "doc_values"), "aligned")
    # a role that stands for two values on one diagonal breaks it, and so does a value that two names stand for
    slots = met.select(*on, F.explode(F.array_distinct(F.arrays_zip(F.col("item_roles").alias("a"), F.col("doc_values").alias("b")))).alias("z")).select(*on, "z.*")
    ways = F.array(F.struct(F.lit(0).alias("way"), F.col("a").alias("x"), F.col("b").alias("y")), F.when(F.col("a") % 2 == 0, F.struct(F.lit(1).alias("way"), F.col("b").alias("x"), F.col("a").alias("y"))))
    slots = slots.select(*on, F.explode(F.array_compact(ways)).alias("s")).select(*on, "s.*")
    broken = slots.groupBy(*on, "way", "x").agg(F.min("y").alias("lo"), F.max("y").alias("hi")).where("lo <> hi").select(*on).distinct()
    whole = met.groupBy(*on).agg(F.count_distinct("item_pos").alias("matched"), F.max("total").alias("item_windows"))
    # plain words are for copies of whole items
    whole = whole.where(F.col("matched") >= F.when(F.col("kind") == PLAIN, 1.0).otherwise(COVER) * F.col("item_windows"))
    l, r = whole.alias("l"), broken.alias("r")
    clash = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in on]
    good = l.join(r, clash, "left_anti").select("doc_id", "tag", "item_id", "matched", "item_windows").union(chains(met))
    return good.groupBy("doc_id", "tag", "item_id").agg(F.max(F.struct("matched", "item_windows")).alias("best")).select("doc_id", "tag", "item_id", "best.*")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows (doc_id, item_id, matched, item_windows), one for each document and benchmark item that it holds.

    A document holds an item when windows of SIZE template tokens on one diagonal, or in order on
    neighbouring ones, cover half of the item's windows at least and their slots are consistent; windows with fewer than
    LEAST_LITERALS tokens that are no placeholders do not count, and an item of three to SIZE - 1 tokens is
    one window. It holds an item, too, when all words of the item, at least one, stand in it in a row, whatever
    their case and what lies between words. A null or an item without words is never held, and a null text
    holds nothing. Texts are read whole. Rows that repeat a doc_id and text are reported
    once. A null doc_id or item_id is reported as null. Empty tables give no rows.
    """
    best = alignments(docs, benchmark).groupBy("doc_id", "item_id").agg(F.max(F.struct("matched", "item_windows")).alias("best"))
    return best.select("doc_id", "item_id", "best.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    gone = alignments(docs, benchmark).select("doc_id", "tag").distinct().withColumn("kept", F.lit(False))
    return retain(docs, gone)
