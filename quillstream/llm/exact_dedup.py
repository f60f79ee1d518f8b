"""Exact deduplication by an extendible-hash index on shared files.

Texts are normalised by deleting white space and keyed by the leading 64 bits of
their SHA-256. A directory maps key prefixes to buckets; a bucket that holds too
many bytes is split, and the directory doubles when that bucket already uses all
of its bits. Each bucket is a key range with one owner task, which chains texts
that share a key, compares their bytes and writes a record for each chain link.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.kernels import slices, tidy
from quillstream.llm.shared import project, retain, stage_table, text_tag

DELETED = b" \t\n\x0b\x0c\r"
BUCKET_BYTES = 8 << 20
#: Larger inputs have larger buckets, so that the directory has about twice so many entries at most.
MOST_BUCKETS = 50_000
#: Texts that a task remembers having sent, in bytes; it sends a text again when they are forgotten.
SENT_BYTES = 48 << 20
#: A text that more tasks than HOT carried is met in several places before its owner; the MOST_HOT keys that
#: were carried most are listed, so that any other key has a smaller share than 1 / MOST_HOT of all carriers.
HOT, MOST_HOT = 512, 10_000


def normalise(text: bytes) -> bytes:
    """The signs are ASCII, so deleting their bytes leaves other characters whole."""
    return text.translate(None, DELETED)


def sha256(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()


def fingerprint(digest: Callable[[bytes], bytes]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Digest every row; carry the normalised text where this task has not sent one of the same bytes yet,
    and refer to the row that carried it otherwise."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[bytes, list[tuple[int, bytes]]] = {}
        size = 0
        for batch in batches:
            for at, texts in slices(batch.column("text"), 4 << 20):
                points = pc.utf8_length(texts).cast(pa.int64())
                rids = batch.column("rid").slice(at, len(texts))
                sha, key, n_bytes, ref, body = [], [], [], [], []
                for rid, raw in zip(rids.to_pylist(), texts.cast(pa.large_binary()).to_pylist(), strict=True):
                    norm = normalise(raw)
                    name = digest(norm)
                    sha.append(name)
                    key.append(int.from_bytes(name[:8], "big", signed=True))
                    n_bytes.append(len(norm))
                    known = next((r for r, held in sent.get(name, ()) if held == norm), None)
                    ref.append(rid if known is None else known)
                    body.append(norm if known is None else None)
                    if known is None:
                        if size > SENT_BYTES:
                            sent.clear()
                            size = 0
                        sent.setdefault(name, []).append((rid, norm))
                        size += len(norm)
                ids, tags = (batch.column(c).slice(at, len(texts)) for c in ("doc_id", "tag"))
                yield pa.RecordBatch.from_arrays(
                    [rids, ids, tags, points, pa.array(n_bytes, pa.int64()), pa.array(key, pa.int64()), pa.array(sha, pa.binary()), pa.array(ref, pa.int64()), pa.array(body, pa.binary())],
                    ["rid", "doc_id", "tag", "points", "n_bytes", "key", "sha", "ref", "body"],
                )

    return run


class Directory:
    """Extendible-hash directory over 64-bit keys: lower bounds of the buckets and their depths."""

    def __init__(self) -> None:
        self.depth = 0
        self.buckets: dict[tuple[int, int], int] = {(0, 0): 0}  # (prefix, local depth): bytes

    def split(self, bucket: tuple[int, int], loads: tuple[int, int]) -> None:
        prefix, local = bucket
        if local == self.depth:
            self.depth += 1  # the directory doubles
        del self.buckets[bucket]
        for bit, load in enumerate(loads):
            self.buckets[prefix << 1 | bit, local + 1] = load

    def bounds(self) -> np.ndarray:
        """The least key of each bucket, in order, as unsigned integers."""
        return np.array(sorted(p << (64 - d) if d else 0 for p, d in self.buckets), np.uint64)


def build_directory(keyed: DataFrame, capacity: int = BUCKET_BYTES, bits: int = 10, deepest: int = 50) -> Directory:
    """Split buckets until each holds `capacity` bytes at most or its keys are equal in `deepest` bits.

    `keyed` has a row (key, n_bytes) for each key. Loads are counted by
    Spark for `bits` more bits of the overfull buckets alone; the driver sees sums
    for key prefixes: 2^bits for each bucket that is still overfull, of which there
    are MOST_BUCKETS at most.
    """
    directory, level = Directory(), 0
    total = keyed.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    directory.buckets[0, 0], capacity = total, max(capacity, total // MOST_BUCKETS)
    while level < deepest:
        full = [b for b, load in directory.buckets.items() if load > capacity and b[1] == level]
        if not full:
            break
        upper = F.shiftrightunsigned("key", 64 - level) if level else F.lit(0)
        inside = keyed.sparkSession.createDataFrame([(p,) for p, _ in full], "upper bigint")
        seen = keyed.withColumn("upper", upper.cast("bigint")).join(inside, "upper", "left_semi")
        sums = {r[0]: r[1] for r in seen.groupBy(F.shiftrightunsigned("key", 64 - level - bits).alias("p")).agg(F.sum("n_bytes")).collect()}
        for prefix, local in full:
            counts = np.array([sums.get(prefix << bits | i, 0) for i in range(1 << bits)], np.int64)
            todo = [(prefix, local, counts)]
            while todo:
                p, d, loads = todo.pop()
                if loads.sum() <= capacity or len(loads) == 1:
                    continue
                half = len(loads) // 2
                left, right = loads[:half], loads[half:]
                directory.split((p, d), (int(left.sum()), int(right.sum())))
                todo += [(p << 1, d + 1, left), (p << 1 | 1, d + 1, right)]
        level += bits
    return directory


def chain(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chain rows that come sorted by (bucket, key): rows of equal bytes get one slot, numbered for each key.

    `first` is the row that opened the slot. Only the chain of one key is held: the
    different texts that share 64 bits of SHA-256.
    """
    held: list[tuple[int, bytes]] = []
    last = None
    for batch in batches:
        slot, first = [], []
        for bucket, key, ref, body in zip(*(batch.column(c).to_pylist() for c in ("bucket", "key", "ref", "body")), strict=True):
            if (bucket, key) != last:
                held, last = [], (bucket, key)
            at = next((k for k, (_, text) in enumerate(held) if text == body), len(held))
            if at == len(held):
                held.append((ref, body))
            slot.append(at)
            first.append(held[at][0])
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("bucket", "key", "ref")] + [pa.array(slot, pa.int32()), pa.array(first, pa.int64())], ["bucket", "key", "ref", "slot", "first"])


def chained(carriers: DataFrame, owners: int) -> DataFrame:
    """(bucket, key, ref, slot, first) of carriers(bucket, key, ref, body); a bucket has one owner task."""
    dealt = carriers.repartition(owners, "bucket").sortWithinPartitions("bucket", "key")
    return dealt.mapInArrow(tidy(chain), "bucket int, key bigint, ref bigint, slot int, first bigint")


def build_index(docs: DataFrame, capacity: int = BUCKET_BYTES, digest: Callable[[bytes], bytes] = sha256, hot: int = HOT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, refs, index), all on shared files.

    rows: rid, doc_id, tag, sha, ref for each document; ref is the row of the same task that carried
    its text. refs: ref, key, slot. index: bucket, key, slot, group_size, keep_id, keep_rid for each
    distinct text, which key and slot name.
    """
    spark = docs.sparkSession
    plain = project(docs, doc_id="bigint", text="string").withColumn("tag", text_tag("text")).withColumn("rid", F.monotonically_increasing_id())
    rows = plain.mapInArrow(
        tidy(fingerprint(digest)),
        "rid bigint, doc_id bigint, tag bigint, points bigint, n_bytes bigint, key bigint, sha binary, ref bigint, body binary",
    )
    rows = stage_table(rows, "exact-rows")
    carriers = rows.where("body is not null")
    # one length for each key: texts that share a key are rare
    keyed = stage_table(carriers.groupBy("key").agg(F.max("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("n")), "exact-keys")
    bounds = build_directory(keyed, capacity).bounds()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(bounds))

    @F.pandas_udf("int")  # the key alone goes to Python
    def bucket_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy(np.int64).view(np.uint64), "right") - 1, dtype="int32")

    texts = carriers.select(bucket_of("key").alias("bucket"), "key", "ref", "body")
    often = [r["key"] for r in keyed.where(F.col("n") > hot).orderBy(F.desc("n"), "key").limit(MOST_HOT).collect()]
    if often:
        # many tasks carried these: their copies meet in several places first, and one of each place goes on
        listed = F.broadcast(spark.createDataFrame([(k,) for k in often], "key bigint"))  # MOST_HOT keys
        part = F.pmod(F.xxhash64("ref"), F.lit(max(2, parts))).cast("int")
        near = stage_table(chained(texts.join(listed, "key", "left_semi").withColumn("bucket", part), parts).select("ref", "first"), "exact-near")
        texts = texts.join(listed, "key", "left_anti").unionByName(texts.join(near.where("ref = first").select("ref"), "ref", "left_semi"))
    owned = stage_table(chained(texts, parts).select("bucket", "key", "ref", "slot"), "exact-owned")
    refs = owned
    if often:
        copies = near.where("ref <> first").join(owned.withColumnRenamed("ref", "first"), "first").select("bucket", "key", "ref", "slot")
        refs = stage_table(owned.union(copies), "exact-refs")
    # rows that refer to one carrier were read by one task, so they are counted before anything moves
    best = F.struct(-F.col("points"), F.col("doc_id").isNull(), "doc_id", "rid")
    counted = rows.groupBy("ref").agg(F.count(F.lit(1)).alias("n"), F.min(best).alias("best"))
    index = (
        refs.join(counted, "ref")
        .groupBy("bucket", "key", "slot")
        .agg(F.sum("n").alias("group_size"), F.min("best").alias("best"))
        .select("bucket", "key", "slot", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.rid").alias("keep_rid"))
    )
    return rows.select("rid", "doc_id", "tag", "sha", "ref"), refs.select("ref", "key", "slot"), stage_table(index, "exact-index")


def looked_up(docs: DataFrame, capacity: int, digest: Callable[[bytes], bytes], hot: int) -> DataFrame:
    """Every document with the index entry of its text."""
    rows, refs, index = build_index(docs, capacity, digest, hot)
    return rows.join(refs.join(index, ["key", "slot"]).select("ref", "keep_id", "keep_rid", "group_size"), "ref")


def exact_groups(docs: DataFrame, capacity: int = BUCKET_BYTES, digest: Callable[[bytes], bytes] = sha256, hot: int = HOT) -> DataFrame:
    """Rows (doc_id, keep_id, group_size, kept, text_sha256), one for each document.

    Texts are equal when they are identical after deleting the characters of
    [\\x20\\x09-\\x0D]; null counts as empty, so all null, empty and blank texts form
    one group. The row with the most code points stays, then the one with the
    smallest doc_id; a null doc_id comes after all others, and of rows that repeat
    both, one stays. Bytes decide: texts that share a digest are chained apart. Texts of
    any length are read whole. An empty table gives no rows.
    """
    return looked_up(docs, capacity, digest, hot).select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("rid") == F.col("keep_rid")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, capacity: int = BUCKET_BYTES, digest: Callable[[bytes], bytes] = sha256, hot: int = HOT) -> DataFrame:
    """The documents that exact_groups keeps, with all their columns, one of each group.

    Nulls, ties and repeated rows are judged as there; an empty table stays empty.
    """
    judged = looked_up(docs, capacity, digest, hot)
    return retain(docs, judged.select("doc_id", "tag", (F.col("rid") == F.col("keep_rid")).alias("kept")))


ORACLE_SQL = r"""
with n as (
  select doc_id, length(coalesce(text, '')) as points,
    regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm
  from documents),
r as (
  select doc_id, norm,
    count(*) over (partition by norm) as group_size,
    first_value(doc_id) over (partition by norm order by points desc, doc_id) as keep_id,
    row_number() over (partition by norm order by points desc, doc_id) as place
  from n)
select doc_id, keep_id, group_size, place = 1 as kept, sha256(norm) as text_sha256 from r"""
