"""Similarity join on word n-gram sets: MinHash banding, then exact verification.

Bands and rows are the pair of least work that reaches a target recall at the
threshold. Texts with one n-gram set are one class from the start. Sets that meet in a
band bucket are candidates. Those that meet a common one in two bands or more form families,
which chance does not join however many texts there are; within a family every pair is
verified on the full n-gram sets, and pairs across families are verified in
the first bucket that they share. Blocks of pairs are dealt over all tasks, and only counts
and spanning links leave a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from quillstream.llm.kernels import shingle_sets, slices, tidy
from quillstream.llm.shared import components, project, retain, same, stage_table, text_tag

SIZE = 5
THRESHOLD = Fraction(4, 5)
RECALL = 0.9995
#: Sets and n-grams of a block. A family of m sets has about m / BLOCK_ROWS blocks.
BLOCK_ROWS = 96
BLOCK_GRAMS = 1 << 16
#: Bands in which sets have to meet a common one to be of one family.
MEETINGS = 2


@dataclass(frozen=True)
class Banding:
    bands: int
    rows: int

    def candidate(self, similarity: float) -> float:
        """Probability that a pair of that similarity shares a band."""
        return 1 - (1 - similarity**self.rows) ** self.bands


@cache
def choose_banding(threshold: float = float(THRESHOLD), recall: float = RECALL, most: int = 128) -> Banding:
    """The most selective banding that reaches `recall` at `threshold` with `most` hash functions at most."""
    fit = [b for r in range(1, 17) for n in range(1, most // r + 1) if (b := Banding(n, r)).candidate(threshold) >= recall]
    if not fit:
        raise ValueError("no banding of so few hash functions reaches that recall")
    return min(fit, key=lambda b: (sum(b.candidate(x / 100) for x in range(int(threshold * 100))), b.bands * b.rows))


@cache
def hash_functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    return rng.integers(0, 2**32, n, dtype=np.uint32), rng.integers(0, 2**32, n, dtype=np.uint32) | np.uint32(1)


def band_hashes(grams: np.ndarray, banding: Banding) -> np.ndarray:
    """One 64-bit hash for each band of a set that has a gram at least."""
    flip, factor = hash_functions(banding.bands * banding.rows)
    short = (grams >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(flip), 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for at in range(0, len(short), 2048):
            x = (short[at : at + 2048, None] ^ flip) * factor
            x ^= x >> np.uint32(15)
            np.minimum(low, x.min(axis=0), out=low)
        out = np.arange(1, banding.bands + 1, dtype=np.uint64)
        for column in low.reshape(banding.bands, banding.rows).T:
            out = (out ^ column) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(31)
        return out


def set_digest(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def pair_links(sets: list[np.ndarray], split: int, threshold: Fraction) -> np.ndarray:
    """Boolean matrix of the pairs (i < split, j >= split) of sets whose Jaccard similarity reaches the threshold."""
    sizes = np.array([len(s) for s in sets], np.int64)
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    # a gram counts only if it stands on both sides
    n = int(column.max()) + 1
    on = [np.zeros(n, bool), np.zeros(n, bool)]
    for side in (0, 1):
        on[side][column[(row >= split) == bool(side)]] = True
    useful = on[0] & on[1]
    place = np.cumsum(useful) - 1
    keep = useful[column]
    row, column = row[keep], place[column[keep]]
    common = np.zeros((split, len(sets) - split), np.int64)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for lo in range(0, int(useful.sum()), 8192):
        i, j = np.searchsorted(column, [lo, lo + 8192])
        dense = np.zeros((len(sets), 8192), np.float32)
        dense[row[i:j], column[i:j] - lo] = 1
        common += np.rint(dense[:split] @ dense[split:].T).astype(np.int64)
    union = sizes[:split, None] + sizes[None, split:] - common
    return common * threshold.denominator >= union * threshold.numerator


def roots(links: np.ndarray) -> np.ndarray:
    """Least member of each row's component in a symmetric boolean matrix."""
    label = np.arange(len(links))
    while True:
        near = np.minimum(label, np.where(links, label[None, :], len(links)).min(axis=1, initial=len(links)))
        near = near[near]
        if (near == label).all():
            return label
        label = near


def fingerprints(docs: DataFrame, size: int, banding: Banding) -> DataFrame:
    """(doc_id, tag, digest, grams, bands) for each document; bands is empty for a text without words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in slices(batch.column("text")):
                digest, grams, bands = [], [], []
                for s in shingle_sets(part, size):
                    digest.append(set_digest(s))
                    grams.append(len(s))
                    bands.append(band_hashes(s, banding).view(np.int64) if len(s) else np.zeros(0, np.int64))
                ends = np.cumsum([0, *map(len, bands)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, len(part)), batch.column("tag").slice(at, len(part)), pa.array(digest, pa.binary()), pa.array(grams, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(bands)))],
                    ["doc_id", "tag", "digest", "grams", "bands"],
                )

    rows = project(docs, doc_id="bigint", text="string").withColumn("tag", text_tag("text"))
    return rows.mapInArrow(tidy(run), "doc_id bigint, tag bigint, digest binary, grams bigint, bands array<bigint>")


def meetings(sets: DataFrame, stars: int) -> DataFrame:
    """(node, band, bucket, least) of the sets that share a band bucket with another, over sets(node, bands); `stars` bounds the bands of all sets."""
    bands = sets.select("node", F.posexplode("bands").alias("band", "bucket"))
    least = bands.groupBy("band", "bucket").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least")).where("n > 1").drop("n")
    least = stage_table(least, "ngram-buckets", stars)  # a table, so that the join can split a bucket that many share
    return stage_table(bands.join(least, ["band", "bucket"]), "ngram-meetings", stars)


def families(met: DataFrame, stars: int) -> DataFrame:
    """(node, family): the components of sets that meet a bucket's least one in MEETINGS bands or more."""
    star = met.where("node <> least").groupBy(F.col("node").alias("a"), F.col("least").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return components(star.where(F.col("n") >= MEETINGS).select("a", "b"), "families", stars).select("node", F.col("root").alias("family"))


def work_units(sets: DataFrame, met: DataFrame, threshold: Fraction, stars: int) -> DataFrame:
    """(node, units): in which units each set is verified, and against which blocks.

    A unit is a family (band -1) or a bucket that several families meet in. In a family all pairs are verified; in a
    bucket its largest family is verified against the others, and those against each other. Sets of
    BLOCK_GRAMS n-grams or more have units of their own for each class of sizes, as similar sets differ
    little in size; they are guests in the class below, where they meet no other guest.
    """
    own = stage_table(families(met, stars), "ngram-family", stars)
    step = float(1 / threshold) * 1.01
    size = F.when(F.col("grams") < BLOCK_GRAMS, 0).otherwise(1 + F.floor(F.log(F.col("grams") / BLOCK_GRAMS) / float(np.log(step)))).cast("int")
    sized = sets.select("node", "grams", size.alias("size")).distinct()
    inside = own.select("node", F.lit(-1).alias("band"), F.col("family").alias("bucket"), "family")
    across = met.join(own, "node", "left").select("node", "band", "bucket", F.coalesce("family", "node").alias("family"))
    several = across.groupBy("band", "bucket").agg(F.min("family").alias("lo"), F.max("family").alias("hi")).where("lo <> hi").select("band", "bucket")
    across = across.join(stage_table(several, "ngram-several", stars), ["band", "bucket"])
    roles = F.when(F.col("size") == 0, F.array(F.lit(0))).otherwise(F.array("size", F.col("size") - 1))
    rows = inside.unionByName(across).join(sized, "node").withColumn("class", F.explode(roles)).withColumn("guest", F.col("class") < F.col("size"))
    rows = stage_table(rows.drop("size"), "ngram-roles", stars)
    unit = ["band", "bucket", "class"]

    def blocks(n: Column, grams: Column) -> Column:
        return F.greatest(F.ceil(n / BLOCK_ROWS), F.ceil(grams / BLOCK_GRAMS)).cast("int")

    parts = rows.groupBy(*unit, "family").agg(F.count(F.lit(1)).alias("c"), F.sum("grams").alias("g"))
    shape = parts.groupBy(*unit).agg(F.sum("c").alias("n"), F.sum("g").alias("total"), F.max(F.struct("c", "g", "family")).alias("big"))
    shape = shape.where((F.col("n") > 1) & ((F.col("band") < 0) | (F.col("n") > F.col("big.c")))).select(
        *unit,
        F.col("big.family").alias("largest"),
        blocks(F.col("big.c"), F.col("big.g")).alias("many"),
        blocks(F.col("n") - F.col("big.c"), F.col("total") - F.col("big.g")).alias("rest"),
    )
    rows = rows.join(stage_table(shape, "ngram-units", stars), unit)
    main = F.col("family") == F.col("largest")
    block = F.when(main, F.pmod(F.xxhash64("node"), F.col("many"))).otherwise(F.col("many") + F.pmod(F.xxhash64("node"), F.col("rest"))).cast("int")
    # the blocks of the largest family come first; in a bucket they do not meet each other
    first, last = F.when((F.col("band") >= 0) & main, F.col("many")).otherwise(0), F.col("many") + F.col("rest") - 1
    rows = rows.select("node", F.struct(*unit, "guest", "family", block.alias("block"), first.cast("int").alias("first"), last.cast("int").alias("last")).alias("unit"))
    return rows.groupBy("node").agg(F.collect_list("unit").alias("units"))


def block_links(rows: list[dict], band: int, i: int, j: int, threshold: Fraction) -> np.ndarray:
    """Boolean matrix of the linked pairs that this pair of blocks has to find, over rows in order of their blocks."""
    sets = [np.frombuffer(r["body"], np.uint64) for r in rows]
    n = len(sets)
    links = np.zeros((n, n), bool)
    if i == j:
        links[:] = pair_links(sets + sets, n, threshold)
        np.fill_diagonal(links, False)
    else:
        split = sum(r["block"] == i for r in rows)
        if 0 < split < n:
            links[:split, split:] = pair_links(sets, split, threshold)
            links |= links.T
    guest = np.array([r["guest"] for r in rows], bool)
    links &= ~(guest[:, None] & guest[None, :])
    if band >= 0:
        family = np.array([r["family"] for r in rows], np.int64)
        bands = np.array([r["bands"] for r in rows], np.int64)
        links &= family[:, None] != family[None, :]
        for a, b in zip(*np.nonzero(links), strict=True):  # a pair counts in the first band that it shares
            links[a, b] = int(np.argmax(bands[a] == bands[b])) == band
    return links


def verify(members: DataFrame, docs: DataFrame, size: int, threshold: Fraction) -> tuple[DataFrame, DataFrame]:
    """Exact links between candidates.

    members: (digest, copies, bands, doc_id, tag, units) with one row for each
    different set. Returns links (digest, n) with the number of documents linked to
    each set by another set, and edges (a, b) that connect what is linked.
    """
    members = members.select("digest", "copies", "bands", "units", F.col("doc_id").alias("__id"), F.col("tag").alias("__tag"))
    texts = project(docs, doc_id="bigint", text="string").withColumn("tag", text_tag("text"))
    # one text for each set; several rows that repeat doc_id and text are told apart by nobody and fall together below
    chosen = texts.join(members, same(F.col("doc_id"), F.col("__id")) & (F.col("tag") == F.col("__tag")))
    rest = ["digest", "copies", "bands", "units"]

    def grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, part in slices(batch.column("text")):
                body = pa.array([s.tobytes() for s in shingle_sets(part, size)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(at, len(part)) for c in rest), body], [*rest, "body"])

    chosen = chosen.select(*rest, "text")
    rows = chosen.mapInArrow(tidy(grams), StructType([*chosen.drop("text").schema, StructField("body", BinaryType())]))
    rows = rows.withColumn("u", F.explode("units")).withColumn("other", F.explode(F.sequence("u.first", "u.last")))
    rows = rows.select(
        *(F.col(f"u.{c}") for c in ("band", "bucket", "class", "guest", "family", "block")),
        F.least("u.block", "other").alias("i"),
        F.greatest("u.block", "other").alias("j"),
        "digest",
        "copies",
        F.when(F.col("u.band") >= 0, F.col("bands")).alias("bands"),
        "body",
    )

    def check(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        band, _, _, i, j = (k.as_py() for k in key)
        first = {r["digest"]: r for r in table.select(["digest", "block", "guest", "family", "copies", "bands", "body"]).to_pylist()}  # repeated rows count once
        these = sorted(first.values(), key=lambda r: (r["block"], r["digest"]))
        links = block_links(these, band, i, j, threshold)
        weight = np.array([r["copies"] for r in these], np.int64)
        some = np.flatnonzero(links.any(axis=1))
        root = roots(links)
        return pa.table({"digest": pa.array([these[k]["digest"] for k in some], pa.binary()), "n": pa.array((links[some] @ weight).astype(np.int64)), "root": pa.array([these[root[k]]["digest"] for k in some], pa.binary())})

    linked = rows.groupBy("band", "bucket", "class", "i", "j").applyInArrow(check, "digest binary, n bigint, root binary")
    linked = stage_table(linked, "ngram-links")
    counts = linked.groupBy("digest").agg(F.sum("n").alias("n"))
    return counts, linked.where("digest <> root").select(F.col("digest").alias("a"), F.col("root").alias("b"))


def linked_sets(docs: DataFrame, size: int, threshold: Fraction, recall: float) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows (doc_id, tag, digest) of all documents; classes (digest, class_id, keep_tag, n)
    of the sets that more than one document has or that are linked to another set."""
    banding = choose_banding(float(threshold), recall)
    rows = stage_table(fingerprints(docs, size, banding), "ngram-rows")
    lead = F.struct(F.col("doc_id").isNull(), "doc_id", "tag")
    sets = (
        rows.where("grams > 0")
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct(lead.alias("lead"), "grams", "bands")).alias("r"))
        .select("digest", "copies", "r.lead.doc_id", "r.lead.tag", "r.grams", "r.bands", F.xxhash64("digest").alias("node"))
    )
    total = rows.count()
    sets = stage_table(sets, "ngram-sets")
    stars = total * banding.bands
    units = work_units(sets, meetings(sets, stars), threshold, stars)
    members = stage_table(sets.join(units, "node"), "ngram-members", total)
    counts, edges = verify(members, docs, size, threshold)
    root = components(edges, "classes", total).select(F.col("node").alias("digest"), "root")
    linked = (
        sets.select("digest", "copies", "doc_id", "tag")
        .join(root, "digest", "left")
        .join(counts, "digest", "left")
        .where("copies > 1 or n is not null")
        .select("digest", "copies", "doc_id", "tag", F.coalesce("root", "digest").alias("root"), F.coalesce("n", F.lit(0)).alias("n"))
    )
    linked = stage_table(linked, "ngram-linked", total)
    first = linked.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tag", "digest")).alias("f"))
    first = first.select("root", F.col("f.doc_id").alias("class_id"), F.col("f.tag").alias("keep_tag"), F.col("f.digest").alias("keep_digest"))
    first = stage_table(first, "ngram-first", total)
    classes = linked.join(first, "root").select(
        "digest", "class_id", "keep_tag", "keep_digest", (F.col("n") + F.col("copies") - 1).alias("n_links")
    )
    return rows.select("doc_id", "tag", "digest"), classes


def similar_texts(docs: DataFrame, size: int = SIZE, threshold: Fraction = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Rows (doc_id, class_id, n_links), one for each document.

    Two documents are linked when the Jaccard similarity of their sets of `size`
    lower-cased words in a row reaches `threshold`; n_links counts all documents
    that a document is linked to, copies included, and class_id is the least doc_id
    of its connected component. A text of fewer words than `size` has one n-gram of
    all its words. A text without words, as null and empty ones, is linked to nothing
    and is a class of its own. A null doc_id ranks after all others, and is a
    class_id only where a class has no other. Repeated rows are copies of each
    other. Texts are read whole. An empty table gives no rows.
    """
    rows, classes = linked_sets(docs, size, threshold, recall)
    joined = rows.join(classes, "digest", "left")
    alone = F.col("n_links").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
    )


def drop_similar(docs: DataFrame, size: int = SIZE, threshold: Fraction = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One document of each class, the one with the least doc_id, with all its columns."""
    rows, classes = linked_sets(docs, size, threshold, recall)
    judged = rows.join(classes, "digest")
    kept = same(F.col("doc_id"), F.col("class_id")) & (F.col("tag") == F.col("keep_tag"))
    return retain(docs, judged.select("doc_id", "tag", kept.alias("kept")))
