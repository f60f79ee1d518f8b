"""Helpers that the operators share: input columns, the shared folder, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_FILE = 250_000
#: Edges, each counted in both directions, up to which the driver finds components itself; of more, rounds over tables do.
DRIVER_EDGES = 250_000
_WRITTEN: list[str] = []
_STEPS: dict[str, list[str]] = {}


def project(df: DataFrame, **types: str) -> DataFrame:
    """Select columns by exact name, cast, whatever else the table holds.

    Columns are taken by position, so extra columns whose names differ only by
    case, or repeat a name, never make a reference ambiguous. Of columns with the
    very same name the first counts; a missing column is read as null.
    """
    names = df.columns
    plain = df.toDF(*[f"_{i}" for i in range(len(names))])
    return plain.select(*[found(names, n).cast(kind).alias(n) for n, kind in types.items()])


def found(names: list[str], name: str) -> Column:
    """The column of that name in a table whose columns are called _0, _1, and so on."""
    if name in names:
        return F.col(f"_{names.index(name)}")
    lowered = [n.lower() for n in names]
    return F.col(f"_{lowered.index(name.lower())}") if name.lower() in lowered else F.lit(None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only where ``spark.checkpoint.dir`` is unset, as in a local test, a temporary
    folder is made and set; on a cluster the setting has to be there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="quillstream-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def stage_table(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends here,
    and a lost executor costs no more than the stage that it worked on.

    `rows` bounds the number of rows of a narrow table; it then gets a file for each
    ROWS_PER_FILE of them, four at least, instead of one for each shuffle partition.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(4, -(-rows // ROWS_PER_FILE)))
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders in whatever file system they are."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(conf).delete(path, True)


def cleanup(spark: SparkSession) -> None:
    """Remove the tables that stage_table wrote in this process; call it when results are stored."""
    remove(spark, _WRITTEN)
    _WRITTEN.clear()


@contextmanager
def successive(spark: SparkSession, name: str) -> Iterator[None]:
    """For steps of which each one's result is stored before the next begins: remove the
    tables that the step of that name before has left, and no others."""
    remove(spark, _STEPS.pop(name, []))
    at = len(_WRITTEN)
    yield
    _STEPS[name] = _WRITTEN[at:]
    del _WRITTEN[at:]


def same(left: Column, right: Column) -> Column:
    """Equality under which null equals null."""
    return left.eqNullSafe(right)


def components(edges: DataFrame, name: str = "links", rows: int | None = None) -> DataFrame:
    """Connected components of edges(a, b): rows (node, root), root the smallest node.

    Each round hooks every node to the least label around it and then jumps to the
    label's own label, so that rounds grow with the logarithm of a path's length.
    Labels and edges stay in tables; the driver sees only the number of changes. A round has a dozen stages, of which
    the driver keeps a record, so DRIVER_EDGES edges at most, 8 MB or so, are solved there without any round.
    `rows` bounds the number of edges. A node with many edges is met by partial aggregation and by joins that can be
    split, never by a group in one task.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stage_table(both.where("a <> b").distinct(), f"{name}-edges", rows and 2 * rows)
    n = both.count()
    if n <= DRIVER_EDGES:
        return stage_table(least_nodes(both), f"{name}-labels", n)
    rows = rows and n
    labels = stage_table(
        both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")),
        f"{name}-labels",
        rows,
    )
    while True:
        around = (
            both.join(labels.select(F.col("node").alias("b"), F.col("root").alias("r")), "b")
            .groupBy("a")
            .agg(F.min("r").alias("m"))
        )
        hooked = labels.join(around.select(F.col("a").alias("node"), "m"), "node", "left").select(
            "node", "root", F.least("root", F.coalesce("m", "root")).alias("near")
        )
        hooked = stage_table(hooked, f"{name}-hooked", rows)
        # a root that learned of a smaller label passes it to all that point to it
        better = hooked.groupBy("root").agg(F.min("near").alias("n"))
        jump = better.join(
            hooked.select(F.col("node").alias("n"), F.col("near").alias("far")), "n", "left"
        ).select("root", F.least("n", F.coalesce("far", "n")).alias("best"))
        after = hooked.join(jump, "root").select("node", F.least("near", "best").alias("root"), F.col("root").alias("was"))
        after = stage_table(after, f"{name}-labels", rows)
        changed = after.where("root <> was").limit(1).count()
        labels = after.select("node", "root")
        if not changed:
            return labels


def least_nodes(both: DataFrame) -> DataFrame:
    """(node, root) as components gives them, of edges(a, b) in both directions that the driver can hold."""
    table = both.toArrow()
    nodes = pc.unique(table["a"])
    nodes = nodes.take(pc.array_sort_indices(nodes))
    a, b = (pc.index_in(table[c], nodes).to_numpy() for c in ("a", "b"))
    label = np.arange(len(nodes))
    while True:
        near = label.copy()
        np.minimum.at(near, a, label[b])
        np.minimum.at(near, label[a], label[b])
        near = near[near]
        if (near == label).all():
            break
        label = near
    kind = both.schema["a"].dataType.simpleString()
    return both.sparkSession.createDataFrame(pa.table({"node": nodes, "root": nodes.take(pa.array(label))}), f"node {kind}, root {kind}")


def text_tag(column: str) -> Column:
    """64 bits of a text; with doc_id they tell the rows of a table apart."""
    return F.xxhash64(F.coalesce(F.col(column), F.lit("")))


def retain(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """The rows of `docs` that `judged` (doc_id, tag, kept) keeps, with all columns.

    Rows are found by doc_id, null included, and text_tag. Where a row that stays and
    rows that go repeat both, one of them stays.
    """
    pairs = judged.groupBy("doc_id", "tag").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("kept").cast("bigint")).alias("stay")
    )
    pairs = stage_table(pairs.where("stay < n"), "judged")
    gone, twins = pairs.where("stay = 0"), pairs.where("stay > 0")
    names = docs.columns
    # columns by position, so that clashing names stay as they are
    plain = docs.toDF(*[f"_{i}" for i in range(len(names))])
    plain = plain.select("*", found(names, "doc_id").cast("bigint").alias("__id"), found(names, "text").cast("string").alias("__text"))
    plain = plain.withColumn("__tag", text_tag("__text")).drop("__text")

    def on(other: DataFrame) -> tuple[DataFrame, Column]:
        other = other.select(F.col("doc_id").alias("__oid"), F.col("tag").alias("__otag"))
        return other, same(F.col("__id"), F.col("__oid")) & (F.col("__tag") == F.col("__otag"))

    stay = plain.join(*on(gone), "left_anti")
    if twins.limit(1).count():
        single = stay.join(*on(twins), "left_semi").dropDuplicates(["__id", "__tag"])
        stay = stay.join(*on(twins), "left_anti").union(single)
    return stay.select(*[f"_{i}" for i in range(len(names))]).toDF(*names)
