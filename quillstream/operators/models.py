"""Which engine a folder of model files is for."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENGINES = ("matcha", "kokoro", "vits", "kitten")
#: Files of rules, in the order in which they apply.
RULES = ("phone.fst", "date.fst", "number.fst")
MANIFEST = "engine string, files map<string,string>"


def list_models(spark: SparkSession, path: str) -> DataFrame:
    """(model_dir, file_name, is_dir) of the files under a folder of model folders, and of the folders in between."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    tail = F.split(F.substring_index("path", path.rstrip("/").rsplit("/", 1)[-1] + "/", -1), "/")
    rows = found.select(tail[0].alias("model_dir"), tail[1].alias("file_name"), (F.size(tail) > 2).alias("is_dir"))
    return rows.where("file_name is not null").distinct()


def inspect(files: DataFrame) -> DataFrame:
    """One row for each model_dir of files (model_dir, file_name, is_dir): what its names tell."""
    name = F.col("file_name")
    onnx = name.endswith(".onnx")
    vocoder = onnx & F.lower(name).rlike("vocoder|vocos")
    least = lambda test: F.min(F.when(test, name))  # noqa: E731  names are listed in order
    return files.groupBy("model_dir").agg(
        F.sort_array(F.collect_set(F.when(onnx, name))).alias("onnx_files"),
        least(vocoder).alias("vocoder"),
        F.max(name == "tokens.txt").alias("has_tokens"),
        F.max(name == "voices.bin").alias("has_voices"),
        F.max(F.when(F.col("is_dir") & (name == "espeak-ng-data"), name)).alias("data_dir"),
        least(F.lower(name).rlike("^lexicon.*\\.txt\\z")).alias("lexicon"),
        F.array_intersect(F.array(*map(F.lit, RULES)), F.collect_set(F.when(name.isin(*RULES), name))).alias("rule_fsts"),
    ).withColumn("acoustic", F.coalesce(F.get(F.filter("onnx_files", lambda f: f != F.col("vocoder")), F.lit(0)), F.get("onnx_files", F.lit(0))))


def within(model_dir: Column, name: Column) -> Column:
    """The path of a file of the folder."""
    return F.concat(model_dir, F.when(name.startswith("/"), "").otherwise("/"), name)


def resolve(files: DataFrame, manifests: DataFrame | None = None, overrides: DataFrame | None = None) -> DataFrame:
    """(model_dir, engine, detected_by, status, n_onnx, model_files, rule_fsts) for each folder.

    An override comes before the manifest's engine, and that before detection; a folder
    that kokoro and kitten could both read is an error, as is one that nothing fits or an
    engine nobody knows. Files of a manifest replace those that are found. model_files and rule_fsts
    are paths within the folder.
    """
    rows = inspect(files)
    if manifests is not None:
        parsed = manifests.select("model_dir", F.from_json("manifest", MANIFEST, {"mode": "FAILFAST"}).alias("m"))
        rows = rows.join(parsed, "model_dir", "left")
    else:
        rows = rows.withColumn("m", F.lit(None).cast(f"struct<{MANIFEST.replace(' ', ':')}>".replace(",:", ",")))
    rows = rows.join(overrides, "model_dir", "left") if overrides is not None else rows.withColumn("override", F.lit(None).cast("string"))
    n, voices, tokens = F.size("onnx_files"), F.col("has_voices"), F.col("has_tokens")
    given = F.coalesce(F.nullif("override", F.lit("")), F.nullif("m.engine", F.lit("")))
    ambiguous = (n == 1) & voices & F.col("lexicon").isNull()
    detected = F.when((n >= 2) & F.col("vocoder").isNotNull(), "matcha").when((n == 1) & voices, "kokoro").when((n == 1) & tokens & ~voices, "vits")
    engine = F.coalesce(given, F.when(~ambiguous, detected))
    by = F.when(F.nullif("override", F.lit("")).isNotNull(), "override").when(given.isNotNull(), "manifest").when(engine.isNotNull(), "heuristic")
    status = F.when(given.isNull() & ambiguous, "ambiguous: kokoro, kitten").when(engine.isNull(), "unrecognized").when(~engine.isin(*ENGINES), "unknown engine").otherwise("ok")
    first = F.get("onnx_files", F.lit(0))
    shared = [("dataDir", F.col("data_dir")), ("lexicon", F.col("lexicon"))]
    shapes = {
        "vits": [("model", first), ("tokens", F.lit("tokens.txt")), *shared],
        "kokoro": [("model", first), ("voices", F.lit("voices.bin")), ("tokens", F.lit("tokens.txt")), *shared],
        "matcha": [("acousticModel", F.col("acoustic")), ("vocoder", F.col("vocoder")), ("tokens", F.lit("tokens.txt")), *shared],
        "kitten": [("model", first), ("voices", F.lit("voices.bin")), ("tokens", F.lit("tokens.txt")), shared[0]],
    }
    built = None
    for name, parts in shapes.items():
        one = F.map_filter(F.create_map(*[x for k, v in parts for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())
        built = F.when(engine == name, one) if built is None else built.when(engine == name, one)
    ok = status == "ok"
    return rows.select(
        "model_dir", F.when(ok, engine).alias("engine"), F.when(ok, by).alias("detected_by"), status.alias("status"), n.alias("n_onnx"),
        F.when(ok, F.transform_values(F.coalesce(F.col("m.files"), built), lambda _, f: within(F.col("model_dir"), f))).alias("model_files"), F.array_join(F.transform("rule_fsts", lambda f: within(F.col("model_dir"), f)), ",").alias("rule_fsts"),
    )


def model_path(name: str, plugin_dir: str) -> str:
    """An absolute path as it is, another one within the folder of models."""
    if not name.strip():
        raise ValueError("no model is chosen")
    return name if PurePosixPath(name).is_absolute() else str(PurePosixPath(plugin_dir) / "models" / name)
