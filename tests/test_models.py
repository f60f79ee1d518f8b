import pytest

from quillstream.operators import models as M


def resolve(spark, folders, manifests=(), overrides=()):
    files = spark.createDataFrame([(d, f, f == "espeak-ng-data") for d, fs in folders.items() for f in fs.split()], "model_dir string, file_name string, is_dir boolean")
    m = spark.createDataFrame(list(manifests), "model_dir string, manifest string") if manifests else None
    o = spark.createDataFrame(list(overrides), "model_dir string, override string") if overrides else None
    return {r.model_dir: r for r in M.resolve(files, m, o).collect()}


def test_detection(spark):
    got = resolve(spark, {"a": "m.onnx voices.bin tokens.txt", "b": "m.onnx voices.bin tokens.txt lexicon-us.txt", "c": "m.onnx tokens.txt date.fst phone.fst", "d": "a.onnx Vocos.onnx tokens.txt", "e": "x.txt", "f": "a.onnx b.onnx tokens.txt"})
    assert {d: (r.engine, r.status) for d, r in got.items()} == {
        "a": (None, "ambiguous: kokoro, kitten"), "b": ("kokoro", "ok"), "c": ("vits", "ok"), "d": ("matcha", "ok"), "e": (None, "unrecognized"), "f": (None, "unrecognized"),
    }
    assert got["c"].rule_fsts == "c/phone.fst,c/date.fst" and got["b"].model_files["lexicon"] == "b/lexicon-us.txt"
    assert got["d"].model_files["acousticModel"] == "d/a.onnx" and got["d"].model_files["vocoder"] == "d/Vocos.onnx"


def test_manifest_and_override(spark):
    folders = {k: "m.onnx voices.bin tokens.txt" for k in "abcd"}
    got = resolve(spark, folders, [("a", '{"engine": "kitten"}'), ("b", '{"engine": "kokoro", "files": {"model": "z.onnx"}}'), ("d", '{"engine": "nobody"}')], [("b", "kitten"), ("c", "kokoro")])
    assert {d: (r.engine, r.detected_by, r.status) for d, r in got.items()} == {
        "a": ("kitten", "manifest", "ok"), "b": ("kitten", "override", "ok"), "c": ("kokoro", "override", "ok"), "d": (None, None, "unknown engine"),
    }
    assert got["b"].model_files == {"model": "b/z.onnx"}


def test_acoustic_model_is_the_first_file_that_is_not_the_vocoder(spark):
    got = resolve(spark, {"a": "a_vocos.onnx b_vocos.onnx", "b": "vocos.onnx"}, overrides=[("b", "matcha")])
    assert got["a"].model_files["acousticModel"] == "a/b_vocos.onnx" and got["b"].model_files["acousticModel"] == "b/vocos.onnx"


def test_malformed_manifest_is_an_error(spark):
    with pytest.raises(Exception, match="(?i)malformed"):
        resolve(spark, {"a": "m.onnx"}, [("a", "{nonsense")])


def test_listing(spark, tmp_path):
    for f in ("voice/m.onnx", "voice/tokens.txt", "voice/espeak-ng-data/x", "other/a.onnx"):
        (tmp_path / "models" / f).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "models" / f).write_text("x")
    got = sorted(tuple(r) for r in M.list_models(spark, str(tmp_path / "models")).collect())
    assert got == [("other", "a.onnx", False), ("voice", "espeak-ng-data", True), ("voice", "m.onnx", False), ("voice", "tokens.txt", False)]


def test_paths():
    assert M.model_path("/x/y", "/p") == "/x/y" and M.model_path("v", "/p") == "/p/models/v"
    with pytest.raises(ValueError):
        M.model_path(" ", "/p")
