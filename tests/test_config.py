import json

import pytest

from quillstream.functions import config as C


def test_merge_keeps_the_keys_of_the_base():
    assert C.deep_merge({"a": {"x": 1}}, {"a": {"y": 2}, "b": 3}) == {"a": {"x": 1}}
    assert C.deep_merge({"a": [1, 2], "b": {"c": 1}}, {"a": [3], "b": {"c": None}}) == {"a": [3], "b": {"c": None}}


def test_round_trip():
    text = C.export_json(C.Settings(numThreads=4, modelDir="m"))
    again = C.import_json(C.Settings(), text)
    assert again.numThreads == 4 and again.modelDir == "m" and again.config == C.Config()


@pytest.mark.parametrize("threads", [0, -1, "4", True, None, float("inf")])
def test_bad_threads_are_ignored(threads):
    raw = {"config": C.to_dict(C.Config()), "model": {"numThreads": threads}}
    assert C.import_json(C.Settings(), json.dumps(raw)).numThreads == 2


@pytest.mark.parametrize("text", ["[]", "{}", '{"config": 3}'])
def test_import_needs_a_config(text):
    with pytest.raises(ValueError):
        C.import_json(C.Settings(), text)


def test_stored_settings():
    s = C.load_settings({"speed": 1.5, "nonsense": 1, "lastPositions": {"a.pdf": 3}, "config": {"tables": {"mode": "skip"}, "substitutions": [{"match": "x", "replace": "y"}]}})
    assert s.speed == 1.5 and s.lastPositions == {"a.pdf": 3} and s.config.tables.mode == "skip" and s.config.tables.enabled
    assert s.config.substitutions == (C.Substitution("x", "y"),)


def test_lists_of_editors():
    assert C.comma_list(" a, ,b ,") == ["a", "b"] and C.line_list("a\n\n b \n") == ["a", "b"]


def test_selection_switches_off_what_needs_a_document():
    s = C.Config().for_selection()
    assert not (s.removeBoilerplate.enabled or s.tables.enabled or s.structuralPauses.enabled) and s.brackets.square.enabled and s.headings.enabled
