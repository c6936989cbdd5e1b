import json

import pytest

from linkloom import config


def test_inheritance_and_overrides(tmp_path):
    (tmp_path / "base.json").write_text(json.dumps({"a": {"x": 1, "y": [1]}, "b": 2}))
    (tmp_path / "own.json").write_text(json.dumps({"defaults": "base.json", "a": {"x": 5}}))
    got = config.load(tmp_path / "own.json", ["a.z=true", "b=text", "c.d=0.5"])
    assert got == {"a": {"x": 5, "y": [1], "z": True}, "b": "text", "c": {"d": 0.5}}


def test_errors(tmp_path):
    (tmp_path / "self.json").write_text(json.dumps({"defaults": "self.json"}))
    with pytest.raises(ValueError, match="itself"):
        config.load(tmp_path / "self.json")
    (tmp_path / "a.json").write_text("{}")
    with pytest.raises(ValueError, match="form"):
        config.load(tmp_path / "a.json", ["nothing"])
