"""Nested settings on the driver: files that inherit from a default file, and dotted overrides. JSON; YAML where a parser is installed."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

try:
    import yaml
except ImportError:
    yaml = None


def merged(base: dict, over: dict) -> dict:
    """``over`` laid on ``base``: dictionaries merge, all else replaces. Neither argument changes."""
    out = dict(base)
    for key, value in over.items():
        out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def load(path: str | Path, overrides: list[str] | None = None, _above: tuple[Path, ...] = ()) -> dict[str, Any]:
    """Settings of a file over those of its ``defaults`` file, then ``a.b=value`` overrides; values are JSON, or text if they aren't.

    A file that inherits from itself, and an override without ``=``, raise ValueError.
    """
    path = Path(path).resolve()
    if path in _above:
        raise ValueError(f"{path} inherits from itself")
    text = path.read_text(encoding="utf-8")
    own = yaml.safe_load(text) if yaml and path.suffix in (".yaml", ".yml") else json.loads(text)
    below = own.pop("defaults", None)
    out = merged(load(path.parent / below, None, (*_above, path)), own) if below else own
    for item in overrides or []:
        key, sep, raw = item.partition("=")
        if not sep or not key:
            raise ValueError(f"override {item!r} isn't of the form a.b=value")
        try:
            value = json.loads(raw)
        except json.JSONDecodeError:
            value = raw
        for part in reversed(key.split(".")):
            value = {part: value}
        out = merged(out, value)
    return out
