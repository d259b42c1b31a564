"""Settings of a run from JSON; keys that aren't known are refused."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, is_dataclass


@dataclass
class Book:
    export_levels: int = 20
    buffer_max_events: int = 20_000
    stale_after_ms: int = 5_000


@dataclass
class Backfill:
    window_hours: float = 24.0
    max_attempts: int = 5


@dataclass
class Settings:
    symbols: list[str]
    data_dir: str
    book: Book = field(default_factory=Book)
    backfill: Backfill = field(default_factory=Backfill)


def parsed(kind, values: dict, where: str = "settings"):
    """A dataclass of values; unknown or missing keys, and values of another type, raise with their place."""
    known = {f.name: f for f in fields(kind)}
    if unknown := sorted(set(values) - set(known)):
        raise ValueError(f"{where}: unknown keys {unknown}")
    out = {}
    for name, value in values.items():
        default = known[name].default_factory() if callable(known[name].default_factory) else None
        if is_dataclass(default):
            out[name] = parsed(type(default), value, f"{where}.{name}")
        else:
            numeric = known[name].type in ("int", "float")
            if numeric and (isinstance(value, bool) or not isinstance(value, int if known[name].type == "int" else (int, float)) or value <= 0):
                raise ValueError(f"{where}.{name}: {value!r} isn't a positive number")
            out[name] = value
    try:
        return kind(**out)
    except TypeError as e:
        raise ValueError(f"{where}: {e}") from None


def read(path: str) -> Settings:
    with open(path) as f:
        return parsed(Settings, json.load(f))
