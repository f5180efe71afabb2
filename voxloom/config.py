"""Typed settings from environment variables."""

from __future__ import annotations

import dataclasses
import json
import os
import types
import typing
from typing import Any, Mapping, TypeVar

T = TypeVar("T")
TRUE = ("1", "true", "yes", "on")
NULL = ("null", "none")
STEPS = ("download", "transcribe", "segment", "cluster", "export")


def coerce(raw: str, kind: Any) -> Any:
    """Text as int, float, bool, str, list or an optional of these; null words are None."""
    args = [a for a in typing.get_args(kind) if a is not type(None)]
    if typing.get_origin(kind) in (typing.Union, types.UnionType):
        return None if raw.strip().lower() in ("", *NULL) else coerce(raw, args[0])
    if raw.strip().lower() in NULL:
        return None
    if kind is bool:
        return raw.strip().lower() in TRUE
    if kind in (int, float):
        return kind(raw.strip())
    if kind is list or typing.get_origin(kind) is list:
        items = json.loads(raw) if raw.strip().startswith("[") else [x.strip() for x in raw.split(",") if x.strip()]
        return [coerce(str(x), args[0]) if args else x for x in items]
    return raw


def from_env(kind: type[T], prefix: str, env: Mapping[str, str] | None = None) -> T:
    """A dataclass with the fields that PREFIX_FIELD variables set, defaults for the rest."""
    env = os.environ if env is None else env
    hints = typing.get_type_hints(kind)
    found = {f.name: env[k] for f in dataclasses.fields(kind) if (k := f"{prefix}_{f.name}".upper()) in env}
    return kind(**{n: coerce(raw, hints[n]) for n, raw in found.items()})


def sources(raw: str) -> list[dict]:
    """A JSON array of sources; a slug given twice is an error."""
    rows = json.loads(raw)
    slugs = [r["slug"] for r in rows]
    twice = sorted({s for s in slugs if slugs.count(s) > 1})
    if twice:
        raise ValueError(f"given twice: {', '.join(twice)}")
    return rows


def pick(rows: list[dict], wanted: list[str]) -> list[dict]:
    """The sources of some slugs; unknown ones are an error that lists them."""
    missing = sorted(set(wanted) - {r["slug"] for r in rows})
    if missing:
        raise ValueError(f"unknown: {', '.join(missing)}")
    return [r for r in rows if r["slug"] in wanted]


def steps(asked: list[str]) -> list[str]:
    """Steps in their own order; 'all' is every step, unknown ones are left out."""
    return [s for s in STEPS if s in asked or "all" in asked]
