"""Configuration: values of a command line over those of a command's section over those at the top level."""

from __future__ import annotations

import logging
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import fields
from typing import Any

from pyspark.sql import SparkSession

log = logging.getLogger(__name__)


def canonical(name: str) -> str:
    return name.lstrip("-").replace("-", "_")


def parse_flags(arguments: list[str], known: set[str]) -> tuple[dict[str, Any], list[str]]:
    """Values of --name value, --name=value and --name, and what else there is. Unknown flags are warned of and skipped with their value."""
    found: dict[str, Any] = {}
    rest: list[str] = []
    at = 0
    while at < len(arguments):
        word = arguments[at]
        at += 1
        if not word.startswith("-") or word == "-":
            rest.append(word)
            continue
        name, has, value = canonical(word.partition("=")[0]), "=" in word, word.partition("=")[2]
        if not has and at < len(arguments) and not arguments[at].startswith("-"):
            value, has = arguments[at], True
            at += 1
        if name not in known:
            log.warning("unknown flag %s is skipped", word)
            continue
        found[name] = value if has else True
    return found, rest


def resolve(kind: type, flags: dict, section: dict | None = None, top: dict | None = None):
    """A dataclass filled from the three layers; names may have - or _, values are given the fields' types."""
    layers = [{canonical(k): v for k, v in (d or {}).items()} for d in (flags, section, top)]
    values = {}
    for f in fields(kind):
        for layer in layers:
            if f.name in layer and not isinstance(layer[f.name], dict):
                values[f.name] = _typed(layer[f.name], f.type)
                break
    return kind(**values)


def _typed(value: Any, kind: Any) -> Any:
    name = kind if isinstance(kind, str) else getattr(kind, "__name__", "")
    if name == "bool":
        return value if isinstance(value, bool) else str(value).lower() in ("1", "true", "yes", "on")
    if name in ("int", "float", "str") and not isinstance(value, (dict, list)):
        return {"int": int, "float": float, "str": str}[name](value)
    return value


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings for the time of a block, dots written as double underscores; the old ones come back."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    old = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, str(v))
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
