"""Configurations of runs: read as a mapping, checked against a schema of rules, all problems at once.

A schema is a mapping of fields to rules or to schemas. A rule takes a value and returns what is wrong
with it, or None.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from pathlib import Path
from typing import Any

Rule = Callable[[Any], str | None]


def read_config(path: str) -> dict:
    """A mapping from a JSON or YAML file (YAML only where its module is there)."""
    body = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        held = json.loads(body)
    else:
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError(f"{path}: YAML cannot be read here, give the configuration as JSON") from e
        held = yaml.safe_load(body)
    if not isinstance(held, dict):
        raise ValueError(f"{path}: not a mapping")
    return held


def text(value: Any) -> str | None:
    return None if isinstance(value, str) else "must be text"


def matching(pattern: str) -> Rule:
    return lambda value: text(value) or (None if re.fullmatch(pattern, value) else f"must match {pattern}")


def whole(value: Any) -> str | None:
    """A whole number of 1 or more; true and false are no numbers."""
    return None if isinstance(value, int) and not isinstance(value, bool) and value >= 1 else "must be a whole number of 1 or more"


def positive(value: Any) -> str | None:
    return None if isinstance(value, int | float) and not isinstance(value, bool) and value > 0 else "must be a number above 0"


def whole_or(word: str) -> Rule:
    return lambda value: None if value == word or whole(value) is None else f"must be a whole number of 1 or more, or '{word}'"


def choices(allowed: Iterable[str]) -> Rule:
    """A list of allowed values, not empty, none twice."""
    known = set(allowed)

    def rule(value: Any) -> str | None:
        if not isinstance(value, list) or not value:
            return "must be a list with something in it"
        odd = [v for v in value if not isinstance(v, str) or v not in known]
        return f"unknown: {odd}" if odd else "repeats a value" if len(set(value)) < len(value) else None

    return rule


def existing(root: str = ".") -> Rule:
    return lambda value: text(value) or (None if (Path(root) / value).exists() else f"not found: {value}")


def problems(config: Any, schema: dict, at: str = "") -> list[tuple[str, str]]:
    """(field, problem) for each missing or unknown field and each broken rule."""
    if not isinstance(config, dict):
        return [(at or "config", "must be a mapping")]
    named = lambda key: f"{at}.{key}" if at else str(key)
    found = [(named(k), "missing") for k in schema if k not in config] + [(named(k), "unknown") for k in config if k not in schema]
    for key, rule in schema.items():
        if key not in config:
            continue
        if isinstance(rule, dict):
            found += problems(config[key], rule, named(key))
        elif wrong := rule(config[key]):
            found.append((named(key), wrong))
    return found


def named_like_file(config: dict, path: str, field: str = "slug") -> list[tuple[str, str]]:
    """A configuration carries the name of its file."""
    return [] if config.get(field) == Path(path).stem else [(field, f"must be {Path(path).stem}")]


def checked(path: str, schema: dict) -> dict:
    """The configuration of a file, or an error with all that is wrong."""
    config = read_config(path)
    wrong = problems(config, schema) + named_like_file(config, path)
    if wrong:
        raise ValueError("; ".join(f"{field}: {problem}" for field, problem in wrong))
    return config
