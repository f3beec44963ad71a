"""All named queries and the DuckDB SQL that checks them."""

from __future__ import annotations

from importlib import import_module

from .book import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

for _part in ("exploration", "segments", "corpora", "scores", "runs", "studies", "measures", "files"):
    import_module(f"segno.plans.{_part}")
