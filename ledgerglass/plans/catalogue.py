"""All queries of the catalogue engine by name, each with the SQL that DuckDB runs for it."""

from __future__ import annotations

from . import documents, products, releases, rules, search, spellings, texts, validity  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
