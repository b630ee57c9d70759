"""Queries over the given tables, one module per operator family."""

from __future__ import annotations

import importlib

from corpusqa.plans.registry import QUERIES, SQL, Query

FAMILIES = ("text", "profile", "search", "vectors", "answers", "records", "evaluation")


def _load() -> None:
    for family in FAMILIES:
        importlib.import_module(f"corpusqa.plans.{family}")


def all_queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
