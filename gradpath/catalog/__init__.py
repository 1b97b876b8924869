"""The registered queries, each with the SQL that checks it where SQL can say it."""

from __future__ import annotations

from importlib import import_module

from gradpath.catalog.registry import ORACLES, QUERIES

MODULES = ["graph_queries", "profile_queries", "score_queries", "text_queries", "model_queries"]


def _load() -> None:
    for name in MODULES:
        import_module(f"gradpath.catalog.{name}")


def all_queries() -> dict:
    _load()
    return dict(QUERIES)


def all_oracles() -> dict:
    _load()
    return dict(ORACLES)
