"""Names of the registered queries; each module of operators adds its own."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reelmill.views import kept_views, view, with_views

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
_LOADED: list[str] = []


def query(name: str, reads: str, sql: str | None = None, often: str = "", dealt: str = ""):
    """Registers an operator over views or base tables; sql states the same result for DuckDB, over the same names. often:
    views that the operator reads more than once and that cost much, which are written once. dealt: views dealt by video before others
    are made of them, where an operator's windows and groups are within a video: a line travels once, and its words and pairs don't."""
    names = tuple(reads.split())
    by_video = frozenset(dealt.split())
    kept = kept_views(names, tuple(often.split()))

    def add(operator):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            made: dict[str, DataFrame] = {}
            return operator(*(view(spark, sf_dir, n, kept, made, by_video) for n in names))

        _QUERIES[name] = run
        if sql:
            _SQL[name] = with_views(names, sql)
        return operator

    return add


def _load() -> None:
    if not _LOADED:
        for package in ("operators", "sources", "streaming"):
            found = importlib.import_module(f"reelmill.{package}")
            for module in sorted(m.name for m in pkgutil.iter_modules(found.__path__)):
                importlib.import_module(f"reelmill.{package}.{module}")
        _LOADED.append("all")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
