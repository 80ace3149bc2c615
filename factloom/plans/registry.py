"""All registered queries by name: a Spark callable and, where SQL can say it, the oracle text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Query:
    run: Callable
    oracle: str | None = None


QUERIES: dict[str, Query] = {}


def query(name: str, oracle: str | None = None):
    """Register the decorated function (spark, sf_dir) -> DataFrame under *name*."""

    def add(f):
        QUERIES[name] = Query(f, oracle)
        return f

    return add


def load() -> dict[str, Query]:
    """QUERIES, filled."""
    from . import queries  # noqa: F401  registers them

    return QUERIES
