"""Query registry: name -> (spark callable, DuckDB oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from exposa.plans.oracle_ctes import with_ctes

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None, ctes: tuple[str, ...] = ()):
    """Decorator: register a (spark, sf_dir) -> DataFrame query.

    ``sql`` is the DuckDB equivalent; ``ctes`` names the stage CTEs it reads.
    Queries without SQL get the driver's rows-only check and own tests.
    """
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_ctes(sql, *ctes)
        return fn
    return deco


def rnd(col: str, digits: int = 6) -> str:
    """SQL text rounding a double column the same way the Spark side does."""
    return f"round({col}, {digits}) AS {col}"
