"""Registered queries: one Spark callable ``(spark, sf_dir) -> DataFrame`` per
inventory item, with the DuckDB SQL that computes the same result where SQL
can express it. Computed columns carry the same alias on both sides; derived
doubles are rounded to 6 decimals on both sides so summation order does not
matter."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .oracle_views import with_views
from .views import view

QueryFn = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def register(name: str, sql: str | None = None, views: tuple[str, ...] = ()):
    def deco(fn: QueryFn) -> QueryFn:
        REGISTRY[name] = (fn, with_views(sql, *views) if (sql and views) else sql)
        return fn
    return deco


def r6(c) -> F.Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), 6)


def T(spark, sf):  # noqa: N802 - view names follow FIXTURES.md
    return view(spark, sf, "T")


def X(spark, sf):  # noqa: N802 - T without balances: one scan, no window
    return view(spark, sf, "X")


def SC(spark, sf):  # noqa: N802 - the columns of S that need customers only
    return view(spark, sf, "SC")


def SO(spark, sf):  # noqa: N802 - the columns of S that need orders only
    return view(spark, sf, "SO")


def P(spark, sf):  # noqa: N802
    return view(spark, sf, "P")


def S(spark, sf):  # noqa: N802
    return view(spark, sf, "S")


def V(spark, sf):  # noqa: N802
    return view(spark, sf, "V")


# Import the modules that register queries (side effect: fill REGISTRY).
from . import queries_fraud  # noqa: E402,F401
from . import queries_customers  # noqa: E402,F401
from . import queries_scoring  # noqa: E402,F401
from . import queries_models  # noqa: E402,F401
from . import queries_monitoring  # noqa: E402,F401
from . import queries_sources  # noqa: E402,F401
