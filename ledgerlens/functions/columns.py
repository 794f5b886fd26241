"""Column-expression helpers. All of them stay JVM-side (no Python UDFs), so
they fuse into whole-stage codegen with the surrounding projection."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col_or(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_ratio(num: str | Column, den: str | Column) -> Column:
    """``num / den`` with 0 or null denominators giving null (pandas turns the
    0 into NaN first, then inf into NaN). ``try_divide`` never raises under
    ANSI mode."""
    return F.try_divide(col_or(num).cast("double"), F.nullif(col_or(den).cast("double"), F.lit(0.0)))


def floor_div(c: str | Column, d: int) -> Column:
    """Python ``//``: floors for negatives too (Spark ``div`` truncates)."""
    return F.floor(col_or(c) / F.lit(d)).cast("int")


def null_safe_sum(cols: Iterable[str | Column]) -> Column:
    """Row-wise sum that skips missing terms, like ``DataFrame.sum(axis=1)``."""
    terms = [F.coalesce(col_or(c), F.lit(0)) for c in cols]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def flag(cond: Column) -> Column:
    """Boolean test as 0/1 where a null comparison counts as 0."""
    return F.coalesce(cond, F.lit(False)).cast("int")
