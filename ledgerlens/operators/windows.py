"""Skew-safe running sums.

A window ``PARTITION BY key ORDER BY t`` sends every row of a key to one
task; with a hot key (a third of all rows) that task holds a third of the
data. ``exclusive_running_sum`` splits each key into ordered chunks (e.g. the
hour of the event): a window per (key, chunk) computes the local running sum,
a small aggregate of chunk totals gives each chunk its offset, and an
equi-join on (key, chunk) adds it back. Both the window and the join want the
data hash-partitioned on (key, chunk), so the plan shuffles the rows once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exclusive_running_sum(df: DataFrame, keys: Sequence[str], chunk: str,
                          order: Sequence[str | Column], value: str, out: str, source: DataFrame | None = None) -> DataFrame:
    """Sum of ``value`` over earlier rows of the same key (ordered by
    ``chunk`` then ``order``), 0 for the first row.

    ``chunk`` must be non-decreasing along ``order`` within a key (a time
    bucket of the ordering timestamp satisfies this). ``source`` is a frame with
    the same rows' keys, chunks and values that is cheaper to read than ``df``:
    the chunks' totals are taken from it."""
    return exclusive_running_sums(df, keys, chunk, order, {value: out}, source)


def exclusive_running_sums(df: DataFrame, keys: Sequence[str], chunk: str, order: Sequence[str | Column],
                           values: Mapping[str, str], source: DataFrame | None = None) -> DataFrame:
    """As ``exclusive_running_sum``, for several values in one pass."""
    keys = list(keys)
    part = keys + [chunk]
    w_local = (Window.partitionBy(*part).orderBy(*order)
               .rowsBetween(Window.unboundedPreceding, -1))
    local = df.withColumns({f"_ll_local_{v}": F.sum(v).over(w_local) for v in values})

    totals = (df if source is None else source).groupBy(*part).agg(*[F.sum(v).alias(f"_ll_total_{v}") for v in values])
    w_off = (Window.partitionBy(*keys).orderBy(chunk)
             .rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(*part, *[F.sum(f"_ll_total_{v}").over(w_off).alias(f"_ll_offset_{v}") for v in values])

    zero = {v: F.lit(0).cast(df.schema[v].dataType) for v in values}
    return (local.join(offsets, part, "inner")
            .withColumns({out: F.coalesce(f"_ll_local_{v}", zero[v]) + F.coalesce(f"_ll_offset_{v}", zero[v]) for v, out in values.items()})
            .drop(*[f"_ll_{k}_{v}" for v in values for k in ("local", "offset")]))
