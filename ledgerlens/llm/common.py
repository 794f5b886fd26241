"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it back.

    The table survives lost executors, cuts the lineage and is computed once.
    Every call takes a path of its own, so that reruns never mix."""
    spark = df.sparkSession
    path = shared_path(spark, "llm-tables", f"{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """As ``materialize``, in buckets by ``key``: a join on it reads the table
    where it lies and shuffles the other side only."""
    spark = df.sparkSession
    unique = f"{name}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (df.write.option("compression", "zstd").option("path", shared_path(spark, "llm-tables", unique))
     .bucketBy(n, key).sortBy(key).saveAsTable(unique))
    return spark.table(unique)


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """The words of a text, as an array (null text: none)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary array without a copy;
    null entries have length zero. The offsets start at 0."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        dtype = np.int64
    else:
        dtype = np.int32
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, dtype=dtype)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[offs[0]:offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def one_array(column) -> pa.Array:
    """A chunked array as one array."""
    if isinstance(column, pa.ChunkedArray):
        return column.chunk(0) if column.num_chunks == 1 else column.combine_chunks()
    return column


def regrouped(batches, column: str, most_bytes: int):
    """Arrow batches re-cut so that each holds about ``most_bytes`` of
    ``column`` (one row at least); small neighbours are joined."""
    held: list[pa.RecordBatch] = []
    held_bytes = 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = batch.column(batch.schema.get_field_index(column))
        lengths = np.diff(byte_view(size)[1])
        start = 0
        ends = np.cumsum(lengths)
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            room = most_bytes - held_bytes
            stop = int(np.searchsorted(ends, before + room, side="right"))
            stop = max(stop, start + (0 if held else 1))
            if stop > start:
                held.append(batch.slice(start, stop - start))
                held_bytes += int(ends[stop - 1] - before)
                start = stop
            if start < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, held_bytes = [], 0
    if held:
        yield pa.Table.from_batches(held)


def worker_state(name: str, make):
    """An object that a Python worker makes once and keeps between its tasks."""
    import sys
    import types

    store = sys.modules.setdefault("_ledgerlens_worker_state", types.ModuleType("_ledgerlens_worker_state"))
    if not hasattr(store, name):
        setattr(store, name, make())
    return getattr(store, name)


def complete_runs(batches, keys: list[str]):
    """Tables of sorted rows in which every run of equal ``keys`` is whole,
    with the runs' starts and the end; a run that goes on in the next batch is
    held back."""
    held: pa.Table | None = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        t = pa.Table.from_batches([batch])
        t = t if held is None else pa.concat_tables([held, t])
        edges = run_edges(t, keys)
        last = int(edges[-2])
        if last:
            yield t.slice(0, last), edges[:-1]
        held = t.slice(last).combine_chunks()
    if held is not None:
        yield held, run_edges(held, keys)


def run_edges(t: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(t.num_rows, bool)
    new[:1] = True
    for k in keys:
        x = t[k].to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.append(np.flatnonzero(new), t.num_rows)
