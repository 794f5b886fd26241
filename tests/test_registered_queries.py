"""Every SQL-checkable registered query against its DuckDB oracle on the
smallest data set (the driver does the same at sf0.01); plus the entry."""

import math
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from ledgerlens.sources.tables import TABLES

SF_SMALL = "/root/testdata/sf0.001"

# the stream has a test of its own
NAMES = [n for n in entry.oracle_sql() if n != "alerts_per_day_stream"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def _norm(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = []
    for r in rows:
        vals = []
        for i in order:
            v = r[i]
            if isinstance(v, float) and not math.isinf(v):
                v = round(v, 6)
            if isinstance(v, list):
                v = tuple(v)
            vals.append(v)
        out.append(tuple(vals))
    return Counter(out)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "median_amount" in df.columns


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF_SMALL)
    cur = con.execute(entry.oracle_sql()[name])
    d_names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(d_names)
    assert _norm(df.columns, [tuple(r) for r in df.collect()]) == _norm(d_names, cur.fetchall())
