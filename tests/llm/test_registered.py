"""The registered queries: names, SQL, and a run of the ones with SQL."""

import duckdb

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_names():
    names = entry.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13 and "pipeline" in names


def test_url_filter_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    cur = con.execute(entry.oracle_sql()["op9_url_filter"])
    names = [d[0] for d in cur.description]
    got = entry.queries()["op9_url_filter"](spark, SF).select(*names).collect()
    assert sorted(map(str, cur.fetchall())) == sorted(str(tuple(r)) for r in got)
