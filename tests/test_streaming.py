"""The streams (availableNow) equal their batch forms and can be restarted."""

import datetime as dt
import os
import uuid

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ledgerlens.streaming import alerts as A

SF_SMALL = "/root/testdata/sf0.001"


def test_stream_matches_batch(spark):
    got = sorted(tuple(r) for r in entry.queries()["alerts_per_day_stream"](spark, SF_SMALL).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SF_SMALL}/events.parquet')")
    cur = con.execute(entry.oracle_sql()["alerts_per_day_stream"])
    names = [d[0] for d in cur.description]
    want = sorted(tuple(r) for r in cur.fetchall())
    assert names == ["day", "alerts", "rows", "over_capacity"]
    assert got == want and len(got) > 0


DAY = dt.datetime(2024, 1, 1)


def put(spark, folder, name, rows):
    """One parquet file of (event_id, hours since DAY, value)."""
    df = spark.createDataFrame([(i, DAY + dt.timedelta(hours=h), v) for i, h, v in rows], "event_id long, ts timestamp_ntz, value double")
    df.coalesce(1).write.parquet(f"{folder}-{name}")
    part = next(f for f in os.listdir(f"{folder}-{name}") if f.endswith(".parquet"))
    os.makedirs(folder, exist_ok=True)
    os.link(f"{folder}-{name}/{part}", f"{folder}/{name}.parquet")
    return df.schema


def days(df):
    return sorted((r.day.day, r.alerts, r.rows) for r in df.collect())


def test_restart_gives_the_whole_table(spark, tmp_path):
    folder, run = f"{tmp_path}/events", uuid.uuid4().hex
    schema = put(spark, folder, "a", [(1, 1, 400.0), (2, 2, 1.0), (3, 26, 450.0)])
    go = lambda: days(A.daily_alert_stream(spark, folder, 0.67, 5, run, schema=schema))
    first = go()
    assert first == [(1, 1, 2), (2, 1, 1)] and go() == first and go() == first
    put(spark, folder, "b", [(4, 27, 499.0), (5, 60, 2.0)])
    assert go() == [(1, 1, 2), (2, 2, 2), (3, 0, 1)]


def test_watermark_drops_state_and_late_rows(spark, tmp_path):
    folder, run = f"{tmp_path}/events", uuid.uuid4().hex
    schema = put(spark, folder, "a", [(1, 1, 400.0), (2, 24 * 9, 1.0)])
    go = lambda: days(A.daily_alert_stream(spark, folder, 0.67, 5, run, schema=schema))
    assert go() == [(1, 1, 1), (10, 0, 1)]
    put(spark, folder, "b", [(3, 2, 400.0), (4, 24 * 9 - 1, 400.0)])  # the first is days late, the second an hour
    assert go() == [(1, 1, 1), (9, 1, 1), (10, 0, 1)]


def test_closed_days_count_an_event_once(spark, tmp_path):
    folder, run = f"{tmp_path}/events", uuid.uuid4().hex
    schema = put(spark, folder, "a", [(1, 1, 400.0), (1, 1, 400.0), (2, 2, 1.0), (3, 26, 450.0)])
    go = lambda: days(A.closed_day_stream(spark, folder, 0.67, 5, run, schema=schema))
    assert go() == []  # no day is a day behind the last event
    put(spark, folder, "b", [(2, 2, 1.0), (1, 1, 400.0), (4, 24 * 4, 1.0)])
    assert go() == [(1, 1, 2), (2, 1, 1)] and go() == [(1, 1, 2), (2, 1, 1)]
    put(spark, folder, "c", [(5, 24 * 8, 1.0)])
    assert go() == [(1, 1, 2), (2, 1, 1), (5, 0, 1)]


def test_score_stream_equals_batch_and_restarts(spark, tmp_path):
    folder, run = f"{tmp_path}/rows", uuid.uuid4().hex
    schema = put(spark, folder, "a", [(i, i, float(i)) for i in range(20)])
    scorer = lambda df: df.select("event_id", A.event_score(F.col("value")).alias("proba"))
    go = lambda: sorted(map(tuple, A.score_stream(spark, folder, schema, scorer, run).collect()))
    batch = lambda: sorted(map(tuple, scorer(spark.read.schema(schema).parquet(folder)).collect()))
    assert go() == batch() and go() == batch()
    put(spark, folder, "b", [(i, i, 99.0) for i in range(20, 30)])
    assert go() == batch() and len(go()) == 30


def test_a_fitted_model_scores_a_stream(spark, tmp_path):
    """The batch scoring of a stored MLlib model, over files as they arrive."""
    from ledgerlens.operators import modeling as G
    i = F.col("id")
    df = spark.range(300).select(i.alias("event_id"), (i % 7 / 7).alias("x"), F.when(i % 2 == 0, "a").otherwise("b").alias("c"), (i % 7 > 4).cast("int").alias("isFraud"),
                                 F.when(i % 10 < 6, "train").when(i % 10 < 8, "val").otherwise("test").alias("split"))
    fitted, _ = G.train_and_evaluate(df, G.ModelConfig("logistic_regression", G.logistic_regression()))
    fitted.save(f"file://{tmp_path}/m")
    model, folder, run = G.FittedModel.load(f"file://{tmp_path}/m"), f"{tmp_path}/rows", uuid.uuid4().hex
    df.drop("isFraud", "split").repartition(3).write.parquet(folder)
    scorer = lambda rows: model.score(rows, ["event_id"])
    rows = spark.read.parquet(folder)
    got = A.score_stream(spark, folder, rows.schema, scorer, run, files=1)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, scorer(rows).collect())) and got.count() == 300
