"""Structured Streaming forms of the monitoring and scoring paths.

* ``daily_alert_stream``: I6 as a stream. Events arrive as parquet files; each
  is scored with the same column expression as the batch view, and a tumbling
  one-day window counts alerts. The query runs in ``update`` mode: a micro-batch
  writes the days it changed to a folder of its own, the last state of a day
  counts, and days that the watermark has passed leave the state.
* ``closed_day_stream``: the same in ``append`` mode, with events that come
  twice dropped within the watermark: a day is written once, when the watermark
  has closed it.
* ``score_stream``: G13 over a stream: any ``DataFrame -> DataFrame`` scoring
  function (batch code) applied to a streaming source, appended to a parquet
  sink.

State, progress and results live under the shared checkpoint folder, by the
run's name: a run of the same name goes on where the last one ended, and its
result is the whole table, whether new files came or not. Tests and the
registered queries drive the streams with ``trigger(availableNow=True)``
(process what is there, then stop); in production the same code runs with a
processing-time trigger.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path
from ..sources.files import exists

DAY_SCHEMA = "day timestamp_ntz, alerts long, rows long, over_capacity boolean"
#: How late an event may come; later ones don't change a closed day.
DELAY = "1 day"


def event_score(value: Column) -> Column:
    """Same deterministic score as view P."""
    amount = value.cast("decimal(18,2)").cast("double")
    return F.floor(F.least(amount, F.lit(499.99)) / 5) / 100


def _events(spark: SparkSession, events_dir: str, pattern: str, schema, files: int) -> DataFrame:
    schema = schema or spark.read.option("pathGlobFilter", pattern).parquet(events_dir).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).parquet(events_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", DELAY)


def _days(events: DataFrame, threshold: float, capacity: int) -> DataFrame:
    alert = event_score(F.col("value")) >= threshold
    return (events.groupBy(F.window("ts", "1 day").alias("w"))
            .agg(F.count_if(alert).alias("alerts"), F.count(F.lit(1)).alias("rows"))
            .select(F.col("w.start").cast("timestamp_ntz").alias("day"), "alerts", "rows", (F.col("alerts") > capacity).alias("over_capacity")))


def _finish(writer, state: str) -> None:
    query = writer.option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()


def daily_alert_stream(spark: SparkSession, events_dir: str, threshold: float, capacity: int,
                       run_name: str, pattern: str = "*.parquet", schema=None, files: int = 64) -> DataFrame:
    """Count alerts a day over the parquet files in ``events_dir`` matching
    ``pattern`` until no input is left; return the table of all days so far.
    Every row counts, also one that comes twice."""
    days = _days(_events(spark, events_dir, pattern, schema, files), threshold, capacity)
    out = shared_path(spark, "streams", run_name, "result")

    def changed(batch: DataFrame, epoch: int) -> None:
        # a batch that is done again writes the same folder
        batch.write.mode("overwrite").parquet(f"{out}/batch={epoch:012d}")

    _finish(days.writeStream.outputMode("update").foreachBatch(changed), shared_path(spark, "streams", run_name, "state"))
    if not exists(spark, out):
        return spark.createDataFrame([], DAY_SCHEMA)
    rows = spark.read.schema(f"{DAY_SCHEMA}, batch long").parquet(out)
    last = rows.groupBy("day").agg(F.max_by(F.struct("alerts", "rows", "over_capacity"), "batch").alias("_l"))
    return last.select("day", "_l.*")


def closed_day_stream(spark: SparkSession, events_dir: str, threshold: float, capacity: int, run_name: str,
                      key: str = "event_id", pattern: str = "*.parquet", schema=None, files: int = 64) -> DataFrame:
    """The days that the watermark has closed, each event counted once; days
    still open are in the state and come with a later run."""
    once = _events(spark, events_dir, pattern, schema, files).dropDuplicatesWithinWatermark([key])
    out = shared_path(spark, "streams", run_name, "days")
    writer = _days(once, threshold, capacity).writeStream.outputMode("append").format("parquet").option("path", out)
    _finish(writer, shared_path(spark, "streams", run_name, "state"))
    return spark.read.schema(DAY_SCHEMA).parquet(out) if exists(spark, out) else spark.createDataFrame([], DAY_SCHEMA)


def score_stream(spark: SparkSession, source_dir: str, schema, scorer: Callable[[DataFrame], DataFrame],
                 run_name: str, files: int = 64) -> DataFrame:
    """Apply a batch scoring function to a parquet stream; returns all rows
    scored so far (append-only parquet, exactly once through the checkpoint)."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source_dir)
    out = shared_path(spark, "streams", run_name, "scores")
    scored = scorer(stream)
    _finish(scored.writeStream.format("parquet").outputMode("append").option("path", out), shared_path(spark, "streams", run_name, "state"))
    return spark.read.schema(scored.schema).parquet(out) if exists(spark, out) else spark.createDataFrame([], scored.schema)
