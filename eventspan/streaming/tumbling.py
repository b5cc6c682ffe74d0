"""Windows and sessions over a stream of event files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import shared_folder

FAR = 4_102_444_800_000_000  # the year 2100, in microseconds: after every event, so it closes all windows


def event_stream(spark: SparkSession, folder: str, files: str) -> DataFrame:
    """clip, category, at, cents of every such file of the folder, in the order the files come."""
    schema = spark.read.option("pathGlobFilter", files).parquet(folder).schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", "64").option("pathGlobFilter", files).parquet(folder)
    return rows.select(F.col("user_id").alias("clip"), F.col("event_type").alias("category"), F.col("ts").cast("timestamp").alias("at"), F.round(F.col("value") * 100).cast("long").alias("cents"))


def lateness(spark: SparkSession, folder: str, files: str) -> str:
    """A watermark's delay that no row of these files is later than: the time between the first and the last event. Files of a
    replay come in any order, so a row may be as late as that."""
    ts = spark.read.option("pathGlobFilter", files).parquet(folder).select(F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"))
    r = ts.agg(F.min("t").alias("a"), F.max("t").alias("b")).first()
    return f"{(r.b - r.a if r.a is not None else 0) + 1} seconds"


RETENTION = "spark.sql.streaming.numRecentProgressUpdates"


def run(spark: SparkSession, rows: DataFrame, mode: str, at: str) -> None:
    """Runs until all files that are there are read, or goes on from where the folder `at` says. Each batch is written to a folder of
    its own, so a batch that is run again after a loss replaces itself. A job that goes on takes the same writer with a
    processing-time trigger. Rows that come after the watermark has passed their window would be missing: they stop the job."""

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/rows/batch={n}")

    was = spark.conf.get(RETENTION)
    spark.conf.set(RETENTION, str(1 << 20))  # the count of late rows of every batch
    try:
        query = rows.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        late = sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"])
    finally:
        spark.conf.set(RETENTION, was)
    if late:
        raise ValueError(f"{late} rows came later than the watermark allows; take a longer delay")


def written(spark: SparkSession, rows: DataFrame, at: str) -> DataFrame:
    return spark.read.schema(StructType([*rows.schema.fields, StructField("batch", LongType())])).parquet(f"{at}/rows")


def hourly_totals(spark: SparkSession, folder: str, files: str = "events*.parquet", late: str | None = None) -> DataFrame:
    """category, hour, n, cents. State is dropped once the watermark has passed an hour; a row for it that comes later stops the
    job. late: how late rows may come; by default as late as a replay of these files can make them."""
    rows = event_stream(spark, folder, files).withWatermark("at", late or lateness(spark, folder, files))
    totals = rows.groupBy("category", F.window("at", "1 hour")).agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))
    hour = F.floor(F.unix_micros(F.col("window.start")) / F.lit(3_600_000_000)).alias("hour")
    totals, at = totals.select("category", hour, "n", "cents"), f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    run(spark, totals, "update", at)
    newest = written(spark, totals, at).groupBy("category", "hour").agg(F.max_by(F.struct("n", "cents"), "batch").alias("x"))
    return newest.select("category", "hour", "x.n", "x.cents")


def sessions(spark: SparkSession, folder: str, files: str = "events*.parquet", gap: str = "3 hours", late: str | None = None) -> DataFrame:
    """clip, start_us, end_us, n, cents of runs of events less than `gap` apart, each written once, when the watermark has passed
    its end: the state holds open sessions only. When the files of a replay are read, one more event, far after all others,
    closes what is open."""
    at = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    end = spark.range(1).select(F.lit(None).cast("long").alias("clip"), F.timestamp_micros(F.lit(FAR)).alias("at"), F.lit(0).cast("long").alias("cents"))
    end.limit(0).write.parquet(f"{at}/end")
    both = event_stream(spark, folder, files).select("clip", "at", "cents").unionByName(spark.readStream.schema(end.schema).parquet(f"{at}/end"))
    s = both.withWatermark("at", late or lateness(spark, folder, files)).groupBy("clip", F.session_window("at", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))
    us = lambda c: F.unix_micros(F.col(c))
    s = s.select("clip", us("w.start").alias("start_us"), us("w.end").alias("end_us"), "n", "cents")
    run(spark, s, "append", at)
    end.coalesce(1).write.mode("append").parquet(f"{at}/end")
    run(spark, s, "append", at)
    return written(spark, s, at).where(F.col("start_us") < FAR).drop("batch")
