"""Gaps and islands: runs of frames, and intervals that touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def flag_runs(df: DataFrame, keys: list[str], idx: str, flag: Column) -> DataFrame:
    """Rows where flag holds, with `run`: equal for neighbours in one unbroken run of frames."""
    w = Window.partitionBy(*keys).orderBy(idx)
    return df.where(flag).withColumn("run", F.col(idx) - F.row_number().over(w))


def hysteresis(df: DataFrame, keys: list[str], idx: str, value: str, high: float, low: float) -> DataFrame:
    """Segments (first, last frame) that stay at `low` or more and somewhere reach `high`: starting at a high frame and walking
    both ways while low holds gives the same segments. peak_idx is the first largest frame."""
    runs = flag_runs(df, keys, idx, F.col(value) >= low)
    top = F.max(F.struct(F.col(value).alias("v"), (-F.col(idx)).alias("i")))
    out = runs.groupBy(*keys, "run").agg(F.min(idx).alias("first_idx"), F.max(idx).alias("last_idx"), top.alias("top")).where(F.col("top.v") >= high)
    return out.select(*keys, "first_idx", "last_idx", (-F.col("top.i")).alias("peak_idx"), F.col("top.v").alias("peak"))


def merge_gaps(spans: DataFrame, keys: list[str], start: str, end: str, gap, aggregates: list[Column]) -> DataFrame:
    """Intervals whose start is within `gap` of the largest end so far become one: start, end, n and the aggregates."""
    order = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("__new", F.when(F.col(start) <= reach + gap, 0).otherwise(1))
    marked = marked.withColumn("__island", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "__island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n"), *aggregates).drop("__island")


def union_length(spans: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Covered length and number of separate islands of each key."""
    merged = merge_gaps(spans, keys, start, end, 0, [])
    return merged.groupBy(*keys).agg(F.sum(F.col(end) - F.col(start)).alias("covered"), F.count(F.lit(1)).alias("islands"), F.sum("n").alias("spans"))


def sustained_merge(spans: DataFrame, keys: list[str], start: str, end: str, peak: str, weight: str, gap) -> DataFrame:
    """merge_gaps where the strongest member, the later one of equals, gives the peak."""
    top = F.max(F.struct(F.col(weight).alias("w"), F.col(start).alias("s"), F.col(end).alias("e"), F.col(peak).alias("p")))
    return merge_gaps(spans, keys, start, end, gap, [top.alias("top")]).withColumn(peak, F.col("top.p")).withColumn(weight, F.col("top.w")).drop("top")
