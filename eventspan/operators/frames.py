"""Operators on regular series: one row per clip and frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dense_grid(points: DataFrame, clip: str, slot: str, cents: str) -> DataFrame:
    """clip, frame_idx, value: the mean of the points in each slot, 0 where there is none. Slots are counted from the first one
    of all clips. Amounts come in cents, so sums are exact; points are combined before the shuffle."""
    cells = points.groupBy(F.col(clip).alias("clip"), F.col(slot).alias("slot")).agg(F.sum(cents).alias("s"), F.count(F.lit(1)).alias("n"))
    span = cells.agg(F.min("slot").alias("lo"), F.max("slot").alias("hi"))
    frames = cells.select("clip").distinct().crossJoin(F.broadcast(span)).select("clip", "lo", F.explode(F.sequence("lo", "hi")).alias("slot"))
    value = F.when(F.col("n").isNull(), F.lit(0.0)).otherwise(F.col("s").cast("double") / (F.col("n") * F.lit(100.0)))
    return frames.join(cells, ["clip", "slot"], "left").select("clip", (F.col("slot") - F.col("lo")).alias("frame_idx"), value.alias("value"))


def edge_replicated(df: DataFrame, keys: list[str], idx: str, radius: int) -> DataFrame:
    """The first and last row of each series repeated `radius` times beyond its ends; __pad marks them."""
    w = Window.partitionBy(*keys)
    i, lo, hi = F.col(idx), F.col("__lo"), F.col("__hi")
    before = F.when(i == lo, F.sequence(i - radius, i - 1)).otherwise(F.array().cast("array<bigint>"))
    after = F.when(i == hi, F.sequence(i + 1, i + radius)).otherwise(F.array().cast("array<bigint>"))
    rows = df.withColumn("__lo", F.min(idx).over(w)).withColumn("__hi", F.max(idx).over(w))
    rows = rows.withColumn("__at", F.explode(F.concat(before, F.array(i.cast("bigint")), after)))
    return rows.withColumn("__pad", F.col("__at") != i).drop("__lo", "__hi")


def centred(keys: list[str], idx: str, radius: int):
    return Window.partitionBy(*keys).orderBy(idx).rowsBetween(-radius, radius)


def rolling_edge(df: DataFrame, keys: list[str], idx: str, radius: int, out: str, what: Column) -> DataFrame:
    rows = edge_replicated(df, keys, idx, radius)
    return rows.withColumn(out, what.over(centred(keys, "__at", radius))).where(~F.col("__pad")).drop("__at", "__pad")


def median_smooth(df: DataFrame, keys: list[str], idx: str, value: str, width: int, out: str = "smooth") -> DataFrame:
    """Median of an odd window, series ends repeated."""
    return rolling_edge(df, keys, idx, (width | 1) // 2, out, F.percentile(value, 0.5))


def moving_average(df: DataFrame, keys: list[str], idx: str, value: str, width: int, out: str = "mean") -> DataFrame:
    return rolling_edge(df, keys, idx, (width | 1) // 2, out, F.avg(value))


def peak_hold(df: DataFrame, keys: list[str], idx: str, value: str, radius: int, out: str = "held") -> DataFrame:
    """Running maximum around each frame; the window shrinks at the ends."""
    return df.withColumn(out, F.max(value).over(centred(keys, idx, radius)))


def rms_envelope(df: DataFrame, keys: list[str], idx: str, value: str, hop: int, floor: float = 1e-12, padded: bool = False) -> DataFrame:
    """Root mean square of every hop frames. padded: the last hop counts as filled with zeros."""
    squares = F.sum(F.col(value) * F.col(value))
    n = F.lit(float(hop)) if padded else F.count(F.lit(1))
    return df.groupBy(*keys, F.floor(F.col(idx) / hop).alias("hop")).agg(F.sqrt(squares / n + F.lit(floor)).alias("rms"))


def nearest_rank(values: Column, share: float) -> Column:
    """The element at the rounded place of the sorted values."""
    ordered = F.array_sort(values)
    return F.element_at(ordered, F.bround((F.size(ordered) - 1) * F.lit(share)).cast("int") + 1)


def vector_flux(df: DataFrame, keys: list[str], idx: str, vector: str, out: str = "flux") -> DataFrame:
    """Sum of rises from the vector before; 0 for the first."""
    last = F.lag(vector).over(Window.partitionBy(*keys).orderBy(idx))
    rises = F.zip_with(F.col(vector), last, lambda a, b: F.greatest(a - b, F.lit(0.0)))
    return df.withColumn(out, F.coalesce(F.aggregate(rises, F.lit(0.0), lambda s, x: s + x), F.lit(0.0)))


def zero_crossings(df: DataFrame, keys: list[str], idx: str, value: Column, hop: int) -> DataFrame:
    """Share of neighbours with different sign in each hop."""
    last = F.lag(value).over(Window.partitionBy(*keys).orderBy(idx))
    crossed = F.when(last.isNull(), 0).otherwise(((value < 0) != (last < 0)).cast("int"))
    return df.withColumn("__c", crossed).groupBy(*keys, F.floor(F.col(idx) / hop).alias("hop")).agg(F.sum("__c").alias("crossings"))
