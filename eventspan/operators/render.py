"""Rendering on frames: levels, ducking, segments placed on a timeline."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def duck(frames: DataFrame, spans: DataFrame, keys: list[str], idx: str, start: str, end: str, low: float, ramp: int, out: str = "gain") -> DataFrame:
    """Gain per frame: `low` under a span [start, end), cosine ramps of `ramp` frames on both sides, the least where spans meet,
    1 elsewhere. A span reaches only its own frames."""
    at = spans.where(F.col(end) > F.col(start)).select(*keys, start, end, F.explode(F.sequence(F.col(start) - ramp, F.col(end) + ramp - 1)).alias(idx))
    i, last = F.col(idx), max(1, ramp - 1)
    k = F.when(i < F.col(start), i - F.col(start) + ramp).when(i >= F.col(end), F.col(end) + ramp - 1 - i)
    rise = (F.lit(1.0) - F.cos(F.lit(math.pi) * k / F.lit(float(last)))) / 2
    gain = F.when(k.isNull(), F.lit(low)).otherwise(F.lit(1.0) - F.lit(1.0 - low) * rise)
    least = at.select(*keys, idx, gain.alias("__g")).groupBy(*keys, idx).agg(F.min("__g").alias("__g"))
    return frames.join(least, [*keys, idx], "left").withColumn(out, F.coalesce("__g", F.lit(1.0))).drop("__g")


def energy_scale(df: DataFrame, keys: list[str], value: str, target: float, ceiling: float = 0.95) -> Column:
    """Factor that brings a series to 0.707 * target in root mean square, less where its peak would pass the ceiling; 1 for
    silence."""
    w = Window.partitionBy(*keys)
    rms, top = F.sqrt(F.avg(F.col(value) * F.col(value)).over(w)), F.max(F.abs(value)).over(w)
    return F.when(top > 0, F.least(F.try_divide(F.lit(0.707 * target), rms), F.try_divide(F.lit(ceiling), top))).otherwise(1.0)


def keep_until_next(placed: DataFrame, keys: list[str], start: str, length: str, id_: str) -> DataFrame:
    """length cut to the next start, so a segment that still rings does not hide the next one; equal starts both stay."""
    gap = F.lead(start).over(Window.partitionBy(*keys).orderBy(start, id_)) - F.col(start)
    return placed.withColumn("keep", F.when((gap > 0) & (gap < F.col(length)), gap).otherwise(F.col(length))).withColumn("cut", F.col("keep") < F.col(length))


def mix(frames: DataFrame, placed: DataFrame, keys: list[str], idx: str, bed: str, start: str, length: str, sample: Column, limit: float = 1.0) -> DataFrame:
    """keys, idx, value: the bed plus all placed segments, within +-limit. `sample` is a segment's value as a function of its
    columns and of `k`, its frame; frames outside the series go. Values are cut to whole millionths, so sums don't hang on order."""
    parts = placed.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col(length).cast("long") - 1))).withColumn(idx, F.col(start) + F.col("k"))
    sums = parts.select(*keys, idx, F.round(sample * 1e6).cast("long").alias("__u")).groupBy(*keys, idx).agg(F.sum("__u").alias("__u"))
    total = F.col(bed) + F.coalesce("__u", F.lit(0)) / F.lit(1e6)
    return frames.join(sums, [*keys, idx], "left").select(*keys, idx, F.greatest(F.lit(-limit), F.least(F.lit(limit), total)).alias("value"))


def cut_clips(events: DataFrame, frames: DataFrame, keys: list[str], id_: str, start: str, end: str, idx: str, value: str) -> DataFrame:
    """id, first_idx, n, samples of the frames from start to before end; what lies outside the series is left out. An event is dealt
    to the frames it asks for, so the join is by equality."""
    at = F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.col(start)), F.col(end) - 1)).alias(idx)
    near = events.where(F.col(end) > F.greatest(F.lit(0).cast("long"), F.col(start))).select(*keys, id_, at).join(frames.select(*keys, idx, value), [*keys, idx])
    g = near.groupBy(id_).agg(F.array_sort(F.collect_list(F.struct(F.col(idx).alias("i"), F.col(value).alias("v")))).alias("l"))
    return g.select(id_, F.element_at("l", 1)["i"].alias("first_idx"), F.size("l").cast("long").alias("n"), F.transform("l", lambda x: x["v"]).alias("samples"))
