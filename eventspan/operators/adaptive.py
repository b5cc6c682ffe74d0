"""Loudness floors that follow the shape and the rhythm of a series."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class FloorSettings:
    """Lengths are in frames."""

    silence: float = 0.05
    least_active: int = 8
    mix: float = 0.4
    separation: float = 1.45
    level_ratio: float = 1.5
    least_gaps: int = 2
    gap: int = 2
    longest_gap: int = 24
    burst: int = 2


def adaptive_floor(df: DataFrame, keys: list[str], idx: str, value: str, s: FloorSettings = FloorSettings()) -> DataFrame:
    """One row per key: threshold, mode, rhythmic.

    Silent frames are left out of the quantiles unless hardly any would stay. Two loudness modes, or bursts and gaps that take
    turns, are split between the quiet and the loud level; else the floor lies under the quiet part. Rhythm is looked for
    between the first and the last loud frame.
    """
    w = Window.partitionBy(*keys)
    v = F.col(value)
    top = df.withColumn("__top", F.percentile(value, 0.99).over(w)).withColumn("__on", v >= F.lit(s.silence) * F.col("__top"))
    n = F.count(F.when(F.col("__on"), 1)).over(w)
    act = top.withColumn("__a", F.when(F.col("__on") | (n < s.least_active), v))
    q = act.select(*keys, idx, value, *[F.percentile("__a", p).over(w).alias(c) for c, p in (("quiet", 0.1), ("mid", 0.5), ("loud", 0.9))])
    split = F.col("quiet") + F.lit(s.mix) * (F.col("loud") - F.col("quiet"))
    q = q.withColumn("split", split).withColumn("is_loud", v >= F.col("split"))
    first, last = F.min(F.when(F.col("is_loud"), F.col(idx))).over(w), F.max(F.when(F.col("is_loud"), F.col(idx))).over(w)
    inside = q.withColumn("lo", first).withColumn("hi", last)
    order = Window.partitionBy(*keys, "is_loud").orderBy(idx)
    runs = inside.where(F.col(idx).between(F.col("lo"), F.col("hi"))).withColumn("run", F.col(idx) - F.row_number().over(order))
    lengths = runs.groupBy(*keys, "is_loud", "run").agg(F.count(F.lit(1)).alias("len"))
    gap, burst = F.when(~F.col("is_loud") & (F.col("len") >= s.gap), F.col("len")), F.when(F.col("is_loud"), F.col("len"))
    beat = lengths.groupBy(*keys).agg(F.count(gap).alias("gaps"), F.percentile(gap, 0.5).alias("gap_mid"), F.percentile(burst, 0.5).alias("burst_mid"))
    level = q.groupBy(*keys).agg(*[F.first(c).alias(c) for c in ("quiet", "mid", "loud", "split")]).join(beat, keys, "left")
    two = F.col("loud") >= F.lit(s.level_ratio) * F.greatest("quiet", F.lit(1e-12))
    rhythm = F.coalesce(two & (F.col("gaps") >= s.least_gaps) & (F.col("gap_mid") <= s.longest_gap) & (F.col("burst_mid") >= s.burst), F.lit(False))
    apart = F.col("loud") / F.greatest("mid", F.lit(1e-12)) >= s.separation
    mode = F.when(apart | rhythm, "split").otherwise("keep")
    keep = F.greatest(F.lit(0.6) * F.col("quiet"), F.lit(0.3) * F.col("mid"))
    return level.select(*keys, mode.alias("mode"), rhythm.alias("rhythmic"), F.when(mode == "split", F.col("split")).otherwise(keep).alias("threshold"))
