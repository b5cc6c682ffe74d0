"""Loud stretches of a series against a floor, scenes of steady level, and the gate that lets sustained events through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import folds, islands


def bridged_runs(df: DataFrame, keys: list[str], idx: str, on: Column, bridge: int) -> DataFrame:
    """Rows where `on` holds, with `seg`: equal for rows that at most `bridge` other frames part."""
    w = Window.partitionBy(*keys).orderBy(idx)
    new = F.when(F.col(idx) - F.lag(idx).over(w) <= bridge + 1, 0).otherwise(1)
    return df.where(on).withColumn("__new", new).withColumn("seg", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def segments_above(df: DataFrame, keys: list[str], idx: str, value: str, level: float, bridge: int, least: int) -> DataFrame:
    """first_idx, last_idx, peak_idx (the first largest), peak of stretches at `level` or more that last `least` frames."""
    runs = bridged_runs(df, keys, idx, F.col(value) >= level, bridge)
    top = F.max(F.struct(F.col(value).alias("v"), (-F.col(idx)).alias("i"))).alias("top")
    out = runs.groupBy(*keys, "seg").agg(F.min(idx).alias("first_idx"), F.max(idx).alias("last_idx"), top)
    return out.where(F.col("last_idx") - F.col("first_idx") + 1 >= least).select(*keys, "first_idx", "last_idx", (-F.col("top.i")).alias("peak_idx"), F.col("top.v").alias("peak"))


def loud_islands(df: DataFrame, keys: list[str], idx: str, value: str, smooth: str, floor: str, least: int, bridge: int, duty: float = 0.55, edge: float = 0.75, reach: int = 4) -> DataFrame:
    """Stretches where `smooth` holds the floor (not negative), as lo_idx, peak_idx, hi_idx.

    Edges go outward, at most `reach` frames, over the unbroken run at `edge` of the floor that the edge frame is in; stretches
    that then meet are one. A lone stretch has its peak before the walk, a merged one anywhere.
    """
    run = Window.partitionBy(*keys, "run")
    near = islands.flag_runs(df, keys, idx, F.col(smooth) >= F.lit(edge) * F.col(floor))
    near = near.withColumn("__e0", F.min(idx).over(run)).withColumn("__e1", F.max(idx).over(run))
    cores = bridged_runs(near, keys, idx, F.col(smooth) >= F.col(floor), bridge).groupBy(*keys, "seg").agg(
        F.min(idx).alias("a"), F.max(idx).alias("b"), F.count(F.lit(1)).alias("on"), F.min("__e0").alias("e0"), F.max("__e1").alias("e1")
    )
    size = F.col("b") - F.col("a") + 1
    cores = cores.where((size >= least) & (F.col("on") / size >= duty))
    wide = cores.select(*keys, "a", "b", F.greatest(F.col("a") - reach, "e0").alias("lo_idx"), F.least(F.col("b") + reach, "e1").alias("hi_idx"))
    merged = islands.merge_gaps(wide, keys, "lo_idx", "hi_idx", 0, [F.min("a").alias("a"), F.max("b").alias("b")])
    alone = F.col("n") == 1
    at = F.explode(F.sequence(F.when(alone, F.col("a")).otherwise(F.col("lo_idx")), F.when(alone, F.col("b")).otherwise(F.col("hi_idx")))).alias(idx)
    top = F.max(F.struct(F.col(value).alias("v"), (-F.col(idx)).alias("i"))).alias("top")
    peaks = merged.select(*keys, "lo_idx", "hi_idx", at).join(df.select(*keys, idx, value), [*keys, idx]).groupBy(*keys, "lo_idx", "hi_idx").agg(top)
    return peaks.select(*keys, "lo_idx", (-F.col("top.i")).alias("peak_idx"), "hi_idx")


def crop_to_loud(marks: DataFrame, frames: DataFrame, keys: list[str], id_: str, at: str, idx: str, value: str, level: Column, half: int) -> DataFrame:
    """id, lo_idx, peak_idx, hi_idx: the stretch around each mark's frame whose other frames reach `level`, `half` frames to
    each side at most. A mark sees 2 * half + 1 frames, whatever the series' length."""
    steps = marks.withColumn("__o", F.explode(F.sequence(F.lit(-half), F.lit(half)))).withColumn(idx, F.col(at) + F.col("__o"))
    near = steps.join(frames.select(*keys, idx, value), [*keys, idx])
    low, o = F.col(value) < level, F.col("__o")
    g = near.groupBy(*keys, id_, at).agg(
        F.coalesce(F.max(F.when(low & (o < 0), o)) + 1, F.min("__o")).alias("l"), F.coalesce(F.min(F.when(low & (o > 0), o)) - 1, F.max("__o")).alias("h"),
        F.collect_list(F.struct(o.alias("o"), F.col(value).alias("v"))).alias("near"),
    )
    inside = F.filter("near", lambda x: x["o"].between(F.col("l"), F.col("h")))
    top = F.array_max(F.transform(inside, lambda x: F.struct(x["v"].alias("v"), (-x["o"]).alias("o"))))
    return g.select(*keys, id_, (F.col(at) + F.col("l")).alias("lo_idx"), (F.col(at) - top["o"]).alias("peak_idx"), (F.col(at) + F.col("h")).alias("hi_idx"))


def scenes(df: DataFrame, keys: list[str], idx: str, value: str, block: int, context: int, least: int, step: float, steady: float) -> DataFrame:
    """keys, start_idx, end_idx: each series cut where its level steps by the ratio `step`.

    A block's level is its 0.9 quantile. `context` blocks on each side of a cut must hold their own level (largest over smallest
    at most `steady`). The largest steps are cut first; no scene is shorter than `least` frames.
    """
    ends = df.groupBy(*keys).agg(F.min(idx).alias("__first"), F.max(idx).alias("__last"))
    b = df.join(ends, keys).withColumn("__b", F.floor((F.col(idx) - F.col("__first")) / block))
    levels = b.groupBy(*keys, "__first", "__last", "__b").agg(F.percentile(value, 0.9).alias("lv")).withColumn("t", F.col("__first") + F.col("__b") * block).where("t < __last")
    w = Window.partitionBy(*keys).orderBy("__b")
    left, right = w.rowsBetween(-context, -1), w.rowsBetween(0, context - 1)
    tiny = F.lit(1e-9)
    for side, frame in (("l", left), ("r", right)):
        levels = levels.withColumn(f"{side}n", F.count("lv").over(frame)).withColumn(f"{side}m", F.percentile("lv", 0.5).over(frame))
        levels = levels.withColumn(f"{side}ok", F.max("lv").over(frame) <= F.lit(steady) * F.greatest(F.min("lv").over(frame), tiny))
    cuts = levels.where((F.col("ln") == context) & (F.col("rn") == context) & F.col("lok") & F.col("rok"))
    cuts = cuts.withColumn("ratio", F.greatest("lm", "rm") / F.greatest(F.least("lm", "rm"), tiny))
    cuts = cuts.where((F.col("ratio") >= step) & (F.col("t") - F.col("__first") >= least) & (F.col("__last") - F.col("t") >= least))
    kept = folds.greedy_spacing(cuts.select(*keys, "t", "ratio"), keys, "t", "ratio", least, later=True)
    bounds = ends.select(*keys, F.col("__first").alias("start_idx")).unionByName(kept.select(*keys, F.col("t").alias("start_idx")))
    nxt = F.lead("start_idx").over(Window.partitionBy(*keys).orderBy("start_idx"))
    return bounds.withColumn("__n", nxt).join(ends, keys).select(*keys, "start_idx", F.coalesce("__n", F.col("__last") + 1).alias("end_idx"))
