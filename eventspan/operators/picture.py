"""Events seen in frame measures: flashes, how long their fire stays, and events moved onto them; shake strength."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import folds, frames


def flashes(df: DataFrame, keys: list[str], idx: str, warm: str, rise: float, least: float, broken: Column, settle: int, spacing: int) -> DataFrame:
    """keys, idx, rise: frames where `warm` jumps by `rise` to `least` or more, largest jumps first (the later of equals),
    spaced. A broken frame (a cut) is no flash, and neither is a jump up to `settle` frames after a cut whose first frame
    was warm already."""
    w = Window.partitionBy(*keys).orderBy(idx)
    cut = F.when(broken, F.struct(F.col(idx).alias("i"), F.lead(warm).over(w).alias("opens")))
    m = df.withColumn("__cut", cut).withColumn("rise", F.col(warm) - F.coalesce(F.lag(warm).over(w), F.col(warm))).withColumn("__b", broken)
    m = m.withColumn("__cut", F.last("__cut", True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    settling = F.coalesce((F.col("__cut.i") >= F.col(idx) - settle) & (F.col("__cut.opens") >= least), F.lit(False))
    found = m.where((F.col("rise") >= rise) & (F.col(warm) >= least) & ~F.col("__b") & ~settling)
    return folds.greedy_spacing(found.select(*keys, idx, "rise"), keys, idx, "rise", spacing, later=True)


def fire_spans(marks: DataFrame, df: DataFrame, keys: list[str], at: str, idx: str, warm: str, least: float, longest: int, dip: int) -> DataFrame:
    """keys, at, end_idx: from each mark while frames are warm; dips of up to `dip` frames are passed over, and no span is
    longer than `longest`. A mark reads longest + 1 frames."""
    ahead = marks.select(*keys, at, F.explode(F.sequence(F.col(at), F.col(at) + longest)).alias(idx))
    hot = ahead.join(df.where(F.col(warm) >= least).select(*keys, idx), [*keys, idx])
    w = Window.partitionBy(*keys, at).orderBy(idx)
    hot = hot.withColumn("__far", (F.col(idx) - F.coalesce(F.lag(idx).over(w), F.col(at)) > dip + 1).cast("int"))
    hot = hot.withColumn("__far", F.sum("__far").over(w.rowsBetween(Window.unboundedPreceding, 0))).where("__far = 0")
    ends = hot.groupBy(*keys, at).agg(F.max(idx).alias("__end"))
    return marks.select(*keys, at).join(ends, [*keys, at], "left").select(*keys, at, F.coalesce("__end", at).alias("end_idx"))


def fading(events: DataFrame, spans: DataFrame, keys: list[str], id_: str, t: str, strength: str, flash: str, start: str, end: str, reach: int, apart: int) -> DataFrame:
    """Ids of events that are only a fire dying down: inside a span, without a flash, at least `apart` after the strongest
    event with a flash near the span's start (the earlier of equals) and weaker than it."""
    near = spans.select(*keys, start, end, F.explode(F.sequence(F.col(start) - reach, F.col(start) + reach)).alias(t))
    lead = near.join(events.where(F.col(flash)).select(*keys, t, strength), [*keys, t])
    parent = lead.groupBy(*keys, start, end).agg(F.max(F.struct(F.col(strength).alias("s"), (-F.col(t)).alias("t"))).alias("p"))
    inside = parent.select(*keys, "p", F.explode(F.sequence(F.col(start), F.col(end))).alias(t))
    hit = inside.join(events.where(~F.col(flash)), [*keys, t]).where((F.col(t) + F.col("p.t") >= apart) & (F.col(strength) < F.col("p.s")))
    return hit.select(id_).distinct()


def shake(df: DataFrame, keys: list[str], idx: str, shifts: list[str], cut: str, width: int, rms: int, out: str = "strength") -> DataFrame:
    """Strength of what is left of the shifts without their moving average. At cuts the last shift outside a cut stands in (0 if
    there is none) and nothing is left over."""
    w = Window.partitionBy(*keys).orderBy(idx).rowsBetween(Window.unboundedPreceding, 0)
    rows = df
    for s in shifts:
        rows = rows.withColumn(s, F.coalesce(F.last(F.when(~F.col(cut), F.col(s)), True).over(w), F.lit(0.0)))
    for s in shifts:
        rows = frames.moving_average(rows, keys, idx, s, width, f"__m_{s}")
    square = sum(((F.col(s) - F.col(f"__m_{s}")) * (F.col(s) - F.col(f"__m_{s}")) for s in shifts), F.lit(0.0))
    rows = rows.withColumn("__sq", F.when(F.col(cut), 0.0).otherwise(square)).drop(*[f"__m_{s}" for s in shifts])
    return frames.moving_average(rows, keys, idx, "__sq", rms, out).withColumn(out, F.sqrt(out)).drop("__sq")
