"""Sharp peaks become events when something backs them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import folds, joins


def backed(level: Column, sharpness: Column, ref: Column, scored: Column, volley: Column, seeded: Column) -> Column:
    """Which rule accepts a peak, null for none. A hit as loud and sharp as a shot needs a score, a volley or more sharpness;
    in a volley or with a score less will do; by flux alone it must resemble the known shots near one of them."""
    impact = (sharpness >= 3.0) & (level >= F.lit(0.6) * ref)
    return (
        F.when(impact & (scored | volley), "impact").when(impact & (sharpness >= 5.0), "isolated")
        .when(volley & (level >= F.lit(0.35) * ref), F.when(sharpness >= 2.0, "volley"))
        .when(scored, F.when((level >= F.lit(0.4) * ref) & (sharpness >= 1.5), "scored"))
        .when(seeded & (level >= F.lit(0.5) * ref) & (sharpness >= 2.5), "flux")
    )


def near_flag(peaks: DataFrame, marks: DataFrame, keys: list[str], at: str, id_: list[str], reach: int, out: str, but_self: bool = False) -> DataFrame:
    """Adds whether a mark (column m_at) lies within reach; but_self: a mark on the peak itself does not count."""
    hit = joins.band_join(peaks.select(*id_), marks.select(*keys, "m_at"), keys, at, "m_at", reach)
    hit = (hit.where(F.col("m_at") != F.col(at)) if but_self else hit).select(*id_).distinct().withColumn(out, F.lit(True))
    return peaks.join(hit, id_, "left").withColumn(out, F.coalesce(out, F.lit(False)))


def promote(peaks: DataFrame, events: DataFrame, keys: list[str], at: str, apart: int) -> DataFrame:
    """Accepted peaks (column `rule`) more than `apart` from every event (m_at) and, in time order, from the last accepted one."""
    free = joins.band_join(peaks.where("rule IS NOT NULL"), events.select(*keys, "m_at"), keys, at, "m_at", apart, "left_anti")
    return folds.greedy_spacing(free.withColumn("__o", -F.col(at)), keys, at, "__o", apart + 1).drop("__o")
