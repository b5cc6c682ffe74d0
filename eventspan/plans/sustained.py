"""Queries on the whole gate for lasting events: frames away from blasts, the shape of a clip, stretches and what they are due to."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import adaptive, loud
from ..session import settled
from . import derived as d
from .derived import ADAPTIVE_SQL, HOUR, S_SQL
from .gating import SMOOTH_SQL, event_frames, event_frames_sql, islands_sql, smooth
from .registry import K, query

# Blasts are the events above one amount, lasting events those between it and a smaller one; times are frames.
BLAST, LASTING, AWAY = 25_000, 8_000, 2
ROLE_SQL = f"{event_frames_sql(LASTING)}, bl AS (SELECT DISTINCT clip, at_idx FROM ef WHERE cents > {BLAST}), ve AS (SELECT *, at_idx + event_id % 6 AS to_idx FROM ef WHERE cents <= {BLAST})"
MASK_SQL = f"""
ba AS (SELECT m.*, EXISTS (SELECT 1 FROM bl WHERE bl.clip = m.clip AND abs(bl.at_idx - m.frame_idx) <= {AWAY}) AS near FROM m),
mk AS (SELECT * FROM (SELECT *, bool_and(near) OVER (PARTITION BY clip) AS none_left FROM ba) WHERE NOT near OR none_left)"""
STAT_SQL = f"""
fc AS (WITH g AS (SELECT clip, frame_idx, sv AS value FROM mk), {ADAPTIVE_SQL} SELECT clip, mode, CASE WHEN mode = 'split' THEN split ELSE greatest(0.6::DOUBLE * quiet, 0.3::DOUBLE * mid) END AS threshold FROM o),
ss AS (SELECT clip, quantile_cont(sv, 0.99) / greatest(quantile_cont(sv, 0.5), 1e-8) AS sep FROM m GROUP BY clip),
stat AS (SELECT clip, threshold, mode, sep, sep < 1.9::DOUBLE AND mode = 'keep' AS unimodal FROM fc JOIN ss USING (clip))"""


def roles(spark, sf) -> tuple[DataFrame, DataFrame]:
    ev = event_frames(spark, sf, LASTING)
    return ev.where(F.col("cents") > BLAST).select("clip", "at_idx").distinct(), ev.where(F.col("cents") <= BLAST).withColumn("to_idx", F.col("at_idx") + F.col("event_id") % 6)


def away(frames: DataFrame, blasts: DataFrame) -> DataFrame:
    """Frames that no blast is near, or all of a clip if none would be left. A blast is dealt to the few frames around it."""
    near = blasts.withColumn("frame_idx", F.explode(F.sequence(F.col("at_idx") - AWAY, F.col("at_idx") + AWAY))).select("clip", "frame_idx").distinct().withColumn("near", F.lit(True))
    x = frames.join(near, ["clip", "frame_idx"], "left").withColumn("near", F.coalesce("near", F.lit(False))).withColumn("none", F.bool_and("near").over(Window.partitionBy("clip")))
    return x.where(~F.col("near") | F.col("none")).drop("near", "none")


@query(f"WITH {SMOOTH_SQL}, {ROLE_SQL}, {MASK_SQL} SELECT clip, frame_idx FROM mk")
def blast_mask(spark, sf):
    return away(smooth(spark, sf), roles(spark, sf)[0]).select("clip", "frame_idx")


def stats(sm: DataFrame, blasts: DataFrame) -> DataFrame:
    """Per clip the floor of the frames away from blasts, how far the loud part is from the middle, and whether it has one mode."""
    floor = adaptive.adaptive_floor(away(sm, blasts), K, "frame_idx", "smooth").select("clip", "mode", "threshold")
    sep = sm.groupBy("clip").agg((F.percentile("smooth", 0.99) / F.greatest(F.percentile("smooth", 0.5), F.lit(1e-8))).alias("sep"))
    return floor.join(sep, "clip").withColumn("unimodal", (F.col("sep") < 1.9) & (F.col("mode") == "keep"))


@query(f"WITH {SMOOTH_SQL}, {ROLE_SQL}, {MASK_SQL}, {STAT_SQL} SELECT clip, mode, round(threshold, 6) AS threshold, round(sep, 6) AS sep, unimodal FROM stat")
def salience_stats(spark, sf):
    return stats(smooth(spark, sf), roles(spark, sf)[0]).select("clip", "mode", F.round("threshold", 6).alias("threshold"), F.round("sep", 6).alias("sep"), "unimodal")


LEAST = 3
WHOLE_SQL = f"""{SMOOTH_SQL}, {ROLE_SQL}, {MASK_SQL}, {STAT_SQL}, fl AS (SELECT m.*, threshold AS floor FROM m JOIN stat USING (clip)), {islands_sql('fl', LEAST, 1, 2)},
go AS (SELECT isl.* FROM isl JOIN stat USING (clip) WHERE NOT unimodal AND NOT EXISTS (SELECT 1 FROM bl WHERE bl.clip = isl.clip AND abs(bl.at_idx - peak_idx) <= 1) AND NOT (hi_idx - lo_idx < 5 AND EXISTS (SELECT 1 FROM bl WHERE bl.clip = isl.clip AND bl.at_idx BETWEEN lo_idx - 2 AND hi_idx))),
be AS (SELECT go.clip, lo_idx, max((cents, -event_id)) AS b FROM go JOIN ve ON ve.clip = go.clip AND ve.at_idx - 1 <= hi_idx AND to_idx + 1 >= lo_idx GROUP BY ALL), te AS (SELECT clip, max((cents, -event_id)) AS t FROM ve GROUP BY clip),
lo AS (SELECT ve.*, curve.value AS level, curve.floor FROM ve JOIN stat ON stat.clip = ve.clip AND NOT unimodal JOIN fl curve ON curve.clip = ve.clip AND curve.frame_idx = ve.at_idx WHERE NOT EXISTS (SELECT 1 FROM isl WHERE isl.clip = ve.clip AND ve.at_idx <= hi_idx AND to_idx >= lo_idx)),
ln AS (SELECT lo.event_id, lo.clip, at_idx, level, lo.floor, frame_idx - at_idx AS o, fl.value AS v FROM lo JOIN fl ON fl.clip = lo.clip AND frame_idx BETWEEN at_idx - 4 AND at_idx + 4),
lb AS (SELECT event_id, clip, at_idx, any_value(level) AS level, any_value(floor) AS floor, coalesce(max(o) FILTER (o < 0 AND v < floor) + 1, min(o)) AS l, coalesce(min(o) FILTER (o > 0 AND v < floor) - 1, max(o)) AS h FROM ln GROUP BY ALL),
ou AS (SELECT clip, lo_idx, hi_idx, -coalesce(b, t)[2] AS event_id, b IS NULL AS by_level, 'stretch' AS how FROM go LEFT JOIN be USING (clip, lo_idx) JOIN te USING (clip)
  UNION ALL SELECT clip, at_idx, to_idx, event_id, false, 'one mode' FROM ve JOIN stat USING (clip) WHERE unimodal
  UNION ALL SELECT clip, at_idx + l, at_idx + h, event_id, false, 'cropped' FROM lb WHERE level >= floor AND h - l + 1 >= {LEAST})"""


def whole(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The gate's rows, and those of the lasting events outside all stretches with their level, floor and loud surroundings."""
    sm, (blasts, lasting) = smooth(spark, sf), roles(spark, sf)
    st = stats(sm, blasts)
    fl = settled(sm.join(st.select("clip", F.col("threshold").alias("floor"), "unimodal"), "clip"))
    isl = settled(loud.loud_islands(fl.where("NOT unimodal"), K, "frame_idx", "value", "smooth", "floor", LEAST, 1, reach=2))
    cover = lambda a, b: F.explode(F.sequence(a, b)).alias("at_idx")
    lo, hi = F.col("lo_idx"), F.col("hi_idx")
    at_peak = isl.select("clip", "lo_idx", cover(F.col("peak_idx") - 1, F.col("peak_idx") + 1)).join(blasts, ["clip", "at_idx"], "left_semi").select("clip", "lo_idx")
    decay = isl.where(hi - lo < 5).select("clip", "lo_idx", cover(lo - 2, hi)).join(blasts, ["clip", "at_idx"], "left_semi").select("clip", "lo_idx")
    go = isl.join(at_peak.union(decay).distinct(), ["clip", "lo_idx"], "left_anti")
    frames = lambda e, pad: e.select("clip", "event_id", "cents", cover(F.col("at_idx") - pad, F.col("to_idx") + pad))
    strongest = F.max(F.struct("cents", (-F.col("event_id")).alias("i")))
    best = go.select("clip", "lo_idx", cover(lo, hi)).join(frames(lasting, 1), ["clip", "at_idx"]).groupBy("clip", "lo_idx").agg(strongest.alias("b"))
    template = lasting.groupBy("clip").agg(strongest.alias("t"))
    stretch = go.join(best, ["clip", "lo_idx"], "left").join(template, "clip").select("clip", "lo_idx", "hi_idx", (-F.coalesce("b", "t")["i"]).alias("event_id"), F.col("b").isNull().alias("by_level"), F.lit("stretch").alias("how"))
    one = lasting.join(fl.select("clip", "unimodal").distinct().where("unimodal").select("clip"), "clip", "left_semi").select("clip", F.col("at_idx").alias("lo_idx"), F.col("to_idx").alias("hi_idx"), "event_id", F.lit(False).alias("by_level"), F.lit("one mode").alias("how"))
    touched = isl.select("clip", cover(lo, hi)).join(frames(lasting, 0), ["clip", "at_idx"]).select("event_id").distinct()
    lone = lasting.join(touched, "event_id", "left_anti").join(fl.where("NOT unimodal").select("clip", F.col("frame_idx").alias("at_idx"), F.col("value").alias("level"), "floor"), ["clip", "at_idx"])
    near = lone.withColumn("o", F.explode(F.sequence(F.lit(-4), F.lit(4)))).withColumn("frame_idx", F.col("at_idx") + F.col("o")).join(fl.select("clip", "frame_idx", "value"), ["clip", "frame_idx"])
    low, o = F.col("value") < F.col("floor"), F.col("o")
    lone = near.groupBy("clip", "event_id", "at_idx", "to_idx", "level", "floor").agg(F.coalesce(F.max(F.when(low & (o < 0), o)) + 1, F.min("o")).alias("l"), F.coalesce(F.min(F.when(low & (o > 0), o)) - 1, F.max("o")).alias("h"))
    kept = lone.where((F.col("level") >= F.col("floor")) & (F.col("h") - F.col("l") + 1 >= LEAST))
    crop = kept.select("clip", (F.col("at_idx") + F.col("l")).alias("lo_idx"), (F.col("at_idx") + F.col("h")).alias("hi_idx"), "event_id", F.lit(False).alias("by_level"), F.lit("cropped").alias("how"))
    return stretch.unionByName(one).unionByName(crop), lone


@query(f"WITH {WHOLE_SQL} SELECT * FROM ou")
def sustained_gate_whole(spark, sf):
    """Loud stretches that are no blast and no decay right after one, each due to the strongest lasting event that overlaps it, or
    to the clip's strongest; lasting events outside all stretches cropped to what is loud around them; clips of one mode as they are."""
    return whole(spark, sf)[0]


@query(f"WITH {WHOLE_SQL} SELECT event_id, clip, round(level, 4) AS level, round(floor, 4) AS floor, CASE WHEN level < floor THEN 'below the floor' ELSE 'too short' END AS reason FROM lb WHERE level < floor OR h - l + 1 < {LEAST}")
def sustained_gate_drops(spark, sf):
    """What the gate dropped and why."""
    quiet = F.col("level") < F.col("floor")
    lone = whole(spark, sf)[1].where(quiet | (F.col("h") - F.col("l") + 1 < LEAST))
    return lone.select("event_id", "clip", F.round("level", 4).alias("level"), F.round("floor", 4).alias("floor"), F.when(quiet, "below the floor").otherwise("too short").alias("reason"))


@query(f"""WITH {WHOLE_SQL}, p AS (SELECT clip, count(*) AS proposals FROM ve GROUP BY clip), k AS (SELECT clip, count(*) AS kept, count(*) FILTER (by_level) AS by_level FROM ou GROUP BY clip), q AS (SELECT clip, count(*) FILTER (level < floor) AS quiet, count(*) FILTER (level >= floor AND h - l + 1 < {LEAST}) AS short FROM lb GROUP BY clip)
SELECT clip, proposals, coalesce(kept, 0) AS kept, coalesce(by_level, 0) AS by_level, coalesce(quiet, 0) AS quiet, coalesce(short, 0) AS short, round(threshold, 4) AS threshold, unimodal FROM p LEFT JOIN k USING (clip) LEFT JOIN q USING (clip) JOIN stat USING (clip)""")
def gate_counts(spark, sf):
    """The gate's report: a row per clip."""
    rows, lone = whole(spark, sf)
    blasts, lasting = roles(spark, sf)
    st = stats(smooth(spark, sf), blasts).select("clip", F.round("threshold", 4).alias("threshold"), "unimodal")
    quiet = F.col("level") < F.col("floor")
    k = rows.groupBy("clip").agg(F.count(F.lit(1)).alias("kept"), F.count(F.when(F.col("by_level"), 1)).alias("by_level"))
    q = lone.groupBy("clip").agg(F.count(F.when(quiet, 1)).alias("quiet"), F.count(F.when(~quiet & (F.col("h") - F.col("l") + 1 < LEAST), 1)).alias("short"))
    out = lasting.groupBy("clip").agg(F.count(F.lit(1)).alias("proposals")).join(k, "clip", "left").join(q, "clip", "left").join(st, "clip")
    return out.select("clip", "proposals", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("kept", "by_level", "quiet", "short")], "threshold", "unimodal")


HALF = 450_000


@query(f"""WITH {S_SQL}, p AS (SELECT clip, event_id, t_us FROM s WHERE category = 'purchase'), r AS (SELECT clip, event_id, category, t_us AS start_us, t_us AS peak_us, end_us FROM s WHERE category NOT IN ('view', 'purchase')
UNION ALL SELECT clip, event_id, 'view', greatest(0, t_us - {HALF * 35 // 100}), t_us, t_us + {HALF} FROM p) SELECT *, row_number() OVER (PARTITION BY clip ORDER BY start_us, event_id) AS place FROM r""")
def replace_category(spark, sf):
    """All rows of one category give way to rows made of marked peaks; the clip is put in order again."""
    s = d.spans(spark, sf)
    kept = s.where("category NOT IN ('view', 'purchase')").select("clip", "event_id", "category", F.col("t_us").alias("start_us"), F.col("t_us").alias("peak_us"), "end_us")
    rows = kept.unionByName(from_peaks(s.where("category = 'purchase'"), "view"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("clip").orderBy("start_us", "event_id")).cast("long"))


def from_peaks(marks: DataFrame, category: str) -> DataFrame:
    """A lasting event for each marked peak: a third of its length before it."""
    t = F.col("t_us")
    return marks.select("clip", "event_id", F.lit(category).alias("category"), F.greatest(F.lit(0).cast("long"), t - HALF * 35 // 100).alias("start_us"), t.alias("peak_us"), (t + HALF).alias("end_us"))


@query(f"WITH {S_SQL} SELECT event_id, greatest(0, t_us - {HALF * 35 // 100}) AS start_us, t_us AS peak_us, t_us + {HALF} AS end_us, 1.0::DOUBLE AS confidence FROM s WHERE category = 'purchase'")
def events_from_peaks(spark, sf):
    return from_peaks(d.spans(spark, sf).where("category = 'purchase'"), "vehicle").select("event_id", "start_us", "peak_us", "end_us", F.lit(1.0).alias("confidence"))


@query(f"""WITH {S_SQL}, w AS (SELECT clip, max(end_us) AS dur FROM s GROUP BY clip), b AS (SELECT event_id, dur, least(t_us, t_us + (event_id % 5) * {HOUR} - {HOUR // 2}) AS a, greatest(end_us, t_us + (event_id % 5) * {HOUR} + {HOUR}) AS e FROM s JOIN w USING (clip)),
c AS (SELECT event_id, dur, greatest(0, a) AS a, e FROM b) SELECT event_id, CASE WHEN e - a < {6 * HOUR} THEN greatest(0, least(dur, a + {6 * HOUR}) - {6 * HOUR}) ELSE a END AS start_us, least(dur, CASE WHEN e - a < {6 * HOUR} THEN least(dur, a + {6 * HOUR}) ELSE e END) AS end_us FROM c""")
def clip_bounds(spark, sf):
    """The stretch to cut out for an event: its span and its peak with some time around, of a least length, inside the clip."""
    s = d.spans(spark, sf).withColumn("dur", F.max("end_us").over(Window.partitionBy("clip"))).withColumn("peak", F.col("t_us") + (F.col("event_id") % 5) * HOUR)
    a, e, dur = F.greatest(F.lit(0), F.least(F.col("t_us"), F.col("peak") - HOUR // 2)), F.greatest(F.col("end_us"), F.col("peak") + HOUR), F.col("dur")
    s = s.withColumn("a", a).withColumn("e", e)
    short, grown = F.col("e") - F.col("a") < 6 * HOUR, F.least(dur, F.col("a") + 6 * HOUR)
    return s.select("event_id", F.when(short, F.greatest(F.lit(0), grown - 6 * HOUR)).otherwise(F.col("a")).alias("start_us"), F.least(dur, F.when(short, grown).otherwise(F.col("e"))).alias("end_us"))
