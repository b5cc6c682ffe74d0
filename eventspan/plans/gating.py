"""Queries on loud stretches, scenes and the gate for sustained events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import adaptive, frames, loud
from ..session import settled
from . import derived as d
from .derived import ADAPTIVE_SQL, G_SQL, HOUR, smooth_sql
from .registry import K, query

SMOOTH_SQL = f"{G_SQL}, {smooth_sql('g', 'value', 2, 'quantile_cont(v, 0.5)')}"


def smooth(spark, sf):
    return frames.median_smooth(d.grid(spark, sf), K, "frame_idx", "value", 5)


def event_frames(spark, sf, cents: int):
    """event_id, clip, at_idx of events above an amount, on the grid of their category."""
    e = d.events(spark, sf)
    hour = lambda c: F.floor(c / F.lit(HOUR)).cast("long")
    first = e.agg(hour(F.min("t_us")).alias("h0"))
    return e.where(F.col("cents") > cents).crossJoin(F.broadcast(first)).select("event_id", F.col("category").alias("clip"), (hour(F.col("t_us")) - F.col("h0")).alias("at_idx"), "cents")


def event_frames_sql(cents: int) -> str:
    return f"ef AS (SELECT event_id, category AS clip, t_us // {HOUR} - (SELECT min(slot) FROM c) AS at_idx, cents FROM e WHERE cents > {cents})"


@query(f"""WITH {G_SQL}, l AS (SELECT *, frame_idx - lag(frame_idx) OVER (PARTITION BY clip ORDER BY frame_idx) AS gap FROM g WHERE value >= 45),
k AS (SELECT *, sum(CASE WHEN gap <= 2 THEN 0 ELSE 1 END) OVER (PARTITION BY clip ORDER BY frame_idx ROWS UNBOUNDED PRECEDING) AS seg FROM l)
SELECT clip, min(frame_idx) AS first_idx, max(frame_idx) AS last_idx, -max((value, -frame_idx))[2] AS peak_idx, round(max(value), 6) AS peak FROM k GROUP BY clip, seg HAVING max(frame_idx) - min(frame_idx) + 1 >= 3""")
def segments_above_level(spark, sf):
    return loud.segments_above(d.grid(spark, sf), K, "frame_idx", "value", 45.0, 1, 3).withColumn("peak", F.round("peak", 6))


def islands_sql(source: str, least: int, bridge: int, reach: int) -> str:
    """CTEs up to `isl` (clip, lo_idx, peak_idx, hi_idx) from a source with value, sv and floor."""
    return f"""
ie AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY clip ORDER BY frame_idx) AS run FROM {source} WHERE sv >= 0.75::DOUBLE * floor),
ix AS (SELECT *, min(frame_idx) OVER (PARTITION BY clip, run) AS e0, max(frame_idx) OVER (PARTITION BY clip, run) AS e1 FROM ie),
il AS (SELECT *, frame_idx - lag(frame_idx) OVER (PARTITION BY clip ORDER BY frame_idx) AS gap FROM ix WHERE sv >= floor),
ik AS (SELECT *, sum(CASE WHEN gap <= {bridge + 1} THEN 0 ELSE 1 END) OVER (PARTITION BY clip ORDER BY frame_idx ROWS UNBOUNDED PRECEDING) AS seg FROM il),
ic AS (SELECT clip, min(frame_idx) AS a, max(frame_idx) AS b, count(*) AS n_on, min(e0) AS e0, max(e1) AS e1 FROM ik GROUP BY clip, seg),
iw AS (SELECT clip, a, b, greatest(a - {reach}, e0) AS lo, least(b + {reach}, e1) AS hi FROM ic WHERE b - a + 1 >= {least} AND n_on / (b - a + 1)::DOUBLE >= 0.55::DOUBLE),
ir AS (SELECT *, max(hi) OVER (PARTITION BY clip ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM iw),
ij AS (SELECT *, sum(CASE WHEN lo <= upto THEN 0 ELSE 1 END) OVER (PARTITION BY clip ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS isl FROM ir),
im AS (SELECT clip, min(lo) AS lo, max(hi) AS hi, min(a) AS a, max(b) AS b, count(*) AS n FROM ij GROUP BY clip, isl),
isl AS (SELECT im.clip, lo AS lo_idx, -max((x.value, -x.frame_idx))[2] AS peak_idx, hi AS hi_idx FROM im JOIN {source} x ON x.clip = im.clip AND x.frame_idx BETWEEN CASE WHEN n = 1 THEN a ELSE lo END AND CASE WHEN n = 1 THEN b ELSE hi END GROUP BY im.clip, lo, hi)"""


@query(f"WITH {SMOOTH_SQL}, fl AS (SELECT *, 50.0::DOUBLE AS floor FROM m), {islands_sql('fl', 3, 1, 2)} SELECT * FROM isl")
def rms_islands(spark, sf):
    return loud.loud_islands(smooth(spark, sf).withColumn("floor", F.lit(50.0)), K, "frame_idx", "value", "smooth", "floor", 3, 1, reach=2)


@query(f"""WITH {G_SQL}, {event_frames_sql(15000)}, n AS (SELECT ef.event_id, ef.clip, at_idx, frame_idx - at_idx AS o, value AS v FROM ef JOIN g ON g.clip = ef.clip AND g.frame_idx BETWEEN at_idx - 4 AND at_idx + 4),
b AS (SELECT event_id, coalesce(max(o) FILTER (o < 0 AND v < 30) + 1, min(o)) AS l, coalesce(min(o) FILTER (o > 0 AND v < 30) - 1, max(o)) AS h FROM n GROUP BY event_id)
SELECT clip, event_id, at_idx + l AS lo_idx, at_idx - max((v, -o))[2] AS peak_idx, at_idx + h AS hi_idx FROM n JOIN b USING (event_id) WHERE o BETWEEN l AND h GROUP BY clip, event_id, at_idx, l, h""")
def crop_to_loud(spark, sf):
    return loud.crop_to_loud(event_frames(spark, sf, 15000), d.grid(spark, sf), K, "event_id", "at_idx", "frame_idx", "value", F.lit(30.0), 4)


SCENE_SQL = """
se AS (SELECT clip, min(frame_idx) AS first, max(frame_idx) AS last FROM m GROUP BY clip),
sb AS (SELECT m.clip, first, last, (frame_idx - first) // 12 AS b, quantile_cont(sv, 0.9) AS lv FROM m JOIN se USING (clip) GROUP BY ALL),
sl AS (SELECT *, first + b * 12 AS t FROM sb WHERE first + b * 12 < last),
sw AS (SELECT *, count(*) OVER lw AS ln, count(*) OVER rw AS rn, quantile_cont(lv, 0.5) OVER lw AS lm, quantile_cont(lv, 0.5) OVER rw AS rm,
  max(lv) OVER lw <= 1.6::DOUBLE * greatest(min(lv) OVER lw, 1e-9) AS lok, max(lv) OVER rw <= 1.6::DOUBLE * greatest(min(lv) OVER rw, 1e-9) AS rok
  FROM sl WINDOW lw AS (PARTITION BY clip ORDER BY b ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), rw AS (PARTITION BY clip ORDER BY b ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)),
sc AS (SELECT clip, t, greatest(lm, rm) / greatest(least(lm, rm), 1e-9) AS ratio FROM sw WHERE ln = 3 AND rn = 3 AND lok AND rok AND t - first >= 36 AND last - t >= 36),
sg AS (SELECT clip, unnest(list_reduce(list([t] ORDER BY ratio DESC, t DESC), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: abs(y - x[1]) < 36)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS t FROM sc WHERE ratio >= 1.15::DOUBLE GROUP BY clip),
su AS (SELECT clip, first AS start_idx FROM se UNION ALL SELECT clip, t FROM sg),
scene AS (SELECT su.clip, start_idx, coalesce(lead(start_idx) OVER (PARTITION BY su.clip ORDER BY start_idx), last + 1) AS end_idx FROM su JOIN se ON se.clip = su.clip)"""


def scene_rows(sm):
    return loud.scenes(sm, K, "frame_idx", "smooth", 12, 3, 36, 1.15, 1.6)


@query(f"WITH {SMOOTH_SQL}, {SCENE_SQL} SELECT * FROM scene")
def scene_segmentation(spark, sf):
    return scene_rows(smooth(spark, sf))


# Each scene is a series of its own, named by its clip and start; the floor of its clip bounds it from below.
CURVE_SQL = f"""{SMOOTH_SQL}, {SCENE_SQL},
cs AS (SELECT m.clip AS whole, m.clip || '#' || start_idx AS clip, m.frame_idx, m.value AS raw, m.sv AS value, start_idx FROM m JOIN scene ON scene.clip = m.clip AND m.frame_idx >= start_idx AND m.frame_idx < end_idx),
cf AS (WITH g AS (SELECT clip, frame_idx, value FROM cs), {ADAPTIVE_SQL} SELECT clip, CASE WHEN mode = 'split' THEN split ELSE greatest(0.6::DOUBLE * quiet, 0.3::DOUBLE * mid) END AS threshold FROM o),
cl AS (SELECT clip AS whole, 0.16::DOUBLE * quantile_cont(sv, 0.99) AS least FROM m GROUP BY clip),
curve AS (SELECT cs.whole AS clip, frame_idx, raw AS value, value AS sv, greatest(threshold, least) AS floor FROM cs JOIN cf USING (clip) JOIN cl ON cl.whole = cs.whole)"""


def curve(spark, sf):
    """clip, frame_idx, value, smooth, floor: one floor for each scene."""
    sm = smooth(spark, sf)
    rows = scene_rows(sm).withColumn("frame_idx", F.explode(F.sequence(F.col("start_idx"), F.col("end_idx") - 1))).drop("end_idx")
    s = sm.join(rows, ["clip", "frame_idx"])
    floors = adaptive.adaptive_floor(s, ["clip", "start_idx"], "frame_idx", "smooth").select("clip", "start_idx", "threshold")
    least = sm.groupBy("clip").agg((F.lit(0.16) * F.percentile("smooth", 0.99)).alias("least"))
    return s.join(floors, ["clip", "start_idx"]).join(least, "clip").select("clip", "frame_idx", "value", "smooth", F.greatest("threshold", "least").alias("floor"))


@query(f"WITH {CURVE_SQL} SELECT clip, frame_idx, round(floor, 6) AS floor FROM curve")
def floor_curve(spark, sf):
    return curve(spark, sf).select("clip", "frame_idx", F.round("floor", 6).alias("floor"))


GATE_SQL = f"""{CURVE_SQL}, {islands_sql('curve', 3, 1, 2)}, {event_frames_sql(2000)},
best AS (SELECT isl.clip, lo_idx, max((cents, -event_id)) AS b FROM isl JOIN ef ON ef.clip = isl.clip AND at_idx BETWEEN lo_idx AND hi_idx GROUP BY ALL),
lone AS (SELECT ef.*, curve.value, curve.floor FROM ef JOIN curve ON curve.clip = ef.clip AND frame_idx = at_idx WHERE NOT EXISTS (SELECT 1 FROM isl WHERE isl.clip = ef.clip AND at_idx BETWEEN lo_idx AND hi_idx))"""


def gate(spark, sf):
    """Islands with the strongest event inside them, and the events outside all islands with level and floor at their frame."""
    c = settled(curve(spark, sf))  # read three times
    isl = loud.loud_islands(c, K, "frame_idx", "value", "smooth", "floor", 3, 1, reach=2)
    inside = isl.select("clip", "lo_idx", F.explode(F.sequence("lo_idx", "hi_idx")).alias("at_idx"))
    ev = event_frames(spark, sf, 2000)
    best = inside.join(ev, ["clip", "at_idx"]).groupBy("clip", "lo_idx").agg(F.max(F.struct("cents", (-F.col("event_id")).alias("i"))).alias("b"))
    lone = ev.join(inside, ["clip", "at_idx"], "left_anti").join(c.withColumnRenamed("frame_idx", "at_idx"), ["clip", "at_idx"])
    return isl, best, lone


@query(f"WITH {GATE_SQL} SELECT isl.clip, isl.lo_idx, peak_idx, hi_idx, -b[2] AS event_id, b IS NULL AS by_level FROM isl LEFT JOIN best ON best.clip = isl.clip AND best.lo_idx = isl.lo_idx UNION ALL SELECT clip, at_idx, at_idx, at_idx, event_id, false FROM lone WHERE value >= floor")
def sustained_gate(spark, sf):
    """Loud stretches take the strongest event inside them (none: found by level alone); an event outside all of them stays as
    one frame if that frame reaches the floor."""
    isl, best, lone = gate(spark, sf)
    a = isl.join(best, ["clip", "lo_idx"], "left").select("clip", "lo_idx", "peak_idx", "hi_idx", (-F.col("b.i")).alias("event_id"), F.col("b").isNull().alias("by_level"))
    at = F.col("at_idx")
    return a.unionByName(lone.where("value >= floor").select("clip", at.alias("lo_idx"), at.alias("peak_idx"), at.alias("hi_idx"), "event_id", F.lit(False).alias("by_level")))


@query(f"WITH {GATE_SQL} SELECT event_id, clip, at_idx, round(value, 4) AS level, round(floor, 4) AS floor, 'below the floor of its scene' AS reason FROM lone WHERE value < floor")
def gate_report(spark, sf):
    """Why the gate dropped an event."""
    lone = gate(spark, sf)[2].where("value < floor")
    return lone.select("event_id", "clip", "at_idx", F.round("value", 4).alias("level"), F.round("floor", 4).alias("floor"), F.lit("below the floor of its scene").alias("reason"))
