"""Queries on rendering: levels, ducking, carriers, tracks and the stitched timeline."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import frames, render
from . import derived as d
from .derived import G_SQL
from .gating import event_frames, event_frames_sql
from .registry import K, query

PI = repr(math.pi)
DUCK_SQL = f"""{G_SQL}, {event_frames_sql(20000)},
ds AS (SELECT clip, at_idx AS s, at_idx + 3 AS e_ FROM ef), da AS (SELECT clip, s, e_, unnest(range(s - 4, e_ + 4)) AS frame_idx FROM ds),
dk AS (SELECT clip, frame_idx, CASE WHEN frame_idx < s THEN frame_idx - s + 4 WHEN frame_idx >= e_ THEN e_ + 3 - frame_idx END AS k FROM da),
dg AS (SELECT clip, frame_idx, min(CASE WHEN k IS NULL THEN 0.28::DOUBLE ELSE 1.0::DOUBLE - 0.72::DOUBLE * ((1.0::DOUBLE - cos({PI}::DOUBLE * k / 3.0::DOUBLE)) / 2) END) AS gain FROM dk GROUP BY ALL),
duck AS (SELECT g.*, coalesce(gain, 1.0::DOUBLE) AS gain FROM g LEFT JOIN dg USING (clip, frame_idx))"""


def ducked(spark, sf):
    spans = event_frames(spark, sf, 20000).select("clip", F.col("at_idx").alias("s"), (F.col("at_idx") + 3).alias("e"))
    return render.duck(d.grid(spark, sf), spans, K, "frame_idx", "s", "e", 0.28, 4)


@query(f"WITH {DUCK_SQL} SELECT clip, frame_idx, round(gain, 6) AS gain FROM duck")
def duck_envelope(spark, sf):
    return ducked(spark, sf).select("clip", "frame_idx", F.round("gain", 6).alias("gain"))


@query(f"WITH {G_SQL}, w AS (SELECT clip, sqrt(avg(value * value)) AS rms, max(abs(value)) AS top FROM g GROUP BY clip) SELECT clip, frame_idx, round(value * CASE WHEN top > 0 THEN least(0.707::DOUBLE * 0.6::DOUBLE / rms, 0.95::DOUBLE / top) ELSE 1.0::DOUBLE END, 6) AS value FROM g JOIN w USING (clip)")
def energy_normalize(spark, sf):
    g = d.grid(spark, sf)
    return g.select("clip", "frame_idx", F.round(F.col("value") * render.energy_scale(g, K, "value", 0.6), 6).alias("value"))


@query(f"WITH {G_SQL}, w AS (SELECT *, max(value) OVER (PARTITION BY clip ORDER BY frame_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS held, max(value) OVER (PARTITION BY clip) AS top FROM g) SELECT clip, frame_idx, round(CASE WHEN top > 0 THEN value / top * least(pow(greatest(held / top, 1e-6::DOUBLE), -0.95::DOUBLE), 100.0::DOUBLE) ELSE value END, 5) AS value FROM w")
def level_audio(spark, sf):
    """Brought to an even level by the held envelope, by 40 dB at most."""
    g = frames.peak_hold(d.grid(spark, sf), K, "frame_idx", "value", 2).withColumn("top", F.max("value").over(Window.partitionBy("clip")))
    gain = F.least(F.pow(F.greatest(F.try_divide("held", "top"), F.lit(1e-6)), F.lit(-0.95)), F.lit(100.0))
    return g.select("clip", "frame_idx", F.round(F.when(F.col("top") > 0, F.try_divide("value", "top") * gain).otherwise(F.col("value")), 5).alias("value"))


@query(f"WITH {G_SQL}, {event_frames_sql(15000)} SELECT event_id, round(sqrt(avg(g.value * g.value)), 6) AS rms FROM ef JOIN g ON g.clip = ef.clip AND g.frame_idx BETWEEN at_idx AND at_idx + 4 GROUP BY event_id")
def span_level(spark, sf):
    """Root mean square of the signal under each event."""
    at = event_frames(spark, sf, 15000).withColumn("frame_idx", F.explode(F.sequence(F.col("at_idx"), F.col("at_idx") + 4)))
    return at.join(d.grid(spark, sf), ["clip", "frame_idx"]).groupBy("event_id").agg(F.round(F.sqrt(F.avg(F.col("value") * F.col("value"))), 6).alias("rms"))


PLACED_SQL = f"{event_frames_sql(20000)}, pg AS (SELECT *, lead(at_idx) OVER (PARTITION BY clip ORDER BY at_idx, event_id) - at_idx AS gap FROM ef), placed AS (SELECT *, CASE WHEN gap > 0 AND gap < 6 THEN gap ELSE 6 END AS keep FROM pg)"


def placed(spark, sf):
    return render.keep_until_next(event_frames(spark, sf, 20000).withColumn("length", F.lit(6).cast("long")), K, "at_idx", "length", "event_id")


@query(f"WITH {G_SQL}, {PLACED_SQL} SELECT event_id, at_idx, keep, keep < 6 AS cut FROM placed")
def volley_trim(spark, sf):
    return placed(spark, sf).select("event_id", "at_idx", "keep", "cut")


@query(f"""WITH {DUCK_SQL}, pg AS (SELECT *, lead(at_idx) OVER (PARTITION BY clip ORDER BY at_idx, event_id) - at_idx AS gap FROM ef), placed AS (SELECT *, CASE WHEN gap > 0 AND gap < 6 THEN gap ELSE 6 END AS keep FROM pg),
pk AS (SELECT clip, cents, at_idx, keep, unnest(range(0, keep)) AS k FROM placed),
ps AS (SELECT clip, at_idx + k AS frame_idx, CAST(sum(CAST(round(0.9::DOUBLE * (cents / 50000.0::DOUBLE) * (1.0::DOUBLE - k / 6.0::DOUBLE) * 1e6::DOUBLE) AS BIGINT)) AS BIGINT) AS u FROM pk GROUP BY ALL),
tp AS (SELECT clip, max(value) AS top FROM g GROUP BY clip)
SELECT clip, frame_idx, round(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN top > 0 THEN value / top * 0.35::DOUBLE * gain ELSE 0.0 END + coalesce(u, 0) / 1e6::DOUBLE)), 6) AS value FROM duck JOIN tp USING (clip) LEFT JOIN ps USING (clip, frame_idx)""")
def stitch_timeline(spark, sf):
    """A ducked bed with fading accents on top; each accent ends where the next one starts."""
    top = F.max("value").over(Window.partitionBy("clip"))
    base = ducked(spark, sf).withColumn("top", top).withColumn("bed", F.when(F.col("top") > 0, F.try_divide("value", "top") * 0.35 * F.col("gain")).otherwise(0.0)).select("clip", "frame_idx", "bed")
    sample = F.lit(0.9) * (F.col("cents") / F.lit(50000.0)) * (F.lit(1.0) - F.col("k") / F.lit(6.0))
    return render.mix(base, placed(spark, sf), K, "frame_idx", "bed", "at_idx", "keep", sample).withColumn("value", F.round("value", 6))


INTENSITY_SQL = f"{G_SQL}, w AS (SELECT clip, frame_idx // 3 AS win, greatest(max(abs(value)), sqrt(avg(value * value)) * sqrt(2.0::DOUBLE)) AS lv FROM g GROUP BY ALL), tr AS (SELECT clip, win, CASE WHEN max(lv) OVER (PARTITION BY clip) > 0 THEN CAST(floor(255.0::DOUBLE * lv / max(lv) OVER (PARTITION BY clip)) AS BIGINT) ELSE 0 END AS intensity FROM w)"


def track(spark, sf):
    level = F.greatest(F.max(F.abs("value")), F.sqrt(F.avg(F.col("value") * F.col("value"))) * F.sqrt(F.lit(2.0)))
    w = d.grid(spark, sf).groupBy("clip", F.floor(F.col("frame_idx") / 3).alias("win")).agg(level.alias("lv")).withColumn("top", F.max("lv").over(Window.partitionBy("clip")))
    return w.select("clip", "win", F.when(F.col("top") > 0, F.floor(F.try_divide(F.lit(255.0) * F.col("lv"), "top"))).otherwise(0).cast("long").alias("intensity"))


@query(f"WITH {INTENSITY_SQL} SELECT clip, win, intensity FROM tr")
def intensity_track(spark, sf):
    return track(spark, sf)


@query(f"WITH {INTENSITY_SQL} SELECT clip, '{{' || string_agg('\"' || (win * 40) || '\":' || intensity, ',' ORDER BY win) || '}}' AS track FROM tr GROUP BY clip")
def rule_track(spark, sf):
    """A map of window start to intensity for each clip, as JSON; a clip's map is one value by its format."""
    entries = F.array_sort(F.collect_list(F.struct((F.col("win") * 40).alias("ms"), F.col("intensity").alias("v"))))
    return track(spark, sf).groupBy("clip").agg(F.to_json(F.map_from_entries(entries)).alias("track"))


@query(f"WITH {INTENSITY_SQL}, n AS (SELECT clip, win, intensity, unnest(range(0, 8)) AS k FROM tr) SELECT clip, win * 8 + k AS n, round(sin(2 * {PI}::DOUBLE * 175 * (win * 8 + k) / 8000.0::DOUBLE) * intensity / 255.0::DOUBLE, 5) AS value FROM n")
def rule_carrier(spark, sf):
    """A sine of 175 Hz under the track, 8 samples of each window at 8 kHz."""
    n = track(spark, sf).withColumn("n", F.explode(F.sequence(F.col("win") * 8, F.col("win") * 8 + 7)))
    return n.select("clip", "n", F.round(F.sin(F.lit(2 * math.pi * 175) * F.col("n") / 8000.0) * F.col("intensity") / 255.0, 5).alias("value"))
