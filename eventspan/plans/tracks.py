"""Queries on tracks and placements: percentile-stretched intensity, accents on a timeline, candidates of promotion, score tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import folds, frames, joins
from . import derived as d
from .derived import E_SQL, G_SQL, HOUR, P_SQL, S_SQL
from .registry import K, query


@query(f"""WITH {G_SQL}, m AS (SELECT clip, frame_idx, avg(value) OVER (PARTITION BY clip ORDER BY frame_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS v FROM g),
q AS (SELECT clip, list_sort(list(v)) AS l FROM m GROUP BY clip), ee AS (SELECT clip, l[CAST(round_even((len(l) - 1) * 0.05::DOUBLE, 0) AS INT) + 1] AS lo, l[CAST(round_even((len(l) - 1) * 0.95::DOUBLE, 0) AS INT) + 1] AS hi FROM q)
SELECT clip, frame_idx, CASE WHEN hi > lo THEN CAST(floor(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (v - lo) / (hi - lo))) * 255.0::DOUBLE + 0.5) AS INT) ELSE 0 END AS intensity FROM m JOIN ee USING (clip)""")
def stretched_track(spark, sf):
    """The older intensity track: a centred mean, stretched between two nearest-rank percentiles of the clip."""
    w = Window.partitionBy("clip").orderBy("frame_idx").rowsBetween(-2, 2)
    m = d.grid(spark, sf).withColumn("v", F.avg("value").over(w))
    e = m.groupBy("clip").agg(frames.nearest_rank(F.collect_list("v"), 0.05).alias("lo"), frames.nearest_rank(F.collect_list("v"), 0.95).alias("hi"))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(F.col("v") - F.col("lo"), F.col("hi") - F.col("lo"))))
    return m.join(e, "clip").select("clip", "frame_idx", F.when(F.col("hi") > F.col("lo"), F.floor(share * 255.0 + 0.5)).otherwise(0).cast("int").alias("intensity"))


# Accents: segments of a known length and onset, placed so that the onset lies a lead before the event's peak.
LEAD, TOTAL = HOUR // 4, 720 * HOUR
PLACE_SQL = f"""{S_SQL}, b AS (SELECT clip, min(t_us) AS t0 FROM s GROUP BY clip), x AS (SELECT s.event_id, s.clip, t_us - t0 AS a, end_us - t0 AS z, t_us - t0 + (event_id % 7) * {HOUR // 3} AS peak, (event_id % 5) * {HOUR // 2} AS onset, (1 + event_id % 9) * {HOUR} AS len FROM s JOIN b USING (clip) WHERE category IN ('click', 'error')),
y AS (SELECT *, peak - onset - {LEAD} AS p FROM x), v AS (SELECT event_id, clip, greatest(p, a, 0) AS ats, greatest(p, a, 0) - p AS skip, least(p + len, z, {TOTAL}) AS until FROM y), pl AS (SELECT *, until - ats AS keep FROM v WHERE until > ats)"""


@query(f"""WITH {PLACE_SQL}, n AS (SELECT *, lead(ats) OVER (PARTITION BY clip ORDER BY ats, event_id) AS nxt FROM pl) SELECT event_id, ats AS at_us, skip AS skip_us, CASE WHEN nxt > ats THEN least(keep, nxt - ats) ELSE keep END AS keep_us, nxt > ats AND nxt - ats < keep AS released FROM n""")
def accent_placements(spark, sf):
    """Where each accent starts, what of its segment is skipped so that it stays inside the event's span, and where the next accent
    cuts it short."""
    s = d.spans(spark, sf).withColumn("t0", F.min("t_us").over(Window.partitionBy("clip"))).where("category IN ('click', 'error')")
    a, z, i = F.col("t_us") - F.col("t0"), F.col("end_us") - F.col("t0"), F.col("event_id")
    p = a + (i % 7) * (HOUR // 3) - (i % 5) * (HOUR // 2) - LEAD
    at = F.greatest(p, a, F.lit(0).cast("long"))
    v = s.select("event_id", "clip", at.alias("at_us"), (at - p).alias("skip_us"), (F.least(p + (1 + i % 9) * HOUR, z, F.lit(TOTAL)) - at).alias("keep")).where("keep > 0")
    free = F.lead("at_us").over(Window.partitionBy("clip").orderBy("at_us", "event_id")) - F.col("at_us")
    v = v.withColumn("free", free)
    cut = F.coalesce(F.col("free") > 0, F.lit(False))
    return v.select("event_id", "at_us", "skip_us", F.when(cut, F.least("keep", "free")).otherwise(F.col("keep")).alias("keep_us"), F.when(F.col("free").isNotNull(), cut & (F.col("free") < F.col("keep"))).alias("released"))


@query(f"""WITH {G_SQL}, w AS (SELECT clip, max(value) AS loud FROM g GROUP BY clip), ev AS (SELECT event_id, category AS clip, t_us // {HOUR} - (SELECT min(slot) FROM c) AS a, t_us // {HOUR} - (SELECT min(slot) FROM c) + 1 + event_id % 5 AS z FROM e WHERE cents > 12000 AND category NOT IN ('click', 'error')),
l AS (SELECT event_id, ev.clip, sqrt(sum(value * value) / count(*)) AS level FROM ev JOIN g ON g.clip = ev.clip AND frame_idx >= a AND frame_idx < z GROUP BY ALL), t AS (SELECT clip, max(level) AS top FROM l GROUP BY clip) SELECT event_id, round(CASE WHEN top > 0 THEN level / top ELSE 0.0 END, 6) AS gain FROM l JOIN t USING (clip)""")
def sustained_gains(spark, sf):
    """Lasting events scaled by how loud the signal under them is beside the loudest one of the clip."""
    e, g = d.events(spark, sf), d.grid(spark, sf)
    hour = lambda c: F.floor(c / F.lit(HOUR)).cast("long")
    first = e.agg(hour(F.min("t_us")).alias("h0"))
    ev = e.where("cents > 12000 AND category NOT IN ('click', 'error')").crossJoin(F.broadcast(first)).select("event_id", F.col("category").alias("clip"), (hour(F.col("t_us")) - F.col("h0")).alias("a"))
    at = ev.withColumn("frame_idx", F.explode(F.sequence(F.col("a"), F.col("a") + F.col("event_id") % 5)))
    l = at.join(g, ["clip", "frame_idx"]).groupBy("event_id", "clip").agg(F.sqrt(F.sum(F.col("value") * F.col("value")) / F.count(F.lit(1))).alias("level"))
    top = F.max("level").over(Window.partitionBy("clip"))
    return l.select("event_id", F.round(F.when(top > 0, F.try_divide(F.col("level"), top)).otherwise(0.0), 6).alias("gain"))


@query(f"""WITH {P_SQL}, a AS (SELECT clip, frame_idx, score, frame_idx % 3 != 0 AS fine FROM p), k AS (SELECT clip, bool_and(fine) AS usable FROM (SELECT clip, count(*) FILTER (score > 0.5) > 250 AS fine FROM a GROUP BY clip) GROUP BY clip)
SELECT clip, CASE WHEN usable THEN 'dense' ELSE 'windowed' END AS backend, frame_idx, round(CASE WHEN usable THEN score ELSE w END, 6) AS score FROM (SELECT a.*, max(score) OVER (PARTITION BY clip ORDER BY frame_idx ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS w FROM a) JOIN k USING (clip) WHERE usable OR frame_idx % 6 = 5""")
def posterior_backend(spark, sf):
    """Frame scores of the first backend that has usable ones for a clip: dense ones, else one score for each window."""
    s = d.scores(spark, sf)
    use = s.groupBy("clip").agg((F.count(F.when(F.col("score") > 0.5, 1)) > 250).alias("usable"))
    w = F.max("score").over(Window.partitionBy("clip").orderBy("frame_idx").rowsBetween(-5, 0))
    x = s.withColumn("w", w).join(use, "clip").where("usable OR frame_idx % 6 = 5")
    return x.select("clip", F.when(F.col("usable"), "dense").otherwise("windowed").alias("backend"), "frame_idx", F.round(F.when(F.col("usable"), F.col("score")).otherwise(F.col("w")), 6).alias("score"))


@query(f"""WITH {E_SQL}, b AS (SELECT clip, t_us FROM e WHERE category = 'error'), c AS (SELECT event_id, clip, t_us FROM e WHERE category = 'click'), f AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.clip = c.clip AND abs(b.t_us - c.t_us) <= {4 * HOUR})),
k AS (SELECT clip, unnest(list_reduce(list([t_us] ORDER BY t_us), lambda acc, x: CASE WHEN x[1] - acc[-1] <= {4 * HOUR} THEN acc ELSE list_concat(acc, x) END)) AS t_us FROM f GROUP BY clip) SELECT clip, t_us FROM k""")
def candidates_accepted(spark, sf):
    """Candidates in time order that neither a known bang nor an accepted candidate is near."""
    e = d.events(spark, sf)
    bangs = e.where("category = 'error'").select("clip", F.col("t_us").alias("b_t"))
    free = joins.band_join(e.where("category = 'click'").select("clip", "t_us"), bangs, K, "t_us", "b_t", 4 * HOUR, "left_anti")
    return folds.keep_apart(free, K, "t_us", 4 * HOUR)


@query(f"""WITH {S_SQL}, b AS (SELECT clip, t_us, end_us FROM s WHERE category = 'error'), c AS (SELECT event_id, clip, t_us FROM s WHERE category = 'view' AND end_us - t_us <= {12 * HOUR})
SELECT event_id FROM c WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.clip = c.clip AND (abs(b.t_us - c.t_us) <= {2 * HOUR} OR c.t_us BETWEEN b.t_us - {HOUR} AND b.end_us + {HOUR}))""")
def chips_under_blasts(spark, sf):
    """Short lasting events whose peak is neither near a blast's nor in its span, widened a little."""
    s = d.spans(spark, sf)
    chips = s.where(f"category = 'view' AND end_us - t_us <= {12 * HOUR}").select("clip", "event_id", F.col("t_us").alias("c_s")).withColumn("c_e", F.col("c_s"))
    b = s.where("category = 'error'").select("clip", F.least(F.col("t_us") - 2 * HOUR, F.col("t_us") - HOUR).alias("b_s"), F.greatest(F.col("t_us") + 2 * HOUR, F.col("end_us") + HOUR).alias("b_e"))
    p = chips.withColumn("c_s", F.col("c_s") - 1).withColumn("c_e", F.col("c_e") + 1)  # closed ends of whole numbers
    hit = joins.overlap_join(p, b, K, "c_s", "c_e", "b_s", "b_e", 6 * HOUR).select("event_id")
    return chips.join(hit, "event_id", "left_anti").select("event_id")


@query(f"""WITH {G_SQL}, pk AS (SELECT clip, frame_idx, value, quantile_cont(value, 0.5) OVER (PARTITION BY clip ORDER BY frame_idx ROWS BETWEEN 13 PRECEDING AND 2 PRECEDING) AS bed, max(value) OVER (PARTITION BY clip) AS top, lag(value) OVER w AS l, lead(value) OVER w AS r FROM g WINDOW w AS (PARTITION BY clip ORDER BY frame_idx)),
x AS (SELECT clip, frame_idx, value / top AS level, value / nullif(bed, 0) AS sharp FROM pk WHERE value >= coalesce(l, -1) AND value >= coalesce(r, -1) AND value >= 0.3::DOUBLE * top)
SELECT clip, frame_idx, CASE WHEN sharp >= 2.2 AND level >= 0.6 THEN 'event' WHEN sharp >= 1.5 THEN 'candidate' ELSE 'demoted' END AS role, round(level, 6) AS level FROM x""")
def promotion_roles(spark, sf):
    """Peaks as events, as candidates that something else must back, or demoted: loud but without an attack."""
    w = Window.partitionBy("clip").orderBy("frame_idx")
    v, low = F.col("value"), F.lit(-1.0)
    g = d.grid(spark, sf).withColumn("bed", F.percentile("value", 0.5).over(w.rowsBetween(-13, -2))).withColumn("top", F.max("value").over(Window.partitionBy("clip"))).withColumn("l", F.lag("value").over(w)).withColumn("r", F.lead("value").over(w))
    x = g.where((v >= F.coalesce("l", low)) & (v >= F.coalesce("r", low)) & (v >= F.lit(0.3) * F.col("top"))).select("clip", "frame_idx", F.try_divide(v, F.col("top")).alias("level"), F.try_divide(v, F.col("bed")).alias("sharp"))
    role = F.when((F.col("sharp") >= 2.2) & (F.col("level") >= 0.6), "event").when(F.col("sharp") >= 1.5, "candidate").otherwise("demoted")
    return x.select("clip", "frame_idx", role.alias("role"), F.round("level", 6).alias("level"))
