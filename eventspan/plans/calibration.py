"""Queries that hold detections against marks, scan a timeline, pick onsets and promote peaks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import folds, frames, islands, joins, loud, promote
from . import derived as d
from .derived import G_SQL, P_SQL, smooth_sql
from .gating import SMOOTH_SQL, event_frames, event_frames_sql, islands_sql, smooth
from .picture import FLASH_SQL, flash_rows
from .registry import K, query

MARK_SQL = "mk AS (SELECT event_id, clip, at_idx FROM ef)"


def marks(spark, sf):
    return event_frames(spark, sf, 20000).select("event_id", "clip", "at_idx")


@query(f"""WITH {FLASH_SQL}, {event_frames_sql(20000)}, {MARK_SQL},
pr AS (SELECT mk.event_id, min((abs(flash.at_idx - mk.at_idx), flash.at_idx)) AS b FROM mk JOIN flash ON flash.clip = mk.clip AND abs(flash.at_idx - mk.at_idx) <= 2 GROUP BY mk.event_id),
lv AS (SELECT flash.clip, quantile_cont(g.value, 0.5) AS ref FROM flash JOIN g ON g.clip = flash.clip AND g.frame_idx = flash.at_idx GROUP BY flash.clip),
r AS (SELECT mk.clip, CASE WHEN b IS NULL THEN 'miss' ELSE 'hit' END AS verdict, mk.at_idx, b[1] AS error FROM mk LEFT JOIN pr USING (event_id)
  UNION ALL SELECT flash.clip, 'false', flash.at_idx, NULL FROM flash WHERE NOT EXISTS (SELECT 1 FROM pr JOIN mk USING (event_id) WHERE mk.clip = flash.clip AND b[2] = flash.at_idx))
SELECT r.clip, verdict, r.at_idx, error, count(*) AS n, round(max(g.value / lv.ref), 4) AS level FROM r JOIN g ON g.clip = r.clip AND g.frame_idx = r.at_idx JOIN lv ON lv.clip = r.clip GROUP BY ALL""")
def shot_calibration(spark, sf):
    """Marks against flashes: each mark takes the nearest one, which several may share. Rows for hits, misses and flashes no mark
    took, with their level against the median flash of the clip."""
    g, fl, mk = d.grid(spark, sf), flash_rows(spark, sf), marks(spark, sf)
    m = joins.nearest(mk, fl.withColumnRenamed("at_idx", "f_idx"), K, "event_id", "at_idx", "f_idx", 2, ["f_idx"])
    rows = m.select("clip", F.when(F.col("dist").isNull(), "miss").otherwise("hit").alias("verdict"), "at_idx", F.col("dist").alias("error"))
    taken = m.select("clip", F.col("near_f_idx").alias("at_idx")).where("at_idx IS NOT NULL")
    rows = rows.unionByName(fl.join(taken, ["clip", "at_idx"], "left_anti").select("clip", F.lit("false").alias("verdict"), "at_idx", F.lit(None).cast("long").alias("error")))
    at = g.withColumnRenamed("frame_idx", "at_idx")
    ref = fl.join(at, ["clip", "at_idx"]).groupBy("clip").agg(F.percentile("value", 0.5).alias("ref"))
    return rows.join(at, ["clip", "at_idx"]).join(ref, "clip").groupBy("clip", "verdict", "at_idx", "error").agg(F.count(F.lit(1)).alias("n"), F.round(F.max(F.col("value") / F.col("ref")), 4).alias("level"))


RISE_SQL = """
rs AS (SELECT *, max(value) OVER (PARTITION BY clip ORDER BY frame_idx ROWS BETWEEN 1 PRECEDING AND 3 FOLLOWING) AS burst, quantile_cont(value, 0.6) OVER (PARTITION BY clip ORDER BY frame_idx ROWS BETWEEN 8 PRECEDING AND 2 PRECEDING) AS pre,
  quantile_cont(value, 0.25) OVER (PARTITION BY clip ORDER BY frame_idx ROWS BETWEEN 1 PRECEDING AND 3 FOLLOWING) AS quiet FROM g),
rise AS (SELECT *, CASE WHEN burst >= 1e-8 THEN burst / greatest(coalesce(pre, quiet), burst * 1e-3::DOUBLE) END AS rise FROM rs)"""


def rises(g):
    """Burst over what lies before it (at the start: over its own quiet part); null for silence."""
    w = Window.partitionBy("clip").orderBy("frame_idx")
    now, before = w.rowsBetween(-1, 3), w.rowsBetween(-8, -2)
    r = g.withColumn("burst", F.max("value").over(now)).withColumn("bed", F.coalesce(F.percentile("value", 0.6).over(before), F.percentile("value", 0.25).over(now)))
    return r.withColumn("rise", F.when(F.col("burst") >= 1e-8, F.try_divide("burst", F.greatest("bed", F.col("burst") * 1e-3)))).drop("burst", "bed")


@query(f"""WITH {SMOOTH_SQL}, fl AS (SELECT *, 50.0::DOUBLE AS floor FROM m), {islands_sql('fl', 3, 1, 2)}, {event_frames_sql(20000)}, {MARK_SQL}, {RISE_SQL},
pr AS (SELECT mk.event_id, min((CASE WHEN mk.at_idx BETWEEN lo_idx - 1 AND hi_idx + 1 THEN 0 ELSE abs(peak_idx - mk.at_idx) END, lo_idx)) AS b FROM mk JOIN isl ON isl.clip = mk.clip AND (mk.at_idx BETWEEN lo_idx - 1 AND hi_idx + 1 OR abs(peak_idx - mk.at_idx) <= 4) GROUP BY mk.event_id),
r AS (SELECT event_id, mk.clip, at_idx, CASE WHEN b IS NULL THEN 'miss' ELSE 'hit' END AS verdict, b[1] AS error FROM mk LEFT JOIN pr USING (event_id)
  UNION ALL SELECT NULL, isl.clip, peak_idx, 'false', NULL FROM isl WHERE NOT EXISTS (SELECT 1 FROM pr JOIN mk USING (event_id) WHERE mk.clip = isl.clip AND b[2] = isl.lo_idx))
SELECT event_id, r.clip, at_idx, verdict, error, round(rise.rise, 4) AS rise FROM r JOIN rise ON rise.clip = r.clip AND rise.frame_idx = r.at_idx""")
def rumble_calibration(spark, sf):
    """Marks against loud stretches: inside one, widened by a frame, the error is 0; else it is the distance to its peak. The
    smallest error wins, the earlier stretch of equals."""
    g, mk = d.grid(spark, sf), marks(spark, sf)
    isl = loud.loud_islands(smooth(spark, sf).withColumn("floor", F.lit(50.0)), K, "frame_idx", "value", "smooth", "floor", 3, 1, reach=2)
    reach = F.sequence(F.least(F.col("lo_idx") - 1, F.col("peak_idx") - 4), F.greatest(F.col("hi_idx") + 1, F.col("peak_idx") + 4))
    near = isl.withColumn("at_idx", F.explode(reach)).join(mk, ["clip", "at_idx"])
    inside = F.col("at_idx").between(F.col("lo_idx") - 1, F.col("hi_idx") + 1)
    far = F.abs(F.col("peak_idx") - F.col("at_idx"))
    best = near.where(inside | (far <= 4)).groupBy("event_id").agg(F.min(F.struct(F.when(inside, 0).otherwise(far).alias("e"), F.col("lo_idx").alias("l"))).alias("b"))
    m = mk.join(best, "event_id", "left")
    rows = m.select("event_id", "clip", "at_idx", F.when(F.col("b").isNull(), "miss").otherwise("hit").alias("verdict"), F.col("b.e").alias("error"))
    free = isl.join(m.where("b IS NOT NULL").select("clip", F.col("b.l").alias("lo_idx")), ["clip", "lo_idx"], "left_anti")
    none = F.lit(None).cast("long")
    rows = rows.unionByName(free.select(none.alias("event_id"), "clip", F.col("peak_idx").alias("at_idx"), F.lit("false").alias("verdict"), none.alias("error")))
    return rows.join(rises(g).withColumnRenamed("frame_idx", "at_idx"), ["clip", "at_idx"]).select("event_id", "clip", "at_idx", "verdict", "error", F.round("rise", 4).alias("rise"))


@query(f"""WITH {G_SQL}, {event_frames_sql(20000)}, {MARK_SQL}, {RISE_SQL}, md AS (SELECT DISTINCT clip, at_idx FROM mk),
n AS (SELECT rise.*, max(md.at_idx) OVER (PARTITION BY rise.clip ORDER BY frame_idx ROWS UNBOUNDED PRECEDING) AS before, min(md.at_idx) OVER (PARTITION BY rise.clip ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after FROM rise LEFT JOIN md ON md.clip = rise.clip AND md.at_idx = frame_idx)
SELECT clip, frame_idx, round(value, 4) AS value, round(rise, 4) AS rise, least(frame_idx - before, after - frame_idx) AS to_mark, value >= 50 AS loud FROM n""")
def timeline_scan(spark, sf):
    """Every frame with its value, rise, distance to the nearest mark and whether it is loud."""
    w = Window.partitionBy("clip").orderBy("frame_idx")
    mk = marks(spark, sf).select("clip", F.col("at_idx").alias("frame_idx")).distinct().withColumn("m", F.col("frame_idx"))
    n = rises(d.grid(spark, sf)).join(mk, ["clip", "frame_idx"], "left")
    back, ahead = F.max("m").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.min("m").over(w.rowsBetween(0, Window.unboundedFollowing))
    n = n.withColumn("a", F.col("frame_idx") - back).withColumn("b", ahead - F.col("frame_idx"))
    return n.select("clip", "frame_idx", F.round("value", 4).alias("value"), F.round("rise", 4).alias("rise"), F.least("a", "b").alias("to_mark"), (F.col("value") >= 50).alias("loud"))


@query(f"""WITH {G_SQL}, {event_frames_sql(20000)}, l AS (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS b FROM g WINDOW w AS (PARTITION BY clip ORDER BY frame_idx)), k AS (SELECT * FROM l WHERE value >= a AND value >= b),
n AS (SELECT event_id, frame_idx, value, max(g.value) OVER (PARTITION BY event_id) AS top FROM ef JOIN g ON g.clip = ef.clip AND frame_idx BETWEEN at_idx - 4 AND at_idx + 2),
oc AS (SELECT n.*, max(value) OVER (PARTITION BY event_id) AS best FROM n JOIN ef USING (event_id) SEMI JOIN k ON k.clip = ef.clip AND k.frame_idx = n.frame_idx WHERE value >= 0.45::DOUBLE * top)
SELECT event_id, min(frame_idx) AS onset_idx, round(max(best), 6) AS best FROM oc WHERE value >= 0.7::DOUBLE * best GROUP BY event_id""")
def onset_pick(spark, sf):
    """The earliest local maximum around an event with 0.7 of the best one's level; those under 0.45 of the largest value near
    do not count."""
    w = Window.partitionBy("clip").orderBy("frame_idx")
    g = d.grid(spark, sf).withColumn("peak", F.coalesce((F.col("value") >= F.lag("value").over(w)) & (F.col("value") >= F.lead("value").over(w)), F.lit(False)))
    ev = event_frames(spark, sf, 20000).withColumn("frame_idx", F.explode(F.sequence(F.col("at_idx") - 4, F.col("at_idx") + 2)))
    each = Window.partitionBy("event_id")
    n = ev.join(g, ["clip", "frame_idx"]).withColumn("top", F.max("value").over(each)).where(F.col("peak") & (F.col("value") >= F.lit(0.45) * F.col("top")))
    return n.withColumn("best", F.max("value").over(each)).where(F.col("value") >= F.lit(0.7) * F.col("best")).groupBy("event_id").agg(F.min("frame_idx").alias("onset_idx"), F.round(F.max("best"), 6).alias("best"))


@query(f"WITH {G_SQL}, {event_frames_sql(20000)}, n AS (SELECT event_id, frame_idx - at_idx AS o, value, max(value) FILTER (frame_idx = at_idx) OVER (PARTITION BY event_id) AS top FROM ef JOIN g ON g.clip = ef.clip AND frame_idx BETWEEN at_idx AND at_idx + 10) SELECT event_id, coalesce(min(o) FILTER (value < 0.5::DOUBLE * top), max(o)) AS tail FROM n GROUP BY event_id")
def decay_tail(spark, sf):
    """Frames until the level falls under half of the event's own, ten at most."""
    ev = event_frames(spark, sf, 20000).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(10).cast("long")))).withColumn("frame_idx", F.col("at_idx") + F.col("o"))
    n = ev.join(d.grid(spark, sf), ["clip", "frame_idx"]).withColumn("top", F.max(F.when(F.col("o") == 0, F.col("value"))).over(Window.partitionBy("event_id")))
    return n.groupBy("event_id").agg(F.coalesce(F.min(F.when(F.col("value") < F.lit(0.5) * F.col("top"), F.col("o"))), F.max("o")).alias("tail"))


PEAK_SQL = f"""{G_SQL}, {event_frames_sql(15000)},
wk AS (SELECT *, quantile_cont(value, 0.5) OVER b AS bed, count(*) OVER b AS nb, lag(value) OVER w AS l, lead(value) OVER w AS r, max(value) OVER (PARTITION BY clip) AS top FROM g WINDOW w AS (PARTITION BY clip ORDER BY frame_idx), b AS (PARTITION BY clip ORDER BY frame_idx ROWS BETWEEN 13 PRECEDING AND 2 PRECEDING)),
pk AS (SELECT clip, frame_idx, value, CASE WHEN nb < 4 THEN 0.0 WHEN bed <= 0 THEN 999.0 ELSE least(value / bed, 999.0::DOUBLE) END AS sharp FROM wk WHERE value >= 0.06::DOUBLE * top AND value >= coalesce(l, -1) AND value >= coalesce(r, -1)),
sd AS (SELECT DISTINCT clip, at_idx AS m_at FROM ef WHERE event_id % 2 = 0), sc AS (SELECT DISTINCT clip, at_idx AS m_at FROM ef WHERE event_id % 2 = 1),
an AS (SELECT pk.clip, frame_idx AS m_at FROM pk JOIN (SELECT clip, max(value) AS top FROM g GROUP BY clip) USING (clip) WHERE value >= 0.7::DOUBLE * top AND sharp >= 3),
rf AS (SELECT sd.clip, quantile_cont(value, 0.5) AS ref FROM sd JOIN g ON g.clip = sd.clip AND frame_idx = m_at GROUP BY sd.clip),
ft AS (SELECT pk.*, ref, EXISTS (SELECT 1 FROM sc WHERE sc.clip = pk.clip AND abs(m_at - frame_idx) <= 1) AS scored, EXISTS (SELECT 1 FROM an WHERE an.clip = pk.clip AND m_at != frame_idx AND abs(m_at - frame_idx) <= 6) AS volley, EXISTS (SELECT 1 FROM sd WHERE sd.clip = pk.clip AND abs(m_at - frame_idx) <= 6) AS seeded FROM pk JOIN rf ON rf.clip = pk.clip),
rl AS (SELECT *, CASE WHEN sharp >= 3 AND value >= 0.6::DOUBLE * ref AND (scored OR volley) THEN 'impact' WHEN sharp >= 3 AND value >= 0.6::DOUBLE * ref AND sharp >= 5 THEN 'isolated' WHEN volley AND value >= 0.35::DOUBLE * ref THEN CASE WHEN sharp >= 2 THEN 'volley' END
  WHEN scored THEN CASE WHEN value >= 0.4::DOUBLE * ref AND sharp >= 1.5 THEN 'scored' END WHEN seeded AND value >= 0.5::DOUBLE * ref AND sharp >= 2.5 THEN 'flux' END AS rule FROM ft),
fr AS (SELECT * FROM rl WHERE rule IS NOT NULL AND NOT EXISTS (SELECT 1 FROM sd WHERE sd.clip = rl.clip AND abs(m_at - frame_idx) <= 2)),
ac AS (SELECT clip, unnest(list_reduce(list([frame_idx] ORDER BY frame_idx), lambda acc, x: CASE WHEN x[1] - acc[-1] <= 2 THEN acc ELSE list_concat(acc, x) END)) AS frame_idx FROM fr GROUP BY clip)"""


@query(f"WITH {PEAK_SQL} SELECT clip, frame_idx, rule, round(sharp, 4) AS sharpness FROM fr JOIN ac USING (clip, frame_idx)")
def promote_transients(spark, sf):
    """Peaks that become events. Known events give the level of a shot; loud sharp peaks make volleys."""
    w = Window.partitionBy("clip").orderBy("frame_idx")
    v, bed = F.col("value"), w.rowsBetween(-13, -2)
    g = d.grid(spark, sf)
    m = g.withColumn("bed", F.percentile("value", 0.5).over(bed)).withColumn("nb", F.count(F.lit(1)).over(bed)).withColumn("l", F.lag("value").over(w)).withColumn("r", F.lead("value").over(w)).withColumn("top", F.max("value").over(Window.partitionBy("clip")))
    sharp = F.when(F.col("nb") < 4, 0.0).when(F.col("bed") <= 0, 999.0).otherwise(F.least(F.try_divide("value", "bed"), F.lit(999.0)))
    peaks = m.where((v >= F.lit(0.06) * F.col("top")) & (v >= F.coalesce("l", F.lit(-1.0))) & (v >= F.coalesce("r", F.lit(-1.0)))).select("clip", "frame_idx", "value", "top", sharp.alias("sharp"))
    ev = event_frames(spark, sf, 15000)
    known, scored = (ev.where(f"event_id % 2 = {i}").select("clip", F.col("at_idx").alias("m_at")).distinct() for i in (0, 1))
    anchors = peaks.where((v >= F.lit(0.7) * F.col("top")) & (F.col("sharp") >= 3)).select("clip", F.col("frame_idx").alias("m_at"))
    ref = known.join(g.withColumnRenamed("frame_idx", "m_at"), ["clip", "m_at"]).groupBy("clip").agg(F.percentile("value", 0.5).alias("ref"))
    p, id_ = peaks.join(ref, "clip"), ["clip", "frame_idx"]
    p = promote.near_flag(p, scored, K, "frame_idx", id_, 1, "scored")
    p = promote.near_flag(p, anchors, K, "frame_idx", id_, 6, "volley", True)
    p = promote.near_flag(p, known, K, "frame_idx", id_, 6, "seeded")
    p = p.withColumn("rule", promote.backed(v, F.col("sharp"), F.col("ref"), F.col("scored"), F.col("volley"), F.col("seeded")))
    return promote.promote(p, known, K, "frame_idx", 2).select("clip", "frame_idx", "rule", F.round("sharp", 4).alias("sharpness"))


@query(f"""WITH {P_SQL}, {smooth_sql('p', 'score', 2, 'quantile_cont(v, 0.5)')},
hl AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY clip ORDER BY frame_idx) AS run FROM m WHERE sv >= 0.4::DOUBLE),
hs AS (SELECT clip, run, min(frame_idx) AS a, max(frame_idx) AS b, max(sv) AS top FROM hl GROUP BY clip, run HAVING max(sv) >= 0.55::DOUBLE AND max(frame_idx) - min(frame_idx) >= 4),
nb AS (SELECT *, lag(sv) OVER w AS l, lead(sv) OVER w AS r FROM m WINDOW w AS (PARTITION BY clip ORDER BY frame_idx)),
pk AS (SELECT hs.clip, a, b, frame_idx, sv FROM hs JOIN nb ON nb.clip = hs.clip AND frame_idx BETWEEN a AND b WHERE sv > l AND sv >= r AND sv >= 0.6::DOUBLE * top),
ks AS (SELECT clip, a, b, list_reduce(list([frame_idx] ORDER BY sv DESC, frame_idx), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: abs(y - x[1]) < 3)) > 0 THEN acc ELSE list_concat(acc, x) END) AS kept FROM pk GROUP BY ALL)
SELECT clip, a AS first_idx, b AS last_idx, unnest(kept) AS peak_idx FROM ks WHERE len(kept) > 1""")
def peak_split(spark, sf):
    """Long segments of a curve with more than one peak: strict rises of 0.6 of the segment's top, spaced."""
    w = Window.partitionBy("clip").orderBy("frame_idx")
    m = frames.median_smooth(d.scores(spark, sf), K, "frame_idx", "score", 5)
    seg = islands.hysteresis(m, K, "frame_idx", "smooth", 0.55, 0.4).where("last_idx - first_idx >= 4")
    v = F.col("smooth")
    rising = m.withColumn("l", F.lag("smooth").over(w)).withColumn("r", F.lead("smooth").over(w)).where((v > F.col("l")) & (v >= F.col("r"))).select("clip", "frame_idx", "smooth")
    at = seg.select("clip", "first_idx", "last_idx", "peak", F.explode(F.sequence("first_idx", "last_idx")).alias("frame_idx"))
    peaks = at.join(rising, ["clip", "frame_idx"]).where(v >= F.lit(0.6) * F.col("peak"))
    kept = folds.greedy_spacing(peaks, ["clip", "first_idx"], "frame_idx", "smooth", 3)
    n = F.count(F.lit(1)).over(Window.partitionBy("clip", "first_idx"))
    return kept.withColumn("n", n).where("n > 1").select("clip", "first_idx", "last_idx", F.col("frame_idx").alias("peak_idx"))


@query(f"""WITH {G_SQL}, {event_frames_sql(5000)}, pr AS (SELECT event_id, clip, at_idx, cents / 60000.0::DOUBLE AS conf FROM ef WHERE event_id % 5 = 0),
au AS (SELECT pr.event_id, max(ef.cents) / 60000.0::DOUBLE AS s FROM pr JOIN ef ON ef.clip = pr.clip AND ef.event_id % 5 IN (1, 2) AND abs(ef.at_idx - pr.at_idx) <= 1 GROUP BY ALL),
vi AS (SELECT pr.event_id, max(ef.cents) / 60000.0::DOUBLE AS s FROM pr JOIN ef ON ef.clip = pr.clip AND ef.event_id % 5 IN (3, 4) AND abs(ef.at_idx - pr.at_idx) <= 1 GROUP BY ALL),
sc AS (SELECT pr.*, greatest(conf, 0.65::DOUBLE * coalesce(au.s, 0.0::DOUBLE) + 0.35::DOUBLE * coalesce(vi.s, 0.0::DOUBLE)) AS score FROM pr LEFT JOIN au USING (event_id) LEFT JOIN vi USING (event_id)),
fd AS (SELECT clip, list_reduce(list([[at_idx::DOUBLE, score]] ORDER BY at_idx, score DESC), lambda acc, x: CASE WHEN x[1][1] - acc[-1][1] <= 1 THEN CASE WHEN x[1][2] > acc[-1][2] THEN list_concat(acc[1:len(acc) - 1], x) ELSE acc END ELSE list_concat(acc, x) END) AS l FROM sc WHERE score >= 0.3::DOUBLE GROUP BY clip),
u AS (SELECT clip, unnest(l) AS w FROM fd) SELECT clip, CAST(w[1] AS BIGINT) AS at_idx, round(w[2], 6) AS score FROM u""")
def late_fusion(spark, sf):
    """Proposals scored by themselves or by the best audio and video scores near them, over a threshold, then deduped by peak."""
    ev = event_frames(spark, sf, 5000)
    props = ev.where("event_id % 5 = 0").select("event_id", "clip", "at_idx", (F.col("cents") / 60000.0).alias("conf"))
    for name, kinds in (("au", (1, 2)), ("vi", (3, 4))):
        near = ev.where((F.col("event_id") % 5).isin(*kinds)).select("clip", F.col("at_idx").alias("s_idx"), F.col("cents").alias("s_cents"))
        best = joins.band_join(props.select("event_id", "clip", "at_idx"), near, K, "at_idx", "s_idx", 1).groupBy("event_id").agg((F.max("s_cents") / 60000.0).alias(name))
        props = props.join(best, "event_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    score = F.greatest("conf", F.lit(0.65) * zero("au") + F.lit(0.35) * zero("vi"))
    kept = folds.dedupe_by_peak(props.select("clip", "at_idx", score.alias("score")).where("score >= 0.3D"), K, "at_idx", "score", 1)
    return kept.select("clip", "at_idx", F.round("score", 6).alias("score"))
