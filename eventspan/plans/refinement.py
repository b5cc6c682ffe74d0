"""Queries that move events onto the signal: level peaks and onsets near a hint, refined spans, bursts, clip bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import derived as d
from .derived import G_SQL
from .gating import event_frames, event_frames_sql
from .registry import query

# Lengths in frames of the grid.
RADIUS, BACK, AHEAD, FAR_BACK, PRE, HALF, TAIL, LONGEST = 3, 4, 2, 24, 1, 3, 8, 12
FLUX_SQL = f"{G_SQL}, {event_frames_sql(20000)}, fx AS (SELECT *, greatest(0.0::DOUBLE, value - coalesce(lag(value) OVER (PARTITION BY clip ORDER BY frame_idx), value)) AS flux FROM g), hi AS (SELECT clip, max(frame_idx) AS hi, count(*) FILTER (value > 0) AS busy FROM g GROUP BY clip)"


def flux(spark, sf) -> DataFrame:
    v = F.col("value")
    return d.grid(spark, sf).withColumn("flux", F.greatest(F.lit(0.0), v - F.coalesce(F.lag("value").over(Window.partitionBy("clip").orderBy("frame_idx")), v)))


def around(events: DataFrame, frames: DataFrame, back, ahead) -> DataFrame:
    """Events with the frames from `back` before to `ahead` after their own; an event meets as many as it asks for."""
    at = F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.col("at_idx") - back), F.col("at_idx") + ahead))
    return events.withColumn("frame_idx", at).join(frames, ["clip", "frame_idx"])


def first_largest(value: str):
    return F.max(F.struct(F.col(value).alias("v"), (-F.col("frame_idx")).alias("i")))


@query(f"WITH {FLUX_SQL} SELECT event_id, -max((value, -frame_idx))[2] AS peak_idx, round(max(value), 6) AS level FROM ef JOIN g ON g.clip = ef.clip AND frame_idx BETWEEN at_idx - {RADIUS} AND at_idx + {RADIUS} GROUP BY event_id")
def rms_peak_near(spark, sf):
    """The first loudest frame within a radius of an event."""
    near = around(event_frames(spark, sf, 20000), d.grid(spark, sf), RADIUS, RADIUS).groupBy("event_id").agg(first_largest("value").alias("m"))
    return near.select("event_id", (-F.col("m.i")).alias("peak_idx"), F.round("m.v", 6).alias("level"))


def onset_sql(early: str) -> str:
    """CTEs up to `onset` (event_id, onset_idx): window of each event, local maxima inside it, and the pick; a flat or empty flux
    leaves the loudest frame. Series with few busy frames look further back."""
    return f"""
wn AS (SELECT ef.*, hi, greatest(0, at_idx - CASE WHEN busy <= 675 THEN {FAR_BACK} ELSE {BACK} END) AS lo, at_idx + {AHEAD} AS up FROM ef JOIN hi USING (clip)),
nf AS (SELECT event_id, frame_idx, flux, value, max(flux) OVER w AS top, lag(flux) OVER o AS l, lead(flux) OVER o AS r FROM wn JOIN fx ON fx.clip = wn.clip AND frame_idx BETWEEN lo AND up WINDOW w AS (PARTITION BY event_id), o AS (PARTITION BY event_id ORDER BY frame_idx)),
cd AS (SELECT *, max(flux) OVER (PARTITION BY event_id) AS best FROM nf WHERE top > 1e-12 AND flux >= 0.45::DOUBLE * top AND flux >= l AND flux >= r),
pk AS (SELECT event_id, min(frame_idx) AS onset_idx FROM cd WHERE flux >= {early}::DOUBLE * best GROUP BY event_id),
fb AS (SELECT event_id, CASE WHEN max(top) > 1e-12 THEN -max((flux, -frame_idx))[2] ELSE -max((value, -frame_idx))[2] END AS onset_idx FROM nf GROUP BY event_id),
onset AS (SELECT event_id, coalesce(pk.onset_idx, fb.onset_idx) AS onset_idx FROM fb LEFT JOIN pk USING (event_id))"""


def onsets_near(events: DataFrame, fx: DataFrame, early: float) -> DataFrame:
    """event_id, onset_idx: the earliest of the window's inner maxima that has `early` of the best one's flux and 0.45 of the
    largest; without any the largest flux, and of a flat window the loudest frame."""
    sizes = fx.groupBy("clip").agg(F.count(F.when(F.col("value") > 0, 1)).alias("busy"))
    near = around(events.join(sizes, "clip"), fx, F.when(F.col("busy") <= 675, FAR_BACK).otherwise(BACK), AHEAD)
    each = Window.partitionBy("event_id")
    order = each.orderBy("frame_idx")
    f = F.col("flux")
    near = near.withColumn("top", F.max("flux").over(each)).withColumn("inner", F.coalesce((f >= F.lag("flux").over(order)) & (f >= F.lead("flux").over(order)), F.lit(False)))
    good = F.col("inner") & (F.col("top") > 1e-12) & (f >= F.lit(0.45) * F.col("top"))
    near = near.withColumn("good", good).withColumn("best", F.max(F.when(F.col("good"), f)).over(each))
    g = near.groupBy("event_id").agg(
        F.min(F.when(F.col("good") & (f >= F.lit(early) * F.col("best")), F.col("frame_idx"))).alias("pick"), F.max("top").alias("top"), first_largest("flux").alias("f"), first_largest("value").alias("v")
    )
    return g.select("event_id", F.coalesce("pick", F.when(F.col("top") > 1e-12, -F.col("f.i")).otherwise(-F.col("v.i"))).alias("onset_idx"))


@query(f"WITH {FLUX_SQL}, {onset_sql('0.92')} SELECT * FROM onset")
def onset_strongest(spark, sf):
    """The strongest rise near an event, the earliest of near-ties."""
    return onsets_near(event_frames(spark, sf, 20000), flux(spark, sf), 0.92)


@query(f"WITH {FLUX_SQL}, {onset_sql('0.55')} SELECT * FROM onset")
def onset_near(spark, sf):
    """The earliest rise near an event that compares with the strongest; sparse series look back further."""
    return onsets_near(event_frames(spark, sf, 20000), flux(spark, sf), 0.55)


REFINE_SQL = f"""{FLUX_SQL}, {onset_sql('0.55')},
rp AS (SELECT event_id, -max((value, -frame_idx))[2] AS peak_idx FROM ef JOIN g ON g.clip = ef.clip AND frame_idx BETWEEN at_idx - {RADIUS} AND at_idx + {RADIUS} GROUP BY event_id),
dt AS (SELECT onset.event_id, onset_idx, min(g.frame_idx - onset_idx) FILTER (g.value < 0.12::DOUBLE * p.value) AS quiet, max(g.frame_idx - onset_idx) AS last FROM onset JOIN ef USING (event_id) JOIN g p ON p.clip = ef.clip AND p.frame_idx = onset_idx JOIN g ON g.clip = ef.clip AND g.frame_idx BETWEEN onset_idx AND onset_idx + {TAIL} GROUP BY ALL),
sp AS (SELECT ef.event_id, ef.clip, at_idx, at_idx + 1 + event_id % 20 AS until, hi, ef.clip IN ('click', 'error') AS sudden FROM ef JOIN hi USING (clip)),
rf AS (SELECT event_id, sudden, CASE WHEN sudden THEN onset_idx ELSE peak_idx END AS peak, CASE WHEN sudden THEN greatest(0, onset_idx - {PRE}) ELSE at_idx END AS a,
  CASE WHEN sudden THEN least(hi, greatest(onset_idx + {HALF}, onset_idx + coalesce(quiet, last))) ELSE least(at_idx + {LONGEST}, least(hi, greatest(until, peak_idx + 1))) END AS b FROM sp JOIN rp USING (event_id) JOIN dt USING (event_id))"""


@query(f"WITH {REFINE_SQL} SELECT event_id, sudden, a AS start_idx, CASE WHEN sudden THEN peak ELSE least(greatest(peak, a), b) END AS peak_idx, b AS end_idx FROM rf")
def refine_timing(spark, sf):
    """Sudden events: onset, a short lead and the decay after it. Lasting events: the loudest frame, their own span, cut at a longest length."""
    g, fx, ev = d.grid(spark, sf), flux(spark, sf), event_frames(spark, sf, 20000)
    on = onsets_near(ev, fx, 0.55)
    loud = around(ev, g, RADIUS, RADIUS).groupBy("event_id").agg(first_largest("value").alias("m")).select("event_id", (-F.col("m.i")).alias("loud_idx"))
    steps = on.join(ev.select("event_id", "clip"), "event_id").withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(TAIL).cast("long")))).withColumn("frame_idx", F.col("onset_idx") + F.col("o"))
    tail = steps.join(g, ["clip", "frame_idx"]).withColumn("p", F.max(F.when(F.col("o") == 0, F.col("value"))).over(Window.partitionBy("event_id")))
    tail = tail.groupBy("event_id").agg(F.coalesce(F.min(F.when(F.col("value") < F.lit(0.12) * F.col("p"), F.col("o"))), F.max("o")).alias("tail"))
    ends = g.groupBy("clip").agg(F.max("frame_idx").alias("hi"))
    at, on_, hi = F.col("at_idx"), F.col("onset_idx"), F.col("hi")
    x = ev.join(ends, "clip").join(on, "event_id").join(loud, "event_id").join(tail, "event_id").withColumn("sudden", F.col("clip").isin("click", "error"))
    until = at + 1 + F.col("event_id") % 20
    a = F.when(F.col("sudden"), F.greatest(F.lit(0), on_ - PRE)).otherwise(at)
    b = F.when(F.col("sudden"), F.least(hi, F.greatest(on_ + HALF, on_ + F.col("tail")))).otherwise(F.least(at + LONGEST, F.least(hi, F.greatest(until, F.col("loud_idx") + 1))))
    peak = F.when(F.col("sudden"), on_).otherwise(F.least(F.greatest(F.col("loud_idx"), a), b))
    return x.select("event_id", "sudden", a.cast("long").alias("start_idx"), peak.cast("long").alias("peak_idx"), b.cast("long").alias("end_idx"))


@query(f"""WITH {FLUX_SQL}, nb AS (SELECT event_id, at_idx, frame_idx, value FROM ef JOIN g ON g.clip = ef.clip AND frame_idx BETWEEN at_idx - 8 AND at_idx + 3),
bs AS (SELECT event_id, max(value) FILTER (frame_idx >= at_idx - 1) AS top, quantile_cont(value, 0.6) FILTER (frame_idx < at_idx - 1) AS pre, quantile_cont(value, 0.25) FILTER (frame_idx >= at_idx - 1) AS low FROM nb GROUP BY event_id),
bb AS (SELECT *, greatest(coalesce(pre, low), top * 1e-3::DOUBLE) AS bed FROM bs), bx AS (SELECT nb.*, top, bed, -max((value, -frame_idx)) OVER (PARTITION BY event_id)[2] AS pi FROM nb JOIN bb USING (event_id) WHERE top >= 1e-8 AND top >= 1.6::DOUBLE * bed AND frame_idx >= at_idx - 1)
SELECT event_id, min(frame_idx) FILTER (value >= bed + 0.35::DOUBLE * (top - bed)) AS onset_idx, coalesce(min(frame_idx) FILTER (frame_idx >= pi AND value <= bed + 0.25::DOUBLE * (top - bed)), max(frame_idx)) AS end_idx FROM bx GROUP BY event_id""")
def energy_burst(spark, sf):
    """Events that rise well above what lies before them, with the frame where they leave it and the one where they are back."""
    near = around(event_frames(spark, sf, 20000), d.grid(spark, sf), 8, 3)
    late, v, i = F.col("frame_idx") >= F.col("at_idx") - 1, F.col("value"), F.col("frame_idx")
    s = near.groupBy("event_id").agg(F.max(F.when(late, v)).alias("top"), F.percentile(F.when(~late, v), 0.6).alias("pre"), F.percentile(F.when(late, v), 0.25).alias("low"), F.collect_list(F.when(late, F.struct(i.alias("i"), v.alias("v")))).alias("burst"))
    s = s.withColumn("bed", F.greatest(F.coalesce("pre", "low"), F.col("top") * 1e-3)).where((F.col("top") >= 1e-8) & (F.col("top") >= F.lit(1.6) * F.col("bed")))
    at = lambda share: F.col("bed") + F.lit(share) * (F.col("top") - F.col("bed"))
    peak = F.array_min(F.transform(F.filter("burst", lambda x: x["v"] == F.col("top")), lambda x: x["i"]))
    first = lambda keep: F.array_min(F.transform(F.filter("burst", keep), lambda x: x["i"]))
    end = F.coalesce(first(lambda x: (x["i"] >= F.col("peak")) & (x["v"] <= at(0.25))), F.array_max(F.transform("burst", lambda x: x["i"])))
    return s.withColumn("peak", peak).select("event_id", first(lambda x: x["v"] >= at(0.35)).alias("onset_idx"), end.alias("end_idx"))
