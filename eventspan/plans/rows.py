"""Queries on event rows: labels, tokens, scenes to look at, filters, defaults, annotations, merges of windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import labels
from ..operators import folds, joins
from ..session import table
from . import derived as d
from .derived import E_SQL, HOUR, MINUTE, S_SQL
from .registry import K, query

SAMPLES = ["Gunshot, gunfire", "Machine gun", "Boom", "Engine starting", "Truck", "Rain on roof", "Campfire", "Riding a bike", "Speech", "Tank", "Car crash", "Driving car"]
TOKEN_SQL = f"""
t AS (SELECT event_id, {SAMPLES!r}[event_id % {len(SAMPLES)} + 1] AS label, CASE WHEN event_id % 2 = 0 THEN 'audio' ELSE 'video' END AS modality, least(value / 200.0::DOUBLE, 1.0::DOUBLE) AS score FROM events),
k AS (SELECT *, CASE WHEN CASE modality WHEN 'audio' THEN regexp_matches(lower(label), '{"|".join(labels.SUDDEN_AUDIO)}') ELSE regexp_matches(lower(label), '{"|".join(labels.SUDDEN_VIDEO)}') END THEN 'sudden'
  WHEN CASE modality WHEN 'audio' THEN regexp_matches(lower(label), '{"|".join(labels.LASTING_AUDIO)}') ELSE regexp_matches(lower(label), '{"|".join(labels.LASTING_VIDEO)}') END THEN 'lasting' END AS kind FROM t)"""


def tokens(spark, sf):
    e = table(spark, sf, "events")
    label = F.element_at(F.array(*[F.lit(x) for x in SAMPLES]), (F.col("event_id") % len(SAMPLES) + 1).cast("int"))
    t = e.select("event_id", label.alias("label"), F.when(F.col("event_id") % 2 == 0, "audio").otherwise("video").alias("modality"), F.least(F.col("value") / 200.0, F.lit(1.0)).alias("score"))
    return t.withColumn("kind", labels.keyword_class(F.col("label"), F.col("modality")))


@query(f"WITH {TOKEN_SQL} SELECT label, modality, kind, count(*) AS n FROM k GROUP BY ALL")
def keyword_class(spark, sf):
    return tokens(spark, sf).groupBy("label", "modality", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {TOKEN_SQL} SELECT event_id, label, kind, round(score, 6) AS score FROM k WHERE score >= CASE kind WHEN 'sudden' THEN 0.85::DOUBLE WHEN 'lasting' THEN 0.25::DOUBLE END")
def token_filter(spark, sf):
    """Sudden labels need 0.85, lasting ones 0.25, others go."""
    least = F.when(F.col("kind") == "sudden", 0.85).when(F.col("kind") == "lasting", 0.25)
    return tokens(spark, sf).where(F.col("score") >= least).select("event_id", "label", "kind", F.round("score", 6).alias("score"))


@query(f"WITH {TOKEN_SQL}, r AS (SELECT event_id // 8 AS shot, 'LABEL_' || label AS label, score, row_number() OVER (PARTITION BY event_id // 8 ORDER BY score DESC, event_id) AS rank FROM k) SELECT shot, rank, regexp_replace(label, '^LABEL_', '') AS label, round(score, 6) AS score FROM r WHERE rank <= 3")
def top_predictions(spark, sf):
    t = tokens(spark, sf).withColumn("shot", F.floor(F.col("event_id") / 8)).withColumn("label", F.concat(F.lit("LABEL_"), "label"))
    t = t.withColumn("rank", F.row_number().over(Window.partitionBy("shot").orderBy(F.desc("score"), "event_id"))).where("rank <= 3")
    return t.select("shot", "rank", labels.prediction_label(F.col("label")).alias("label"), F.round("score", 6).alias("score"))


@query("""WITH s AS (SELECT doc_id, (doc_id % 97) / 8.0::DOUBLE AS a, (doc_id % 97) / 8.0::DOUBLE + (n_chars % 103) / 8.0::DOUBLE AS b FROM documents), w AS (SELECT *, greatest(b - a, 1.0::DOUBLE) AS len, greatest(0.0::DOUBLE, a - (1.0::DOUBLE - (b - a)) / 2) AS grown FROM s)
SELECT doc_id, round(least(CASE WHEN len <= 4 THEN 8.0::DOUBLE WHEN len <= 8 THEN 4.0::DOUBLE ELSE 2.0::DOUBLE END, 16.0::DOUBLE / len), 2) AS fps,
CASE WHEN b - a >= 1 THEN a WHEN grown + 1 > 12 THEN 11.0::DOUBLE ELSE grown END AS look_start, CASE WHEN b - a >= 1 THEN b WHEN grown + 1 > 12 THEN 12.0::DOUBLE ELSE grown + 1 END AS look_end FROM w""")
def sampling_plan(spark, sf):
    a = (F.col("doc_id") % 97) / 8.0
    s = table(spark, sf, "documents").select("doc_id", a.alias("a"), (a + (F.col("n_chars") % 103) / 8.0).alias("b"))
    s = s.withColumn("w", labels.look_window(F.col("a"), F.col("b"), F.lit(12.0), 1.0))
    return s.select("doc_id", labels.sample_fps(F.col("a"), F.col("b"), 16, 1.0).alias("fps"), F.col("w.start").alias("look_start"), F.col("w.end").alias("look_end"))


@query(f"WITH {E_SQL}, x(category, gate) AS (VALUES ('click', true), ('error', true), ('view', false)) SELECT e.event_id, e.category, true AS impulsive FROM e JOIN x USING (category) WHERE gate")
def gate_filter(spark, sf):
    """Events of the categories the table of categories flags; unknown ones do not pass."""
    flags = spark.createDataFrame([("click", True), ("error", True), ("view", False)], "category string, gate boolean").where("gate")
    return d.events(spark, sf).join(F.broadcast(flags), "category", "left_semi").select("event_id", "category", F.lit(True).alias("impulsive"))


@query(f"WITH {S_SQL}, m AS (SELECT event_id, t_us, CASE WHEN event_id % 2 = 0 THEN greatest(0, t_us - 80000) ELSE t_us END AS a, CASE WHEN event_id % 3 = 0 THEN t_us + 450000 ELSE greatest(end_us, t_us + 1) END AS b FROM s) SELECT event_id, a AS start_us, least(greatest(t_us, a), b) AS peak_us, b AS end_us FROM m")
def manual_defaults(spark, sf):
    """A missing start lies 0.08 s before the peak, a missing end 0.45 s after it; the peak stays inside."""
    s = d.spans(spark, sf).withColumn("a", F.when(F.col("event_id") % 2 != 0, F.col("t_us"))).withColumn("b", F.when(F.col("event_id") % 3 != 0, F.greatest("end_us", F.col("t_us") + 1)))
    a, b = F.coalesce("a", F.greatest(F.lit(0), F.col("t_us") - 80_000)), F.coalesce("b", F.col("t_us") + 450_000)
    return s.select("event_id", a.alias("start_us"), F.least(F.greatest(F.col("t_us"), a), b).alias("peak_us"), b.alias("end_us"))


@query(f"""WITH {S_SQL}, a AS (SELECT * FROM s WHERE category = 'purchase'), b AS (SELECT * FROM s WHERE category != 'purchase'),
p AS (SELECT a.event_id, b.category, min((b.t_us, b.event_id)) AS f FROM a JOIN b ON a.clip = b.clip AND a.t_us < b.end_us AND b.t_us < a.end_us GROUP BY ALL)
SELECT event_id, list(category ORDER BY f) AS seen FROM p GROUP BY event_id""")
def overlap_annotate(spark, sf):
    """Categories of overlapping spans, once each, by their first one. A pair is reduced to its category before it is listed."""
    s = d.spans(spark, sf)
    b = s.where("category != 'purchase'").select("clip", F.col("category").alias("b_cat"), F.col("event_id").alias("b_id"), F.col("t_us").alias("b_s"), F.col("end_us").alias("b_e"))
    p = joins.overlap_join(s.where("category = 'purchase'"), b, K, "t_us", "end_us", "b_s", "b_e", HOUR)
    p = p.groupBy("event_id", "b_cat").agg(F.min(F.struct("b_s", "b_id")).alias("f")).groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("f", "b_cat"))).alias("l"))
    return p.select("event_id", F.col("l.b_cat").alias("seen"))


@query(f"WITH {E_SQL} SELECT event_id FROM e a WHERE category = 'click' AND NOT EXISTS (SELECT 1 FROM e b WHERE b.clip = a.clip AND b.category = 'error' AND abs(b.t_us - a.t_us) <= {6 * HOUR})")
def anti_proximity(spark, sf):
    e = d.events(spark, sf)
    errors = e.where("category = 'error'").select("clip", F.col("t_us").alias("b_t"))
    return joins.band_join(e.where("category = 'click'"), errors, K, "t_us", "b_t", 6 * HOUR, "left_anti").select("event_id")


@query(f"""WITH {S_SQL},
r AS (SELECT clip, list_reduce(list([[t_us, end_us, t_us, cents]] ORDER BY t_us, cents DESC), lambda acc, x: CASE WHEN x[1][1] <= acc[-1][2] + {30 * MINUTE} AND x[1][3] - acc[-1][3] < {2 * HOUR}
  THEN list_concat(acc[1:len(acc) - 1], [[acc[-1][1], greatest(acc[-1][2], x[1][2]), CASE WHEN x[1][4] > acc[-1][4] THEN x[1][3] ELSE acc[-1][3] END, greatest(acc[-1][4], x[1][4])]]) ELSE list_concat(acc, x) END) AS l FROM s GROUP BY clip),
u AS (SELECT clip, unnest(l) AS w FROM r) SELECT clip, w[1] AS t_us, w[2] AS end_us, w[3] AS centre, w[4] AS cents FROM u""")
def merge_windows(spark, sf):
    s = d.spans(spark, sf).select("clip", "t_us", "end_us", F.col("t_us").alias("centre"), "cents")
    return folds.merge_windows(s, K, "t_us", "end_us", "centre", "cents", 30 * MINUTE, 2 * HOUR)
