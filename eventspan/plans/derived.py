"""Signals, events, spans and references derived from the driver's tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import frames
from ..session import table

MINUTE = 60_000_000
HOUR = 60 * MINUTE



def events(spark: SparkSession, d: str) -> DataFrame:
    """clip (user), event_id, category, t_us, cents."""
    return table(spark, d, "events").select(
        F.col("user_id").alias("clip"), "event_id", F.col("event_type").alias("category"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"), F.round(F.col("value") * 100).cast("long").alias("cents")
    )


def spans(spark: SparkSession, d: str) -> DataFrame:
    """events with end_us: as many minutes later as props say."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = table(spark, d, "events")
    return e.select(
        F.col("user_id").alias("clip"), "event_id", F.col("event_type").alias("category"), F.unix_micros(F.col("ts").cast("timestamp")).alias("t_us"),
        F.round(F.col("value") * 100).cast("long").alias("cents"), (F.unix_micros(F.col("ts").cast("timestamp")) + k * MINUTE).alias("end_us"),
    )


def grid(spark: SparkSession, d: str) -> DataFrame:
    """clip (event type), frame_idx (hour), value (mean)."""
    e = events(spark, d).withColumn("slot", F.floor(F.col("t_us") / F.lit(HOUR)).cast("long"))
    return frames.dense_grid(e, "category", "slot", "cents")


def scores(spark: SparkSession, d: str) -> DataFrame:
    return grid(spark, d).withColumn("score", F.col("value") / (F.col("value") + 50.0))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("label").alias("clip"), F.col("vec_id").alias("frame_idx"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"))


E_SQL = """
e AS (SELECT user_id AS clip, event_id, event_type AS category, epoch_us(ts) AS t_us, CAST(round(value * 100) AS BIGINT) AS cents FROM events)"""
S_SQL = """
s AS (SELECT user_id AS clip, event_id, event_type AS category, epoch_us(ts) AS t_us, CAST(round(value * 100) AS BIGINT) AS cents,
             epoch_us(ts) + CAST(json_extract(props, '$.k') AS BIGINT) * 60000000 AS end_us FROM events)"""
G_SQL = E_SQL + """,
c AS (SELECT category AS clip, t_us // 3600000000 AS slot, sum(cents) AS su, count(*) AS n FROM e GROUP BY ALL),
f AS (SELECT clip, unnest(range((SELECT min(slot) FROM c), (SELECT max(slot) FROM c) + 1)) AS slot FROM (SELECT DISTINCT clip FROM c)),
g AS (SELECT f.clip, f.slot - (SELECT min(slot) FROM c) AS frame_idx, CASE WHEN n IS NULL THEN 0.0::DOUBLE ELSE su::DOUBLE / (n * 100.0::DOUBLE) END AS value
      FROM f LEFT JOIN c USING (clip, slot))"""
P_SQL = G_SQL + """,
p AS (SELECT *, value / (value + 50.0::DOUBLE) AS score FROM g)"""
V_SQL = """
v AS (SELECT label AS clip, vec_id AS frame_idx, list_transform(embedding, lambda x: x::DOUBLE) AS vec FROM embeddings)"""


def smooth_sql(source: str, value: str, radius: int, what: str) -> str:
    """what: an aggregate of v over a window whose ends are repeated."""
    return f"""
pad AS (SELECT clip, i, greatest(0, least(hi, i)) AS j FROM (SELECT clip, hi, unnest(range(-{radius}, hi + {radius} + 1)) AS i FROM (SELECT clip, max(frame_idx) AS hi FROM {source} GROUP BY clip))),
sm AS (SELECT clip, i AS frame_idx, {what} OVER (PARTITION BY clip ORDER BY i ROWS BETWEEN {radius} PRECEDING AND {radius} FOLLOWING) AS sv
       FROM (SELECT pad.clip, pad.i, x.{value} AS v FROM pad JOIN {source} x ON x.clip = pad.clip AND x.frame_idx = pad.j)),
m AS (SELECT x.*, sm.sv FROM {source} x JOIN sm USING (clip, frame_idx))"""

# From g to o: the quantiles, the rhythm and the mode of each series.
ADAPTIVE_SQL = """t AS (SELECT *, quantile_cont(value, 0.99) OVER (PARTITION BY clip) AS top FROM g), act AS (SELECT *, value >= 0.05::DOUBLE * top AS on_, count(*) FILTER (value >= 0.05::DOUBLE * top) OVER (PARTITION BY clip) AS n FROM t),
q AS (SELECT clip, quantile_cont(value, 0.1) AS quiet, quantile_cont(value, 0.5) AS mid, quantile_cont(value, 0.9) AS loud FROM act WHERE on_ OR n < 8 GROUP BY clip),
l AS (SELECT g.clip, frame_idx, quiet, mid, loud, quiet + 0.4::DOUBLE * (loud - quiet) AS split, value >= quiet + 0.4::DOUBLE * (loud - quiet) AS is_loud FROM g JOIN q USING (clip)),
b AS (SELECT *, min(frame_idx) FILTER (is_loud) OVER (PARTITION BY clip) AS lo, max(frame_idx) FILTER (is_loud) OVER (PARTITION BY clip) AS hi FROM l),
r AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY clip, is_loud ORDER BY frame_idx) AS run FROM b WHERE frame_idx BETWEEN lo AND hi),
k AS (SELECT clip, is_loud, count(*) AS len FROM r GROUP BY clip, is_loud, run),
m AS (SELECT clip, count(*) FILTER (NOT is_loud AND len >= 2) AS gaps, quantile_cont(len, 0.5) FILTER (NOT is_loud AND len >= 2) AS gap_mid, quantile_cont(len, 0.5) FILTER (is_loud) AS burst_mid FROM k GROUP BY clip),
fl AS (SELECT clip, quiet, mid, loud, quiet + 0.4::DOUBLE * (loud - quiet) AS split, coalesce(loud >= 1.5::DOUBLE * greatest(quiet, 1e-12) AND gaps >= 2 AND gap_mid <= 24 AND burst_mid >= 2, false) AS rhythmic FROM q LEFT JOIN m USING (clip)),
o AS (SELECT *, CASE WHEN loud / greatest(mid, 1e-12) >= 1.45::DOUBLE OR rhythmic THEN 'split' ELSE 'keep' END AS mode FROM fl)"""
