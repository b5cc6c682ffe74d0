"""Queries that read and write the engine's own results: event documents, rule maps, digests, clips cut out of the signal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import render
from ..sources import event_json
from . import derived as d
from .derived import E_SQL, G_SQL, HOUR, S_SQL
from .gating import event_frames, event_frames_sql
from .registry import query

BASE = 1_700_000_000_000_000
# Events of a clip as a JSON document, in one of three shapes by the clip's number; some keys are missing on purpose.
DOC_SQL = f"""{S_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY t_us, event_id) AS rn, count(*) OVER (PARTITION BY clip) AS n FROM s)"""


def documents(spark, sf) -> DataFrame:
    """clip, json: a list, an object with events, or (clips by turns of three) an object for each event."""
    s = d.spans(spark, sf)
    sec = lambda c: (F.floor((F.col(c) - BASE) / F.lit(1000)) / 1000.0)
    gone = lambda k, c: F.when(F.col("event_id") % 4 != k, c)
    e = F.struct(
        F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("own"), F.col("event_id").cast("string"))).alias("event_id"), F.col("category"), gone(1, sec("t_us")).alias("start_sec"), F.when((F.col("clip") % 3 == 2) | (F.col("event_id") % 4 != 2), sec("t_us")).alias("peak_sec"),
        gone(3, sec("end_us")).alias("end_sec"), (F.col("cents") / 100.0).alias("confidence"), F.when(F.col("event_id") % 2 == 0, F.array(F.lit("audio"))).alias("sources"),
    )
    one = s.where("clip % 3 = 2").select("clip", F.to_json(e).alias("json"), F.col("event_id").alias("first"))
    many = s.where("clip % 3 != 2").groupBy("clip").agg(F.transform(F.array_sort(F.collect_list(F.struct("t_us", F.col("event_id").alias("i"), e.alias("e")))), lambda x: x["e"]).alias("l"))
    json = F.when(F.col("clip") % 3 == 0, F.to_json("l")).otherwise(F.to_json(F.struct(F.lit(3).alias("version"), F.col("l").alias("events"))))
    return many.select("clip", json.alias("json"), F.lit(None).cast("long").alias("first")).unionByName(one)


@query(f"""WITH {DOC_SQL}, v AS (SELECT clip, event_id AS i, category, CASE WHEN clip % 3 = 2 THEN 1 ELSE rn END AS place, ((t_us - {BASE}) // 1000) / 1000.0::DOUBLE AS t, ((end_us - {BASE}) // 1000) / 1000.0::DOUBLE AS u, cents FROM o),
w AS (SELECT *, CASE WHEN i % 4 != 1 THEN t ELSE 0.0 END AS a, CASE WHEN clip % 3 = 2 OR i % 4 != 2 THEN t END AS p, CASE WHEN i % 4 != 3 THEN u END AS e FROM v)
SELECT clip, CASE WHEN i % 5 = 0 THEN 'own' || i ELSE format('event_{{:03d}}', place) END AS event_name, category, a AS start_sec, coalesce(p, a) AS peak_sec, coalesce(e, p, a) AS end_sec, cents / 100.0::DOUBLE AS confidence, CASE WHEN i % 2 = 0 THEN ['audio'] ELSE [] END AS sources FROM w""")
def event_json_rows(spark, sf):
    """Event documents of all shapes read back, with the defaults of what they leave out."""
    r = event_json.event_rows(documents(spark, sf), "clip", "json")
    return r.select("clip", F.col("event_id").alias("event_name"), "category", "start_sec", "peak_sec", "end_sec", "confidence", "sources")


@query(f"""WITH {DOC_SQL}, j AS (SELECT clip, count(*) AS events, count(*) FILTER (category IN ('click', 'error')) AS gated, string_agg(format('event_{{:03d}}', rn), ',' ORDER BY rn) AS names, string_agg(category, ',' ORDER BY rn) AS categories, max(cents) AS top FROM o GROUP BY clip)
SELECT clip, false AS no_events, gated = 0 AS no_haptic, events, names, categories, top FROM j""")
def event_document(spark, sf):
    """The document of each clip, written as JSON and read again: flags, report and events in order."""
    s = d.spans(spark, sf).withColumn("rn", F.row_number().over(Window.partitionBy("clip").orderBy("t_us", "event_id")))
    e = F.struct(F.format_string("event_%03d", "rn").alias("event_id"), F.col("category"), F.round(F.col("t_us") / 1e6, 3).alias("start_sec"), F.round(F.col("end_us") / 1e6, 3).alias("end_sec"), F.col("category").isin("click", "error").alias("included_in_gate"))
    j = event_json.document(s, "clip", [F.col("rn")], e, {"top": F.max("cents")})
    x = j.select("clip", F.from_json("json", "top long, no_events_detected boolean, no_haptic_events boolean, events array<struct<event_id:string,category:string>>").alias("x"))
    join = lambda c: F.array_join(F.col(f"x.events.{c}"), ",")
    return x.select("clip", F.col("x.no_events_detected").alias("no_events"), F.col("x.no_haptic_events").alias("no_haptic"), F.size("x.events").cast("long").alias("events"), join("event_id").alias("names"), join("category").alias("categories"), F.col("x.top").alias("top"))


@query(f"""WITH {S_SQL}, r AS (SELECT clip, t_us, event_id, '{{"category":"' || category || '","end_us":' || end_us || ',"included_in_gate":' || CASE WHEN category IN ('click', 'error') THEN 'true' ELSE 'false' END || ',"start_us":' || t_us || '}}' AS j FROM s)
SELECT clip, sha256('[' || string_agg(j, ',' ORDER BY t_us, event_id) || ']') AS digest FROM r GROUP BY clip""")
def event_digest(spark, sf):
    """SHA-256 of a clip's events as JSON with sorted keys and nothing else, so that two runs can be held side by side."""
    e = F.struct("category", "end_us", F.col("category").isin("click", "error").alias("included_in_gate"), F.col("t_us").alias("start_us"))
    l = F.array_sort(F.collect_list(F.struct("t_us", "event_id", e.alias("e"))))
    return d.spans(spark, sf).groupBy("clip").agg(l.alias("l")).select("clip", F.sha2(F.to_json(F.transform("l", lambda x: x["e"])), 256).alias("digest"))


@query(f"WITH {E_SQL}, w AS (SELECT clip, t_us // {24 * HOUR} * 40 AS start_ms, least(255, CAST(sum(cents) // 100 AS INT)) AS intensity FROM e GROUP BY ALL) SELECT clip, 40::BIGINT AS window_ms, start_ms, CAST(intensity AS BIGINT) AS intensity, row_number() OVER (PARTITION BY clip ORDER BY start_ms) AS place FROM w")
def rule_map_round_trip(spark, sf):
    """Rule maps written as JSON envelopes and read back by ascending start."""
    e = d.events(spark, sf)
    w = e.groupBy("clip", (F.floor(F.col("t_us") / F.lit(24 * HOUR)) * 40).alias("start_ms")).agg(F.least(F.lit(255), F.floor(F.sum("cents") / 100)).cast("long").alias("intensity"))
    back = event_json.read_rule_map(event_json.rule_map(w.withColumn("type", F.lit("audio")), "clip", 40), "clip", "json")
    return back.withColumn("place", F.row_number().over(Window.partitionBy("clip").orderBy("start_ms")).cast("long"))


@query(f"""WITH {S_SQL}, f AS (SELECT clip, 'flash' AS what, t_us AS start_us, t_us AS end_us FROM s WHERE category = 'error' UNION ALL SELECT clip, 'fireball', t_us, end_us FROM s WHERE category = 'click' UNION ALL SELECT clip, 'scene', t_us, end_us FROM s WHERE category = 'view')
SELECT clip, what, count(*) AS n, min(start_us) AS first_us, max(end_us) AS last_us FROM f GROUP BY ALL""")
def visual_context(spark, sf):
    """The picture's findings of a clip as one document, and what it says of each kind."""
    s = d.spans(spark, sf)
    of = lambda c, end: F.collect_list(F.when(F.col("category") == c, F.struct(F.col("t_us").alias("start"), F.col(end).alias("end"))))
    doc = s.groupBy("clip").agg(of("error", "t_us").alias("flash"), of("click", "end_us").alias("fireball"), of("view", "end_us").alias("scene")).select("clip", F.to_json(F.struct("flash", "fireball", "scene")).alias("json"))
    kinds = F.from_json("json", "map<string,array<struct<start:long,end:long>>>")
    x = doc.select("clip", F.explode(kinds).alias("what", "l")).where(F.size("l") > 0)
    return x.select("clip", "what", F.size("l").cast("long").alias("n"), F.array_min(F.col("l.start")).alias("first_us"), F.array_max(F.col("l.end")).alias("last_us"))


# Clips


@query(f"WITH {G_SQL}, {event_frames_sql(20000)}, x AS (SELECT event_id, frame_idx, value FROM ef JOIN g ON g.clip = ef.clip AND frame_idx >= at_idx - 2 AND frame_idx < at_idx + 5 + event_id % 4) SELECT event_id, min(frame_idx) AS first_idx, count(*) AS n, list(round(value, 6) ORDER BY frame_idx) AS samples FROM x GROUP BY event_id")
def event_clips(spark, sf):
    """The signal under each event, padded and cut at the ends: the rows an export writes, one per event."""
    ev = event_frames(spark, sf, 20000).withColumn("a", F.col("at_idx") - 2).withColumn("b", F.col("at_idx") + 5 + F.col("event_id") % 4)
    return render.cut_clips(ev, d.grid(spark, sf), ["clip"], "event_id", "a", "b", "frame_idx", "value").select("event_id", "first_idx", "n", F.transform("samples", lambda x: F.round(x, 6)).alias("samples"))


@query(f"""WITH {G_SQL}, w AS (SELECT *, max(abs(value)) OVER (PARTITION BY clip) AS top, quantile_cont(value, 0.28) OVER (PARTITION BY clip) AS q FROM g), b AS (SELECT clip, frame_idx, CASE WHEN top > 0 THEN 0.95::DOUBLE * value / top ELSE 0.0::DOUBLE END * CASE WHEN top <= 0 OR value / top < least(q / top, 0.15::DOUBLE) THEN 0.0::DOUBLE ELSE pow(value / top, 0.65::DOUBLE) END AS y FROM w),
r AS (SELECT clip, quantile_cont(y, 0.95) FILTER (y > 1e-6) AS ref FROM b GROUP BY clip) SELECT clip, frame_idx, round(CASE WHEN ref IS NULL THEN 0.0::DOUBLE ELSE greatest(-1.0::DOUBLE, least(1.0::DOUBLE, y * (0.3::DOUBLE / ref))) END, 6) AS value FROM b JOIN r USING (clip)""")
def continuous_layer(spark, sf):
    """The bed under the events: the levelled signal times its dynamics, scaled so that its loud part meets a gain."""
    w = Window.partitionBy("clip")
    v = F.col("value")
    g = d.grid(spark, sf).withColumn("top", F.max(F.abs("value")).over(w)).withColumn("q", F.percentile("value", 0.28).over(w))
    share = F.try_divide(v, F.col("top"))
    shape = F.when((F.col("top") <= 0) | (share < F.least(F.try_divide("q", "top"), F.lit(0.15))), 0.0).otherwise(F.pow(share, F.lit(0.65)))
    b = g.select("clip", "frame_idx", (F.when(F.col("top") > 0, F.lit(0.95) * v / F.col("top")).otherwise(0.0) * shape).alias("y"))
    ref = F.percentile(F.when(F.col("y") > 1e-6, F.col("y")), 0.95).over(w)
    y = F.when(ref.isNull(), 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("y") * (F.lit(0.3) / ref))))
    return b.select("clip", "frame_idx", F.round(y, 6).alias("value"))
