"""Queries on labels, thresholds, replies, reports and other one-step rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import labels
from ..functions import vocabulary as v
from ..operators import joins, metrics
from ..session import table
from . import derived as d
from .derived import E_SQL, G_SQL, HOUR, P_SQL, S_SQL
from .registry import K, query

SOURCE = ["audio", "video", "context_token", "other"]
POOL_ROWS = ", ".join(
    f"('{c}', {i}, '{pool}', {j}, '{' '.join(x.lower().split())}')" for i, (c, _, audio) in enumerate(labels.CATEGORIES) for pool, names in (("audio", audio), ("context", v.CONTEXT.get(c, [])), ("video", v.VIDEO.get(c, []))) for j, x in enumerate(names)
)
NAMES = ["Gunshot, gunfire", "Riding a bike", "Engine", "thunder", "Smashing", "Rain", "  TRUCK  ", "Exploding", "", "car crash"]
LABEL_SQL = f"""t(category, ord, pool, place, label) AS (VALUES {POOL_ROWS}),
x AS (SELECT event_id, {NAMES!r}[event_id % {len(NAMES)} + 1] AS label, {SOURCE!r}[event_id // 7 % 4 + 1] AS source FROM events),
mt AS (SELECT x.*, (SELECT arg_min(category, ord) FROM t WHERE trim(lower(x.label)) != '' AND (contains(trim(lower(x.label)), t.label) OR contains(t.label, trim(lower(x.label))))
  AND CASE source WHEN 'audio' THEN pool IN ('audio', 'context') WHEN 'video' THEN pool = 'video' WHEN 'context_token' THEN pool = 'context' ELSE true END) AS category FROM x)"""


def named(spark, sf):
    pick = lambda xs, i: F.element_at(F.array(*[F.lit(x) for x in xs]), (i % len(xs) + 1).cast("int"))
    i = F.col("event_id")
    return table(spark, sf, "events").select("event_id", pick(NAMES, i).alias("label"), pick(SOURCE, F.floor(i / 7)).alias("source"))


@query(f"WITH {LABEL_SQL} SELECT * FROM mt")
def label_match_sources(spark, sf):
    """The category of each label, looked up in its source's pools."""
    return v.match_labels(named(spark, sf), "label", "source").select("event_id", "label", "source", "category")


@query(f"WITH {LABEL_SQL} SELECT category, list_sort(list(DISTINCT event_id % {len(NAMES)})) AS ids FROM mt WHERE source = 'audio' AND category IS NOT NULL GROUP BY category")
def label_index_map(spark, sf):
    """The outputs of a model that feed each category; categories without any are left out."""
    outputs = named(spark, sf).where("source = 'audio'").select((F.col("event_id") % len(NAMES)).alias("id"), "label", "source").distinct()
    return v.match_labels(outputs, "label", "source").where("category IS NOT NULL").groupBy("category").agg(F.array_sort(F.collect_set("id")).alias("ids"))


SET_ROWS = ", ".join(f"('{c}', {i}, {str(flag).lower()}, {str(c in v.GATED).lower()}, {v.HIGH.get(c, 'NULL')}::DOUBLE, {v.LOW.get(c, 'NULL')}::DOUBLE)" for i, (c, flag, _) in enumerate(labels.CATEGORIES))
SET_SQL = f"st(category, ord, impulsive, in_gate, high, low) AS (VALUES {SET_ROWS})"
OWN = ["gunshot", "explosion", "smash", "car_crash", "vehicle", "unheard_of"]


@query(f"WITH {SET_SQL} SELECT category, coalesce(high, 0.5) AS high, greatest(least(coalesce(low, 0.2), coalesce(high, 0.5)), 0.0) AS low FROM st")
def category_thresholds(spark, sf):
    return v.thresholds(v.settings_of(spark), 0.5, 0.2)


@query(f"WITH {SET_SQL}, e AS (SELECT event_id, {OWN!r}[event_id % {len(OWN)} + 1] AS category FROM events) SELECT event_id, category, coalesce(impulsive, false) AS impulsive, coalesce(in_gate, false) AS in_gate FROM e LEFT JOIN st USING (category)")
def contract_flags(spark, sf):
    """Events with their category's flags; an unknown category is neither sudden nor in the gate."""
    e = table(spark, sf, "events").select("event_id", F.element_at(F.array(*map(F.lit, OWN)), (F.col("event_id") % len(OWN) + 1).cast("int")).alias("category"))
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return e.join(F.broadcast(v.settings_of(spark)), "category", "left").select("event_id", "category", no("impulsive"), no("in_gate"))


@query(f"WITH {SET_SQL}, g AS (SELECT 'from flags' AS rule, category FROM st WHERE in_gate UNION ALL SELECT 'named', unnest(['vehicle', 'smash'])) SELECT rule, category FROM g")
def gate_categories(spark, sf):
    """Categories of the gate: a list that is given, an empty one too, or those that are flagged."""
    s = v.settings_of(spark)
    return s.where("in_gate").select(F.lit("from flags").alias("rule"), "category").union(metrics.gate_of(s, ["vehicle", "smash"]).select(F.lit("named"), "category")).union(metrics.gate_of(s, []).select(F.lit("none"), "category"))


@query(f"WITH {SET_SQL}, e AS (SELECT event_id, {OWN!r}[event_id % {len(OWN)} + 1] AS category FROM events) SELECT coalesce(impulsive, false) AS impulsive, list_sort(list(DISTINCT category)) AS categories, count(*) AS n FROM e LEFT JOIN st USING (category) GROUP BY 1")
def sudden_lasting_split(spark, sf):
    return contract_flags(spark, sf).groupBy("impulsive").agg(F.array_sort(F.collect_set("category")).alias("categories"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {P_SQL} SELECT clip, frame_idx, CASE clip WHEN 'click' THEN 'Gunshot, gunfire' WHEN 'view' THEN 'Vehicle' ELSE clip END AS label, round(score, 6) AS score FROM p WHERE score > 0.01")
def sparse_scores(spark, sf):
    """Frame scores that count, under the first label of their category, or the category's own name."""
    label = F.when(F.col("clip") == "click", labels.CATEGORIES[0][2][0]).when(F.col("clip") == "view", labels.CATEGORIES[4][2][0]).otherwise(F.col("clip"))
    return d.scores(spark, sf).where("score > 0.01D").select("clip", "frame_idx", label.alias("label"), F.round("score", 6).alias("score"))


@query("SELECT event_id, ['vehicle', 'engine_start', 'car_crash'] AS categories FROM events WHERE event_id % 5 = 0 UNION ALL SELECT event_id, ['gunshot'] FROM events WHERE event_id % 5 = 1 UNION ALL SELECT event_id, ['smash', 'explosion'] FROM events WHERE event_id % 5 = 2 UNION ALL SELECT event_id, ['vehicle'] FROM events WHERE event_id % 5 = 3 UNION ALL SELECT event_id, [] FROM events WHERE event_id % 5 = 4")
def parse_json_reply(spark, sf):
    """Replies in five shapes: an object with a list, an object with one name, two lists beside broken JSON, names between commas,
    JSON without a known name."""
    i = F.col("event_id")
    say = lambda x: F.concat(F.lit(x[0]), F.col("event_type"), F.lit(x[1]))
    shapes = [
        ('I see ', ': {"categories": ["Vehicle", "engine start", "vehicle", "Car-Crash"], "why": 3}'), ('{"category": "Gunshot"} for ', " it is"),
        ('[smash] then\n["Smash",\n"', '"] and {"categories": ["explosion"]}'), ("Vehicle, ", ",rain"), ('["', '"] {"categories": ["rain"]}'),
    ]
    reply = say(shapes[4])
    for n, s in enumerate(shapes[:4]):
        reply = F.when(i % 5 == n, say(s)).otherwise(reply)
    return table(spark, sf, "events").select("event_id", v.reply_names(reply).alias("categories"))


@query(f"WITH {E_SQL} SELECT event_id, least(greatest((cents - 500) / 100.0::DOUBLE, 0.0::DOUBLE), 80.0::DOUBLE) * 255.0::DOUBLE / 80.0::DOUBLE AS level FROM e")
def linear_scale(spark, sf):
    return d.events(spark, sf).select("event_id", v.linear((F.col("cents") - 500) / 100.0, 80.0, 255.0).alias("level"))


@query("SELECT event_id, event_id % 4 != 0 AND event_id % 32 >= 20 AS runs, CASE WHEN event_id % 4 = 0 THEN 'switched off' WHEN event_id % 32 = 1 THEN 'no GPU' WHEN event_id % 32 < 20 THEN printf('%d GB of 20', event_id % 32) ELSE printf('%d GB', event_id % 32) END AS why FROM events")
def model_enabled(spark, sf):
    gb = (F.col("event_id") % 32).cast("double")
    r = v.model_runs(F.col("event_id") % 4 != 0, F.when(gb != 1, gb), 20.0)
    return table(spark, sf, "events").select("event_id", r["runs"].alias("runs"), r["why"].alias("why"))


# One-step measures


@query(f"WITH {E_SQL} SELECT clip, t_us // {HOUR} AS hour, max(cents) FILTER (category IN ('click', 'error')) AS sudden, max(cents) FILTER (category IN ('view', 'purchase')) AS lasting FROM e GROUP BY ALL")
def label_group_max(spark, sf):
    """A category's score is the largest of its outputs."""
    of = lambda *c: F.max(F.when(F.col("category").isin(*c), F.col("cents")))
    return d.events(spark, sf).groupBy("clip", F.floor(F.col("t_us") / F.lit(HOUR)).alias("hour")).agg(of("click", "error").alias("sudden"), of("view", "purchase").alias("lasting"))


@query(f"WITH {G_SQL}, w AS (SELECT clip, frame_idx // 4 AS win, least(sqrt(sum(value * value) / count(*) + 1e-12), 100.0::DOUBLE) * 255.0::DOUBLE / 100.0::DOUBLE AS level FROM g GROUP BY ALL) SELECT clip, win, CASE WHEN level > 16 AND floor(level) >= 16 THEN 'audio' ELSE 'none' END AS type, CASE WHEN level > 16 AND floor(level) >= 16 THEN CAST(floor(level) AS INT) ELSE 0 END AS intensity FROM w")
def audio_rule_windows(spark, sf):
    """Windows classified by sound alone: level, scale, rule."""
    w = d.grid(spark, sf).groupBy("clip", F.floor(F.col("frame_idx") / 4).alias("win")).agg(F.sqrt(F.sum(F.col("value") * F.col("value")) / F.count(F.lit(1)) + 1e-12).alias("rms"))
    zero = F.lit(0.0)
    return w.select("clip", "win", labels.rule_window(zero, zero, v.linear(F.col("rms"), 100.0, 255.0), 30, 120, 40).alias("r")).select("clip", "win", "r.type", "r.intensity")


@query(f"WITH {G_SQL} SELECT clip, frame_idx // 10 AS bin, round(max(value), 6) AS top FROM g GROUP BY ALL")
def curve_downsample(spark, sf):
    return d.grid(spark, sf).groupBy("clip", F.floor(F.col("frame_idx") / 10).alias("bin")).agg(F.round(F.max("value"), 6).alias("top"))


@query(f"WITH {E_SQL}, s AS (SELECT *, t_us - lag(t_us) OVER (PARTITION BY clip ORDER BY t_us, event_id) AS dt FROM e) SELECT clip, CASE WHEN count(dt) = 0 OR quantile_cont(dt, 0.5) <= 0 THEN 15 ELSE greatest(5, CAST(round_even({20 * HOUR}::DOUBLE / quantile_cont(dt, 0.5), 0) AS INT) | 1) END AS frames FROM s GROUP BY clip")
def smoothing_width(spark, sf):
    """An odd number of steps nearest a time, from the middle step of the series; five at least."""
    s = d.events(spark, sf).withColumn("dt", F.col("t_us") - F.lag("t_us").over(Window.partitionBy("clip").orderBy("t_us", "event_id")))
    dt = F.percentile("dt", 0.5)
    n = F.bround(F.lit(float(20 * HOUR)) / F.when(dt > 0, dt)).cast("int").bitwiseOR(1)
    return s.groupBy("clip").agg(F.coalesce(F.greatest(F.lit(5), n), F.lit(15)).alias("frames")).select("clip", F.when(F.col("frames").isNull(), 15).otherwise(F.col("frames")).alias("frames"))


@query(f"WITH {E_SQL}, q AS (SELECT clip, category, cents, row_number() OVER (PARTITION BY clip ORDER BY cents DESC, event_id) AS rn FROM e WHERE category IN ('click', 'error')), c AS (SELECT DISTINCT clip FROM e) SELECT clip, coalesce(category, 'explosion') AS label, coalesce(cents, 0) AS cents FROM c LEFT JOIN (SELECT * FROM q WHERE rn = 1) USING (clip)")
def clip_best_label(spark, sf):
    """The label of a clip's strongest sudden score, the first of equals; a fixed one where there is none."""
    sudden = F.col("category").isin("click", "error")
    top = F.min(F.when(sudden, F.struct((-F.col("cents")).alias("s"), "event_id", "category")))
    return d.events(spark, sf).groupBy("clip").agg(top.alias("b")).select("clip", F.coalesce("b.category", F.lit("explosion")).alias("label"), F.coalesce(-F.col("b.s"), F.lit(0)).alias("cents"))


@query(f"WITH {G_SQL}, k AS (SELECT clip, max(value) AS top, quantile_cont(value, 0.5) FILTER (value >= 90) AS mid FROM g GROUP BY clip) SELECT clip, round(coalesce(mid, 0.35::DOUBLE * top), 6) AS level FROM k")
def shot_level(spark, sf):
    """The middle level of confident frames; without any, a share of the largest."""
    return d.grid(spark, sf).groupBy("clip").agg(F.round(F.coalesce(F.percentile(F.when(F.col("value") >= 90, F.col("value")), 0.5), F.lit(0.35) * F.max("value")), 6).alias("level"))


@query(f"WITH {E_SQL}, m AS (SELECT event_id, clip, t_us FROM e WHERE category = 'purchase'), x AS (SELECT clip, t_us, cents FROM e WHERE category = 'click'), n AS (SELECT m.event_id, max(x.cents) FILTER (abs(x.t_us - m.t_us) <= {6 * HOUR}) AS near, min((abs(x.t_us - m.t_us), x.t_us, -x.cents)) AS b FROM m LEFT JOIN x ON x.clip = m.clip GROUP BY m.event_id) SELECT event_id, coalesce(near, -b[3]) AS cents FROM n")
def local_max_or_nearest(spark, sf):
    """The largest value near a mark; the nearest one, however far, where none is near."""
    e = d.events(spark, sf)
    marks = e.where("category = 'purchase'").select("clip", "event_id", "t_us")
    x = e.where("category = 'click'").select("clip", F.col("t_us").alias("x_us"), F.col("cents").alias("x_cents"))
    near = joins.band_join(marks, x, K, "t_us", "x_us", 6 * HOUR).groupBy("event_id").agg(F.max("x_cents").alias("near"))
    any_ = joins.nearest_any(marks, x, "clip", "t_us", "x_us", [(-F.col("x_cents")).alias("o")])
    return any_.join(near, "event_id", "left").select("event_id", F.coalesce("near", -F.col("nearest.o")).alias("cents"))


@query(f"WITH {E_SQL}, m AS (SELECT event_id, clip, t_us FROM e WHERE category = 'purchase'), n AS (SELECT m.event_id, min((abs(x.t_us - m.t_us), x.t_us)) AS b FROM m LEFT JOIN e x ON x.clip = m.clip AND x.category = 'error' GROUP BY m.event_id) SELECT event_id, b[1] AS dist, b[2] AS mark_us FROM n")
def nearest_mark_any(spark, sf):
    """The nearest mark at any distance, the earlier of equals, found from the last one before and the first one after."""
    e = d.events(spark, sf)
    out = joins.nearest_any(e.where("category = 'purchase'").select("clip", "event_id", "t_us"), e.where("category = 'error'").select("clip", F.col("t_us").alias("x_us")), "clip", "t_us", "x_us", [])
    return out.select("event_id", F.col("nearest.dist").alias("dist"), F.col("nearest.t").alias("mark_us"))


@query(f"WITH {S_SQL}, p AS (SELECT event_id, clip, t_us FROM s WHERE category = 'purchase'), h AS (SELECT p.event_id, s.category, min((s.t_us, s.event_id)) AS f FROM p JOIN s ON s.clip = p.clip AND s.category IN ('click', 'error') AND p.t_us BETWEEN s.t_us AND s.end_us AND s.end_us - s.t_us <= {4 * HOUR} GROUP BY ALL) SELECT event_id, list(category ORDER BY f) AS categories FROM h GROUP BY event_id")
def bang_scenes(spark, sf):
    """Scenes of a few kinds, short enough to pin a moment down, that hold a point, ends included: their kinds, once each, by the first."""
    s = d.spans(spark, sf)
    p = s.where("category = 'purchase'").select("clip", "event_id", (F.col("t_us") - 1).alias("p_s"), (F.col("t_us") + 1).alias("p_e"))
    scenes = s.where(f"category IN ('click', 'error') AND end_us - t_us <= {4 * HOUR}").select("clip", F.col("category").alias("kind"), F.col("t_us").alias("b_s"), F.col("end_us").alias("b_e"), F.col("event_id").alias("b_id"))
    hit = joins.overlap_join(p, scenes.withColumn("c_s", F.col("b_s")).withColumn("c_e", F.col("b_e")), K, "p_s", "p_e", "c_s", "c_e", HOUR)
    first = hit.groupBy("event_id", "kind").agg(F.min(F.struct("b_s", "b_id")).alias("f")).groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("f", "kind"))).alias("l"))
    return first.select("event_id", F.col("l.kind").alias("categories"))


# Reports


@query("SELECT clip, category FROM (SELECT DISTINCT user_id AS clip, event_type AS category FROM events WHERE event_id % 2 = 0 UNION SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 2 = 1)")
def categories_seen(spark, sf):
    """Categories in references or detections of each clip."""
    e = d.events(spark, sf)
    return e.where("event_id % 2 = 0").select("clip", "category").union(e.where("event_id % 2 = 1").select("clip", "category")).distinct()


@query(f"SELECT DISTINCT label FROM (VALUES {POOL_ROWS}) t(category, ord, pool, place, label)")
def label_set(spark, sf):
    return v.labels_of(spark).select("label").distinct()


@query(f"WITH {E_SQL}, c AS (SELECT clip, count(*) FILTER (category = 'click') AS heard, count(*) FILTER (category = 'click' AND cents < 1000) AS unbacked, count(*) FILTER (category = 'error') AS flashes, count(*) FILTER (category = 'view') AS scenes FROM e GROUP BY clip) SELECT clip, heard, unbacked, flashes, scenes, scenes > 0 AS scenes_ran, heard - unbacked + flashes AS fused FROM c")
def fusion_report(spark, sf):
    """What each step of the fusion met, per clip."""
    n = lambda c: F.count(F.when(F.expr(c), 1))
    c = d.events(spark, sf).groupBy("clip").agg(n("category = 'click'").alias("heard"), n("category = 'click' AND cents < 1000").alias("unbacked"), n("category = 'error'").alias("flashes"), n("category = 'view'").alias("scenes"))
    return c.select("*", (F.col("scenes") > 0).alias("scenes_ran"), (F.col("heard") - F.col("unbacked") + F.col("flashes")).alias("fused"))


@query("SELECT event_id, event_id % 3 != 0 AND lower('track.' || ext) LIKE '%.wav' AS playback, CASE WHEN event_id % 3 != 0 AND ext ILIKE 'wav' THEN '' WHEN event_id % 3 = 0 THEN 'debug/core' ELSE 'debug/pipeline/' || event_type END AS folder FROM (SELECT *, ['wav', 'json', 'WAV', 'png'][event_id % 4 + 1] AS ext FROM events)")
def playback_routing(spark, sf):
    """Where an output goes in the archive: sound that is no core artifact at the root, the rest in folders."""
    e = table(spark, sf, "events").withColumn("ext", F.element_at(F.array(*map(F.lit, ["wav", "json", "WAV", "png"])), (F.col("event_id") % 4 + 1).cast("int")))
    core = F.col("event_id") % 3 == 0
    plays = ~core & (F.lower("ext") == "wav")
    return e.select("event_id", plays.alias("playback"), F.when(plays, "").when(core, "debug/core").otherwise(F.concat(F.lit("debug/pipeline/"), "event_type")).alias("folder"))


@query(f"WITH {S_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY t_us, event_id) AS rn FROM s) SELECT clip, rn, printf('event_%03d  %-10s %12.3f %12.3f %8.2f', rn, category, ((t_us - 1700000000000000) // 1000) / 1e3::DOUBLE, (end_us - t_us) / 1e6::DOUBLE, cents / 100.0::DOUBLE) AS line FROM o")
def event_table_lines(spark, sf):
    """A report's lines: columns of fixed width."""
    s = d.spans(spark, sf).withColumn("rn", F.row_number().over(Window.partitionBy("clip").orderBy("t_us", "event_id")).cast("long"))
    line = F.format_string("event_%03d  %-10s %12.3f %12.3f %8.2f", F.col("rn"), F.col("category"), F.floor((F.col("t_us") - 1_700_000_000_000_000) / F.lit(1000)) / 1e3, (F.col("end_us") - F.col("t_us")) / 1e6, F.col("cents") / 100.0)
    return s.select("clip", "rn", line.alias("line"))


WIN = 12 * HOUR


@query(f"WITH {E_SQL}, r AS (SELECT clip, min(t_us) AS lo, max(t_us) AS hi FROM e GROUP BY clip), w AS (SELECT clip, unnest(range(lo, hi + 1, {WIN})) AS start_us FROM r) SELECT w.clip, start_us, count(event_id) AS n, coalesce(max(cents), 0) AS best FROM w LEFT JOIN e ON e.clip = w.clip AND t_us >= start_us AND t_us < start_us + {WIN} GROUP BY ALL")
def windowed_scores(spark, sf):
    """Uniform windows of each clip with the scores inside them; a score finds its window by arithmetic."""
    e = d.events(spark, sf)
    r = e.groupBy("clip").agg(F.min("t_us").alias("lo"), F.max("t_us").alias("hi"))
    w = r.select("clip", F.explode(F.sequence("lo", "hi", F.lit(WIN))).alias("start_us"))
    at = e.join(r, "clip").withColumn("start_us", F.col("lo") + F.floor((F.col("t_us") - F.col("lo")) / F.lit(WIN)) * WIN).groupBy("clip", "start_us").agg(F.count(F.lit(1)).alias("n"), F.max("cents").alias("best"))
    return w.join(at, ["clip", "start_us"], "left").select("clip", "start_us", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("best", F.lit(0)).alias("best"))


@query(f"WITH {E_SQL}, c AS (SELECT clip, category, t_us, lead(t_us) OVER (PARTITION BY clip ORDER BY t_us, event_id) AS nxt FROM e WHERE category IN ('view', 'error')), w AS (SELECT clip, min(t_us) AS lo, max(t_us) AS hi FROM e GROUP BY clip), s AS (SELECT clip, t_us AS start_us, coalesce(nxt, hi) AS end_us FROM c JOIN w USING (clip)) SELECT clip, start_us, end_us FROM s WHERE end_us > start_us UNION ALL SELECT clip, lo, hi FROM w WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.clip = w.clip) AND hi > lo")
def scene_cuts(spark, sf):
    """Scenes between cuts; a clip without a cut is one scene; scenes without length go."""
    e = d.events(spark, sf)
    ends = e.groupBy("clip").agg(F.min("t_us").alias("lo"), F.max("t_us").alias("hi"))
    cuts = e.where("category IN ('view', 'error')").withColumn("nxt", F.lead("t_us").over(Window.partitionBy("clip").orderBy("t_us", "event_id")))
    s = cuts.join(ends, "clip").select("clip", F.col("t_us").alias("start_us"), F.coalesce("nxt", "hi").alias("end_us"))
    whole = ends.join(cuts.select("clip").distinct(), "clip", "left_anti").select("clip", F.col("lo").alias("start_us"), F.col("hi").alias("end_us"))
    return s.unionByName(whole).where("end_us > start_us")
