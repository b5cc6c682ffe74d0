"""Queries on proposals: onsets found by level and by flux, uniform windows, their union, scores split at peaks, primitives."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import folds, islands, joins
from . import derived as d
from .derived import E_SQL, G_SQL, HOUR
from .registry import K, query

# Lengths in frames of the grid.
PAD, APART, SCAN = 3, 4, 12
GREEDY = "list_reduce(list([{t}] ORDER BY {v} DESC, {t}), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: abs(y - x[1]) < {apart})) > 0 THEN acc ELSE list_concat(acc, x) END)"


def peaks_sql(name: str, value: str, ratio: float, top: str) -> str:
    """CTEs up to `name` (clip, c, s): local maxima, ends included, of at least `ratio` of the largest, spaced; s is scaled to `top`."""
    return f"""
{name}_t AS (SELECT *, max({value}) OVER (PARTITION BY clip) AS best, lag({value}) OVER w AS l, lead({value}) OVER w AS r, max(value) OVER (PARTITION BY clip) AS loud FROM fx WINDOW w AS (PARTITION BY clip ORDER BY frame_idx)),
{name}_c AS (SELECT * FROM {name}_t WHERE best > 1e-8 AND {value} >= {ratio}::DOUBLE * best AND {value} >= coalesce(l, -1) AND {value} >= coalesce(r, -1)),
{name}_k AS (SELECT clip, unnest({GREEDY.format(t='frame_idx', v=value, apart=APART)}) AS c FROM {name}_c GROUP BY clip),
{name} AS (SELECT k.clip, k.c, {top} AS s FROM {name}_k k JOIN {name}_c x ON x.clip = k.clip AND x.frame_idx = k.c)"""


ONSET_SQL = f"""{G_SQL}, fx AS (SELECT *, greatest(0.0::DOUBLE, value - coalesce(lag(value) OVER (PARTITION BY clip ORDER BY frame_idx), value)) AS flux, max(frame_idx) OVER (PARTITION BY clip) AS hi FROM g),
{peaks_sql('pr', 'value', 0.18, 'x.value')}, {peaks_sql('pf', 'flux', 0.16, 'x.flux / x.best * x.loud')},
wn AS (SELECT u.clip, greatest(0, c - {PAD})::DOUBLE AS a, least(hi, c + {PAD})::DOUBLE AS b, c::DOUBLE AS c, s FROM (SELECT * FROM pr UNION ALL SELECT * FROM pf) u JOIN (SELECT clip, max(frame_idx) AS hi FROM g GROUP BY clip) USING (clip)),
mr AS (SELECT clip, list_reduce(list([[a, b, c, s]] ORDER BY a, c, s DESC), lambda acc, x: CASE WHEN x[1][1] <= acc[-1][2] + 1 AND x[1][3] - acc[-1][3] < {APART}
  THEN list_concat(acc[1:len(acc) - 1], [[acc[-1][1], greatest(acc[-1][2], x[1][2]), CASE WHEN x[1][4] > acc[-1][4] THEN x[1][3] ELSE acc[-1][3] END, greatest(acc[-1][4], x[1][4])]]) ELSE list_concat(acc, x) END) AS l FROM wn GROUP BY clip),
onset AS (SELECT clip, CAST(w[1] AS BIGINT) AS start_idx, CAST(w[2] AS BIGINT) AS end_idx, CAST(w[3] AS BIGINT) AS centre, w[4] AS score FROM (SELECT clip, unnest(l) AS w FROM mr))"""


def spaced_peaks(f: DataFrame, value: str, ratio: float, score) -> DataFrame:
    w = Window.partitionBy(*K).orderBy("frame_idx")
    v, low = F.col(value), F.lit(-1.0)
    t = f.withColumn("best", F.max(value).over(Window.partitionBy(*K))).withColumn("l", F.lag(value).over(w)).withColumn("r", F.lead(value).over(w))
    t = t.where((F.col("best") > 1e-8) & (v >= F.lit(ratio) * F.col("best")) & (v >= F.coalesce("l", low)) & (v >= F.coalesce("r", low)))
    return folds.greedy_spacing(t.select("clip", "frame_idx", F.col(value).alias("v"), score.alias("score")), K, "frame_idx", "v", APART).select("clip", F.col("frame_idx").alias("centre"), "score")


def onsets(spark, sf) -> DataFrame:
    """clip, start_idx, end_idx, centre, score: peaks of the level and of its rise, the latter scored as shares of the loudest frame."""
    w = Window.partitionBy(*K)
    v = F.col("value")
    flux = F.greatest(F.lit(0.0), v - F.coalesce(F.lag("value").over(w.orderBy("frame_idx")), v))
    f = d.grid(spark, sf).withColumn("flux", flux).withColumn("loud", F.max("value").over(w)).withColumn("hi", F.max("frame_idx").over(w))
    found = spaced_peaks(f, "value", 0.18, v).unionByName(spaced_peaks(f, "flux", 0.16, F.col("flux") / F.col("best") * F.col("loud")))
    ends = f.groupBy("clip").agg(F.max("hi").alias("hi"))
    zero = F.lit(0).cast("long")
    rows = found.join(ends, "clip").select("clip", F.greatest(zero, F.col("centre") - PAD).alias("start_idx"), F.least(F.col("hi"), F.col("centre") + PAD).alias("end_idx"), "centre", "score")
    return folds.merge_windows(rows, K, "start_idx", "end_idx", "centre", "score", 1, APART)


@query(f"WITH {ONSET_SQL} SELECT clip, start_idx, end_idx, centre, round(score, 6) AS score FROM onset")
def onset_proposals(spark, sf):
    return onsets(spark, sf).withColumn("score", F.round("score", 6))


DEDUPE = "list_reduce(list([[{t}::DOUBLE, {v}::DOUBLE]] ORDER BY {t}, {v} DESC), lambda acc, x: CASE WHEN x[1][1] - acc[-1][1] < {apart} THEN CASE WHEN x[1][2] > acc[-1][2] THEN list_concat(acc[1:len(acc) - 1], x) ELSE acc END ELSE list_concat(acc, x) END)"


@query(f"""WITH {ONSET_SQL}, sw AS (SELECT clip, unnest(range({SCAN // 2}, hi + 1, {SCAN})) AS centre FROM (SELECT clip, max(frame_idx) AS hi FROM g GROUP BY clip)), al AS (SELECT clip, centre, score FROM onset UNION ALL SELECT clip, centre, 0.0 FROM sw),
k AS (SELECT clip, unnest({DEDUPE.format(t='centre', v='score', apart=APART)}) AS w FROM al GROUP BY clip) SELECT clip, CAST(w[1] AS BIGINT) AS centre, round(w[2], 6) AS score FROM k""")
def all_proposals(spark, sf):
    """Onsets, and uniform windows where no onset is near: of windows closer than a gap the higher score stays."""
    g = d.grid(spark, sf).groupBy("clip").agg(F.max("frame_idx").alias("hi")).where(f"hi >= {SCAN // 2}")
    scan = g.select("clip", F.explode(F.sequence(F.lit(SCAN // 2).cast("long"), F.col("hi"), F.lit(SCAN).cast("long"))).alias("centre"), F.lit(0.0).alias("score"))
    rows = onsets(spark, sf).select("clip", "centre", "score").unionByName(scan)
    return folds.dedupe_by_peak(rows, K, "centre", "score", APART - 1).withColumn("score", F.round("score", 6))


@query(f"WITH {E_SQL}, k AS (SELECT clip, unnest({DEDUPE.format(t='t_us', v='cents', apart=4 * HOUR)}) AS w FROM e GROUP BY clip) SELECT clip, CAST(w[1] AS BIGINT) AS t_us, CAST(w[2] AS BIGINT) AS cents FROM k")
def dedupe_windows(spark, sf):
    """Of centres closer than a gap to the last survivor the higher score stays."""
    return folds.dedupe_by_peak(d.events(spark, sf).select("clip", "t_us", "cents"), K, "t_us", "cents", 4 * HOUR - 1)


# Scores: every event is one, from the picture or from the sound by its id; sudden categories are split at peaks, others merged.
HALF, NEAR, LEAST, SPACE = 3 * HOUR, 4 * HOUR, 4000, 6 * HOUR
SUDDEN = "('click', 'error')"


def score_sql(name: str, where: str) -> str:
    """CTEs up to `name` (clip, category, start_us, peak_us, end_us, cents, sources, audio, video): sudden scores, one at each peak."""
    return f"""
{name}_s AS (SELECT clip, category, t_us, cents, CASE WHEN event_id % 2 = 0 THEN 'audio' ELSE 'video' END AS source FROM e WHERE category IN {SUDDEN} AND {where}),
{name}_b AS (SELECT clip, category, t_us, max(cents) AS v FROM {name}_s GROUP BY ALL),
{name}_n AS (SELECT *, lag(v) OVER w AS l, lead(v) OVER w AS r FROM {name}_b WINDOW w AS (PARTITION BY clip, category ORDER BY t_us)),
{name}_k AS (SELECT clip, category, unnest({GREEDY.format(t='t_us', v='v', apart=SPACE)}) AS p FROM {name}_n WHERE v >= {LEAST} AND v >= coalesce(l, -1) AND v >= coalesce(r, -1) GROUP BY clip, category),
{name} AS (SELECT k.clip, k.category, p - {HALF} AS start_us, p AS peak_us, p + {HALF} AS end_us, max(cents) FILTER (t_us = p) AS cents, list_sort(list(DISTINCT source)) AS sources, max(cents) FILTER (source = 'audio') AS audio, max(cents) FILTER (source = 'video') AS video
  FROM {name}_k k JOIN {name}_s s ON s.clip = k.clip AND s.category = k.category AND abs(t_us - p) <= {NEAR} AND cents * 10 >= {LEAST * 8} GROUP BY ALL)"""


def scored(e: DataFrame) -> DataFrame:
    return e.withColumn("source", F.when(F.col("event_id") % 2 == 0, "audio").otherwise("video"))


def split_scores(s: DataFrame) -> DataFrame:
    """Scores of sudden categories as one short event for each spaced peak, with what lies near it."""
    key = ["clip", "category"]
    b = s.groupBy(*key, "t_us").agg(F.max("cents").alias("v"))
    w = Window.partitionBy(*key).orderBy("t_us")
    low = F.lit(-1)
    b = b.withColumn("l", F.lag("v").over(w)).withColumn("r", F.lead("v").over(w)).where((F.col("v") >= LEAST) & (F.col("v") >= F.coalesce("l", low)) & (F.col("v") >= F.coalesce("r", low)))
    peaks = folds.greedy_spacing(b.select(*key, "t_us", "v"), key, "t_us", "v", SPACE).withColumnRenamed("t_us", "peak_us")
    near = joins.band_join(peaks, s.where(F.col("cents") * 10 >= LEAST * 8).select(*key, "t_us", "cents", "source"), key, "peak_us", "t_us", NEAR)
    of = lambda c: F.max(F.when(F.col("source") == c, F.col("cents"))).alias(c)
    out = near.groupBy(*key, "peak_us").agg(F.max(F.when(F.col("t_us") == F.col("peak_us"), F.col("cents"))).alias("cents"), F.array_sort(F.collect_set("source")).alias("sources"), of("audio"), of("video"))
    return out.select(*key, (F.col("peak_us") - HALF).alias("start_us"), "peak_us", (F.col("peak_us") + HALF).alias("end_us"), "cents", "sources", "audio", "video")


@query(f"WITH {E_SQL}, {score_sql('ps', 'true')} SELECT * FROM ps")
def peak_split_scores(spark, sf):
    return split_scores(scored(d.events(spark, sf).where(f"category IN {SUDDEN}")))


@query(f"""WITH {E_SQL} SELECT a.event_id, count(*) AS n, list_sort(list(DISTINCT CASE WHEN b.event_id % 2 = 0 THEN 'audio' ELSE 'video' END)) AS sources, max(b.cents) FILTER (b.event_id % 2 = 0) AS audio, max(b.cents) FILTER (b.event_id % 2 = 1) AS video,
greatest(max(b.cents) FILTER (b.event_id % 2 = 0), max(b.cents) FILTER (b.event_id % 2 = 1)) AS best FROM e a JOIN e b ON b.clip = a.clip AND abs(b.t_us - a.t_us) <= {NEAR} AND b.cents * 10 >= {LEAST * 8} WHERE a.cents >= {LEAST} GROUP BY a.event_id""")
def neighbourhood_collect(spark, sf):
    """What lies near a strong score: how many, from which sources, and the largest of each and of both where either is missing."""
    e = scored(d.events(spark, sf))
    near = e.where(F.col("cents") * 10 >= LEAST * 8).select("clip", F.col("t_us").alias("b_us"), F.col("cents").alias("b_cents"), "source")
    pairs = joins.band_join(e.where(F.col("cents") >= LEAST).select("clip", "event_id", "t_us"), near, K, "t_us", "b_us", NEAR)
    of = lambda c: F.max(F.when(F.col("source") == c, F.col("b_cents"))).alias(c)
    out = pairs.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("source")).alias("sources"), of("audio"), of("video"))
    return out.withColumn("best", F.greatest("audio", "video"))


GAP = 8 * HOUR


def merged_sql(name: str, where: str, pad: int) -> str:
    """CTEs up to `name`, as score_sql, of lasting categories: scores at most a gap apart are one."""
    return f"""
{name}_l AS (SELECT clip, category, t_us, cents, event_id, CASE WHEN event_id % 2 = 0 THEN 'audio' ELSE 'video' END AS source, lag(t_us) OVER (PARTITION BY clip, category ORDER BY t_us, event_id) AS last FROM e WHERE category NOT IN {SUDDEN} AND {where}),
{name}_i AS (SELECT *, sum(CASE WHEN t_us - last <= {GAP} THEN 0 ELSE 1 END) OVER (PARTITION BY clip, category ORDER BY t_us, event_id ROWS UNBOUNDED PRECEDING) AS isl FROM {name}_l),
{name} AS (SELECT clip, category, min(t_us) - {pad} AS start_us, -max((cents, -t_us))[2] AS peak_us, max(t_us) + {pad} AS end_us, max(cents) AS cents, list_sort(list(DISTINCT source)) AS sources, max(cents) FILTER (source = 'audio') AS audio, max(cents) FILTER (source = 'video') AS video FROM {name}_i GROUP BY clip, category, isl)"""


def merge_scores(s: DataFrame, pad: int) -> DataFrame:
    """Scores of lasting categories, those at most a gap apart as one event with the first strongest as its peak."""
    of = lambda c: F.max(F.when(F.col("source") == c, F.col("cents"))).alias(c)
    top = F.max(F.struct("cents", (-F.col("t_us")).alias("t"))).alias("top")
    m = islands.merge_gaps(s.withColumn("last_us", F.col("t_us")), ["clip", "category"], "t_us", "last_us", GAP, [top, F.array_sort(F.collect_set("source")).alias("sources"), of("audio"), of("video")])
    return m.select("clip", "category", (F.col("t_us") - pad).alias("start_us"), (-F.col("top.t")).alias("peak_us"), (F.col("last_us") + pad).alias("end_us"), F.col("top.cents").alias("cents"), "sources", "audio", "video")


MARGIN = 2 * HOUR
TOKEN, ENCODER = "event_id % 3 = 0", "event_id % 3 != 0"


@query(f"""WITH {E_SQL}, {score_sql('ta', TOKEN)}, {merged_sql('tb', TOKEN, 4 * HOUR)}, {score_sql('ea', ENCODER)}, {merged_sql('eb', f'cents >= 1000 AND {ENCODER}', 3 * HOUR)}, tk AS (SELECT * FROM ta UNION ALL SELECT * FROM tb), en AS (SELECT * FROM ea UNION ALL SELECT * FROM eb)
SELECT clip, category, start_us, peak_us, end_us, cents, sources, true AS token FROM tk UNION ALL SELECT clip, category, start_us, peak_us, end_us, cents, sources, false FROM en
WHERE NOT EXISTS (SELECT 1 FROM tk WHERE tk.clip = en.clip AND tk.category = en.category AND en.start_us - {MARGIN} <= tk.end_us AND en.end_us + {MARGIN} >= tk.start_us)""")
def aggregate_primitives(spark, sf):
    """Tokens and encoder scores as primitives; an encoder's goes where a token's of its category overlaps it, widened by a margin."""
    e = scored(d.events(spark, sf))
    sudden, lasting = e.where(f"category IN {SUDDEN}"), e.where(f"category NOT IN {SUDDEN}")
    tk = split_scores(sudden.where(TOKEN)).unionByName(merge_scores(lasting.where(TOKEN), 4 * HOUR))
    en = split_scores(sudden.where(ENCODER)).unionByName(merge_scores(lasting.where(f"cents >= 1000 AND {ENCODER}"), 3 * HOUR))
    key = ["clip", "category"]
    wide = en.withColumn("w_s", F.col("start_us") - MARGIN - 1).withColumn("w_e", F.col("end_us") + MARGIN + 1)  # closed ends of whole numbers
    hit = joins.overlap_join(wide, tk.select(*key, F.col("start_us").alias("b_s"), F.col("end_us").alias("b_e")), key, "w_s", "w_e", "b_s", "b_e", 12 * HOUR).select(*key, "start_us", "peak_us").distinct()
    cols = [*key, "start_us", "peak_us", "end_us", "cents", "sources"]
    left = en.join(hit, [*key, "start_us", "peak_us"], "left_anti")
    return tk.select(*cols, F.lit(True).alias("token")).unionByName(left.select(*cols, F.lit(False).alias("token")))
