"""Queries that score detections: references in several shapes, matches, per-category and overall scores, coverage, collars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import folds, metrics
from . import derived as d
from .derived import E_SQL, HOUR, S_SQL
from .registry import query

# Every event is a reference or a detection, by its id.
ROLE_SQL = "ra AS (SELECT *, clip || '|' || category AS k FROM e WHERE event_id % 2 = 0), rb AS (SELECT *, clip || '|' || category AS k FROM e WHERE event_id % 2 = 1)"


def roles(spark, sf) -> tuple[DataFrame, DataFrame]:
    e = d.events(spark, sf).withColumn("k", F.concat_ws("|", F.col("clip").cast("string"), "category"))
    return e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")


def match_sql(collars: list[int]) -> str:
    """CTEs up to `hit` (collar, k, ref_us, det_us): references in time order take the nearest unused detection."""
    return f"""{ROLE_SQL}, cl AS (SELECT unnest({collars!r}) AS collar),
rr AS (SELECT collar, k, t_us, row_number() OVER (PARTITION BY collar, k ORDER BY t_us) AS rn FROM ra, cl), lb AS (SELECT k, list(t_us ORDER BY t_us) AS ts FROM rb GROUP BY k),
st AS (SELECT DISTINCT rr.collar, rr.k, 0::BIGINT AS rn, NULL::BIGINT AS ref_us, NULL::BIGINT AS det_us, coalesce(ts, []::BIGINT[]) AS free FROM rr LEFT JOIN lb ON lb.k = rr.k
  UNION ALL SELECT collar, k, rn, ref_us, det_us, CASE WHEN det_us IS NULL THEN free ELSE list_concat(free[1:list_position(free, det_us) - 1], free[list_position(free, det_us) + 1:]) END
  FROM (SELECT st.collar, st.k, rr.rn, rr.t_us AS ref_us, st.free, list_sort(list_transform(list_filter(st.free, lambda x: abs(x - rr.t_us) <= st.collar), lambda x: {{'d': abs(x - rr.t_us), 'x': x}}))[1].x AS det_us
        FROM st JOIN rr ON rr.collar = st.collar AND rr.k = st.k AND rr.rn = st.rn + 1)),
hit AS (SELECT collar, k, ref_us, det_us FROM st WHERE rn > 0)"""


def matches(spark, sf, collars: list[int]) -> DataFrame:
    a, b = roles(spark, sf)
    return folds.one_to_one_collars(a.select("k", F.col("t_us").alias("ref_us")), b.select("k", F.col("t_us").alias("det_us")), "k", "ref_us", "det_us", collars)


@query(f"""WITH {S_SQL}, r AS (SELECT clip, category, t_us AS onset_us, end_us AS offset_us FROM s WHERE category != 'error'), m AS (SELECT clip, category, t_us AS onset_us, NULL::BIGINT AS offset_us FROM s WHERE category = 'error')
SELECT *, row_number() OVER (PARTITION BY clip ORDER BY category, onset_us, offset_us NULLS FIRST) AS rank FROM (SELECT * FROM r UNION ALL SELECT * FROM m)""")
def reference_shapes(spark, sf):
    """References as rows, whose onset is under one of three names, and as a map from category to times; ranked by category and onset."""
    s = d.spans(spark, sf)
    named = lambda i, c: F.when(F.col("event_id") % 3 == i, F.col(c))
    rows = s.where("category != 'error'").select("clip", "category", named(0, "t_us").alias("onset_us"), named(1, "t_us").alias("start_us"), named(2, "t_us").alias("peak_us"), named(0, "end_us").alias("offset_us"), F.when(F.col("event_id") % 3 != 0, F.col("end_us")).alias("end_us"))
    maps = s.where("category = 'error'").groupBy("clip", "category").agg(F.collect_list("t_us").alias("times")).groupBy("clip").agg(F.map_from_entries(F.collect_list(F.struct("category", "times"))).alias("marks"))
    out = metrics.references_of_rows(rows).unionByName(metrics.references_of_map(maps, "marks"))
    order = Window.partitionBy("clip").orderBy("category", "onset_us", F.col("offset_us").asc_nulls_first())
    return out.withColumn("rank", F.row_number().over(order).cast("long"))


@query(f"WITH {S_SQL} SELECT event_id, category, CASE WHEN event_id % 4 = 0 THEN t_us + 1000 WHEN event_id % 4 = 3 THEN 0 ELSE t_us END AS onset_us, CASE WHEN event_id % 3 > 0 THEN end_us END AS offset_us FROM s")
def detection_onsets(spark, sf):
    """The chosen field of a detection, else its start, else its peak, else 0."""
    s, i = d.spans(spark, sf), F.col("event_id") % 4
    rows = s.select("event_id", "category", F.when(i == 0, F.col("t_us") + 1000).alias("onset"), F.when(i <= 1, F.col("t_us")).alias("start_us"), F.when(i <= 2, F.col("t_us")).alias("peak_us"), F.when(F.col("event_id") % 3 > 0, F.col("end_us")).alias("end_us"))
    return rows.select("event_id", "category", metrics.onset_of(F.col("onset"), F.col("start_us"), F.col("peak_us")).alias("onset_us"), F.col("end_us").alias("offset_us"))


PRF_SQL = """round(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0.0 END, 4) AS precision, round(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0.0 END, 4) AS recall,
round(CASE WHEN 2 * tp + fp + fn > 0 THEN (2 * tp)::DOUBLE / (2 * tp + fp + fn) ELSE 0.0 END, 4) AS f1"""


@query(f"""WITH RECURSIVE {E_SQL}, {match_sql([6 * HOUR])}, h AS (SELECT split_part(k, '|', 2) AS category, count(*) AS refs, count(det_us) AS tp, sum(abs(det_us - ref_us)) AS err FROM hit GROUP BY ALL), n AS (SELECT category, count(*) AS dets FROM rb GROUP BY category),
q AS (SELECT category, coalesce(tp, 0) AS tp, coalesce(dets, 0) - coalesce(tp, 0) AS fp, coalesce(refs, 0) - coalesce(tp, 0) AS fn, coalesce(err, 0) AS err FROM h FULL JOIN n USING (category)),
t AS (SELECT category, tp, fp, fn, err FROM q UNION ALL SELECT 'micro', sum(tp), sum(fp), sum(fn), sum(err) FROM q), p AS (SELECT category, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, err, {PRF_SQL} FROM t)
SELECT category, tp, fp, fn, precision, recall, f1, CASE WHEN category = 'micro' THEN (SELECT round(avg(f1), 4) FROM p WHERE category != 'micro') END AS macro_f1, round(err::DOUBLE / nullif(tp, 0) / 1e6, 3) AS mean_error_sec FROM p""")
def event_prf_by_category(spark, sf):
    """Matches per clip and category, scored per category and over all (micro); the mean of the categories' f1 is macro."""
    return metrics.by_category(matches(spark, sf, [6 * HOUR]).withColumn("category", F.split_part("k", F.lit("|"), F.lit(2))), roles(spark, sf)[1], "ref_us", "det_us")


@query(f"""WITH RECURSIVE {E_SQL}, {match_sql([6 * HOUR])}, u AS (SELECT k, det_us, count(*) AS n FROM hit WHERE det_us IS NOT NULL GROUP BY ALL), f AS (SELECT rb.k, rb.t_us, row_number() OVER (PARTITION BY rb.k, rb.t_us) AS rn, coalesce(n, 0) AS n FROM rb LEFT JOIN u ON u.k = rb.k AND u.det_us = rb.t_us)
SELECT k, ref_us, det_us, det_us - ref_us AS error_us, CASE WHEN det_us IS NULL THEN 'miss' ELSE 'hit' END AS status FROM hit UNION ALL SELECT k, NULL, t_us, NULL, 'false_positive' FROM f WHERE rn > n""")
def event_match_list(spark, sf):
    """A row for each hit, miss and unused detection."""
    hit = matches(spark, sf, [6 * HOUR]).drop("collar")
    used = hit.where("det_us IS NOT NULL").groupBy("k", F.col("det_us").alias("t_us")).agg(F.count(F.lit(1)).alias("n"))
    free = roles(spark, sf)[1].select("k", "t_us").withColumn("rn", F.row_number().over(Window.partitionBy("k", "t_us").orderBy("t_us"))).join(used, ["k", "t_us"], "left").where(F.col("rn") > F.coalesce("n", F.lit(0)))
    rows = hit.select("k", "ref_us", "det_us", (F.col("det_us") - F.col("ref_us")).alias("error_us"), F.when(F.col("det_us").isNull(), "miss").otherwise("hit").alias("status"))
    none = F.lit(None).cast("long")
    return rows.unionByName(free.select("k", none.alias("ref_us"), F.col("t_us").alias("det_us"), none.alias("error_us"), F.lit("false_positive").alias("status")))


COLLARS = [HOUR, 3 * HOUR, 6 * HOUR]


@query(f"""WITH RECURSIVE {E_SQL}, {match_sql(COLLARS)}, t AS (SELECT collar, count(*) AS refs, count(det_us) AS tp, sum(abs(det_us - ref_us)) AS err FROM hit GROUP BY collar), q AS (SELECT collar // {HOUR} AS collar_hours, tp, (SELECT count(*) FROM rb) - tp AS fp, refs - tp AS fn, err FROM t)
SELECT collar_hours, tp, fp, fn, {PRF_SQL}, round(err::DOUBLE / nullif(tp, 0) / 1e6, 3) AS mean_error_sec FROM q""")
def event_prf_multi_collar(spark, sf):
    """Scores over all clips and categories at several collars, all matched in one pass."""
    hit = matches(spark, sf, COLLARS).groupBy("collar").agg(F.count(F.lit(1)).alias("refs"), F.count("det_us").alias("tp"), F.sum(F.abs(F.col("det_us") - F.col("ref_us"))).alias("err"))
    n = roles(spark, sf)[1].agg(F.count(F.lit(1)).alias("dets"))
    q = hit.crossJoin(F.broadcast(n)).select((F.col("collar") / HOUR).cast("long").alias("collar_hours"), "tp", (F.col("dets") - F.col("tp")).alias("fp"), (F.col("refs") - F.col("tp")).alias("fn"), "err")
    return metrics.with_prf(q).withColumn("mean_error_sec", F.round(F.try_divide(F.col("err").cast("double"), F.col("tp")) / 1e6, 3)).drop("err")


# Coverage of marks by spans; marks are the purchases, spans the clicks of a clip.
COVER_SQL = f"""{S_SQL}, mk AS (SELECT event_id, clip, t_us AS m FROM s WHERE category = 'purchase'), sp AS (SELECT clip, t_us AS a, end_us AS b FROM s WHERE category = 'click'),
ds AS (SELECT mk.event_id, mk.clip, m, min(greatest(a - m, m - b, 0)) AS far FROM mk LEFT JOIN sp ON sp.clip = mk.clip GROUP BY ALL)"""


def distances(spark, sf) -> tuple[DataFrame, DataFrame]:
    s = d.spans(spark, sf)
    spans = s.where("category = 'click'").select("clip", F.col("t_us").alias("a"), F.col("end_us").alias("b"))
    return metrics.span_distance(s.where("category = 'purchase'").select("clip", "event_id", F.col("t_us").alias("m")), spans, "clip", "m", "a", "b"), spans


@query(f"WITH {COVER_SQL} SELECT event_id, far AS distance_us FROM ds WHERE far IS NULL OR far > {HOUR}")
def uncovered_marks(spark, sf):
    """Marks that no span holds, with the distance to the nearest one of their clip; null where there is none."""
    return distances(spark, sf)[0].where(F.col("distance").isNull() | (F.col("distance") > HOUR)).select("event_id", F.col("distance").alias("distance_us"))


@query(f"""WITH {COVER_SQL}, x AS (SELECT clip, count(*) AS n_marks, count(*) FILTER (far <= {HOUR}) AS covered FROM ds GROUP BY clip), y AS (SELECT clip, count(*) AS n_spans, CAST(sum(greatest(0, b - a)) AS BIGINT) AS active_us FROM sp GROUP BY clip)
SELECT clip, coalesce(n_marks, 0) AS n_marks, coalesce(covered, 0) AS covered, round(CASE WHEN n_marks > 0 THEN covered::DOUBLE / n_marks ELSE 0.0 END, 4) AS recall, coalesce(n_spans, 0) AS n_spans, coalesce(active_us, 0) AS active_us, round(coalesce(active_us, 0) / {720.0 * HOUR}::DOUBLE, 4) AS active_fraction FROM x FULL JOIN y USING (clip)""")
def coverage_report(spark, sf):
    """Recall of marks by spans beside the share of the time that spans fill; spans that overlap count twice."""
    far, spans = distances(spark, sf)
    return metrics.coverage_of(far, spans, "clip", "a", "b", HOUR, 720 * HOUR)


@query(f"""WITH RECURSIVE {E_SQL}, {match_sql(COLLARS[1:])}, {S_SQL.strip()}, hs AS (SELECT * FROM hit WHERE split_part(k, '|', 2) != 'view'), nd AS (SELECT count(*) AS dets FROM rb WHERE category != 'view'),
ev AS (SELECT 'event_based' AS mode, collar // {HOUR} AS hours, count(det_us) AS tp, (SELECT dets FROM nd) - count(det_us) AS fp, count(*) - count(det_us) AS fn FROM hs GROUP BY collar),
sx AS (SELECT clip, category, t_us // {6 * HOUR} AS seg, max((event_id % 2 = 0)::INT) AS r, max((event_id % 2 = 1)::INT) AS q FROM e WHERE category != 'view' GROUP BY ALL), sg AS (SELECT 'segment_based' AS mode, 6 AS hours, CAST(sum(r * q) AS BIGINT) AS tp, CAST(sum((1 - r) * q) AS BIGINT) AS fp, CAST(sum(r * (1 - q)) AS BIGINT) AS fn FROM sx),
vm AS (SELECT clip, t_us AS m FROM s WHERE category = 'view' AND event_id % 2 = 0), vs AS (SELECT clip, t_us AS a, end_us AS b FROM s WHERE category = 'view' AND event_id % 2 = 1), vd AS (SELECT m, (SELECT min(greatest(a - m, m - b, 0)) FROM vs WHERE vs.clip = vm.clip) AS far FROM vm),
cv AS (SELECT 'coverage' AS mode, 1 AS hours, count(*) FILTER (far <= {HOUR}) AS tp, NULL::BIGINT AS fp, count(*) FILTER (far IS NULL OR far > {HOUR}) AS fn FROM vd)
SELECT mode, CAST(hours AS BIGINT) AS hours, tp, fp, fn, round(tp::DOUBLE / (tp + fn), 4) AS recall FROM (SELECT * FROM ev UNION ALL SELECT * FROM sg UNION ALL SELECT * FROM cv)""")
def evaluation_bundle(spark, sf):
    """Event-based scores at several collars and segment-based ones, without the sustained category, for which coverage stands."""
    hit = matches(spark, sf, COLLARS[1:]).where("NOT endswith(k, '|view')").groupBy("collar").agg(F.count("det_us").alias("tp"), F.count(F.lit(1)).alias("refs"))
    e = d.events(spark, sf)
    dets = e.where("event_id % 2 = 1 AND category != 'view'").agg(F.count(F.lit(1)).alias("dets"))
    hours = lambda c: (c / HOUR).cast("long").alias("hours")
    ev = hit.crossJoin(F.broadcast(dets)).select(F.lit("event_based").alias("mode"), hours(F.col("collar")), "tp", (F.col("dets") - F.col("tp")).alias("fp"), (F.col("refs") - F.col("tp")).alias("fn"))
    has = lambda i: F.max((F.col("event_id") % 2 == i).cast("int"))
    x = e.where("category != 'view'").groupBy("clip", "category", F.floor(F.col("t_us") / F.lit(6 * HOUR)).alias("seg")).agg(has(0).alias("r"), has(1).alias("q"))
    r, q = F.col("r"), F.col("q")
    sg = x.agg(F.sum(r * q).alias("tp"), F.sum((1 - r) * q).alias("fp"), F.sum(r * (1 - q)).alias("fn")).select(F.lit("segment_based").alias("mode"), F.lit(6).cast("long").alias("hours"), "tp", "fp", "fn")
    v = d.spans(spark, sf).where("category = 'view'")
    far = metrics.span_distance(v.where("event_id % 2 = 0").select("clip", F.col("t_us").alias("m")), v.where("event_id % 2 = 1").select("clip", F.col("t_us").alias("a"), F.col("end_us").alias("b")), "clip", "m", "a", "b")
    near = F.coalesce(F.col("distance") <= HOUR, F.lit(False))
    cv = far.agg(F.count(F.when(near, 1)).alias("tp"), F.count(F.when(~near, 1)).alias("fn")).select(F.lit("coverage").alias("mode"), F.lit(1).cast("long").alias("hours"), "tp", F.lit(None).cast("long").alias("fp"), "fn")
    out = ev.unionByName(sg).unionByName(cv)
    return out.withColumn("recall", F.round(F.col("tp") / (F.col("tp") + F.col("fn")), 4))
