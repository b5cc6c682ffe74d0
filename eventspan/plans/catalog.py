"""Every registered query of the event engine with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import labels
from ..operators import adaptive, folds, frames, islands, joins, metrics
from ..session import table
from ..streaming import tumbling
from . import calibration, evaluation, gating, packaging, picture, proposals, refinement, rendering, rows, sustained, terms, tracks  # noqa: F401  (they register their queries)
from . import derived as d
from .derived import ADAPTIVE_SQL, E_SQL, G_SQL, HOUR, MINUTE, P_SQL, S_SQL, V_SQL, smooth_sql
from .registry import K, oracle_sql, queries, query  # noqa: F401

# Frames


@query(f"WITH {G_SQL} SELECT clip, frame_idx, round(value, 6) AS value FROM g")
def frame_grid(spark, sf):
    return d.grid(spark, sf).withColumn("value", F.round("value", 6))


@query(f"WITH {G_SQL} SELECT clip, frame_idx // 6 AS hop, round(sqrt(sum(value * value) / count(*) + 1e-12), 6) AS rms FROM g GROUP BY ALL")
def rms_envelope(spark, sf):
    return frames.rms_envelope(d.grid(spark, sf), K, "frame_idx", "value", 6).withColumn("rms", F.round("rms", 6))


@query(f"WITH {G_SQL} SELECT clip, frame_idx // 7 AS hop, round(sqrt(sum(value * value) / 7.0::DOUBLE), 6) AS rms FROM g GROUP BY ALL")
def padded_rms(spark, sf):
    return frames.rms_envelope(d.grid(spark, sf), K, "frame_idx", "value", 7, 0.0, True).withColumn("rms", F.round("rms", 6))


@query(f"WITH {G_SQL}, {smooth_sql('g', 'value', 2, 'quantile_cont(v, 0.5)')} SELECT clip, frame_idx, round(sv, 6) AS smooth FROM m")
def median_smooth(spark, sf):
    return frames.median_smooth(d.grid(spark, sf), K, "frame_idx", "value", 5).select("clip", "frame_idx", F.round("smooth", 6).alias("smooth"))


@query(f"WITH {G_SQL}, {smooth_sql('g', 'value', 3, 'avg(v)')} SELECT clip, frame_idx, round(sv, 6) AS mean FROM m")
def moving_average(spark, sf):
    return frames.moving_average(d.grid(spark, sf), K, "frame_idx", "value", 7).select("clip", "frame_idx", F.round("mean", 6).alias("mean"))


@query(f"WITH {G_SQL} SELECT clip, frame_idx, round(max(value) OVER (PARTITION BY clip ORDER BY frame_idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS held FROM g")
def peak_hold(spark, sf):
    return frames.peak_hold(d.grid(spark, sf), K, "frame_idx", "value", 3).select("clip", "frame_idx", F.round("held", 6).alias("held"))


@query(f"WITH {G_SQL} SELECT clip, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.99), 6) AS p99 FROM g GROUP BY clip")
def percentile_profile(spark, sf):
    return d.grid(spark, sf).groupBy("clip").agg(*[F.round(F.percentile("value", p), 6).alias(f"p{round(p * 100)}") for p in (0.1, 0.5, 0.9, 0.99)])


@query(f"WITH {G_SQL}, q AS (SELECT *, quantile_cont(value, 0.99) OVER (PARTITION BY clip) AS top FROM g) SELECT clip, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS p50 FROM q WHERE value >= 0.05::DOUBLE * top GROUP BY clip")
def active_percentiles(spark, sf):
    g = d.grid(spark, sf)
    active = g.withColumn("top", F.percentile("value", 0.99).over(Window.partitionBy("clip"))).where(F.col("value") >= F.lit(0.05) * F.col("top"))
    return active.groupBy("clip").agg(F.count(F.lit(1)).alias("n"), F.round(F.percentile("value", 0.5), 6).alias("p50"))


@query(f"WITH {G_SQL} SELECT clip, round(list_sort(list(value))[CAST(round_even((count(*) - 1) * 0.6::DOUBLE, 0) AS INT) + 1], 6) AS p60 FROM g GROUP BY clip")
def nearest_rank(spark, sf):
    return d.grid(spark, sf).groupBy("clip").agg(F.round(frames.nearest_rank(F.collect_list("value"), 0.6), 6).alias("p60"))


@query(f"WITH {V_SQL}, l AS (SELECT *, lag(vec) OVER (PARTITION BY clip ORDER BY frame_idx) AS last FROM v) SELECT clip, frame_idx, round(CASE WHEN last IS NULL THEN 0.0 ELSE list_sum(list_transform(list_zip(vec, last), lambda z: greatest(z[1] - z[2], 0.0::DOUBLE))) END, 6) AS flux FROM l")
def spectral_flux_vectors(spark, sf):
    return frames.vector_flux(d.vectors(spark, sf), K, "frame_idx", "vec").select("clip", "frame_idx", F.round("flux", 6).alias("flux"))


@query(f"WITH {G_SQL}, x AS (SELECT clip, frame_idx, value - 50.0::DOUBLE AS y FROM g), l AS (SELECT *, lag(y) OVER (PARTITION BY clip ORDER BY frame_idx) AS last FROM x) SELECT clip, frame_idx // 24 AS hop, CAST(sum(CASE WHEN last IS NOT NULL AND (y < 0) != (last < 0) THEN 1 ELSE 0 END) AS BIGINT) AS crossings FROM l GROUP BY ALL")
def zero_crossings(spark, sf):
    return frames.zero_crossings(d.grid(spark, sf), K, "frame_idx", F.col("value") - 50.0, 24)


# Islands


@query(f"""WITH {P_SQL}, r AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY clip ORDER BY frame_idx) AS run FROM p WHERE score >= 0.4)
SELECT clip, min(frame_idx) AS first_idx, max(frame_idx) AS last_idx, arg_min(frame_idx, (-score, frame_idx)) AS peak_idx, round(max(score), 6) AS peak FROM r GROUP BY clip, run HAVING max(score) >= 0.55""")
def hysteresis_islands(spark, sf):
    return islands.hysteresis(d.scores(spark, sf), K, "frame_idx", "score", 0.55, 0.4).withColumn("peak", F.round("peak", 6))


DECODE = f"""WITH {P_SQL}, {smooth_sql('p', 'score', 2, 'quantile_cont(v, 0.5)')},
r AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY clip ORDER BY frame_idx) AS run FROM m WHERE sv >= 0.4),
h AS (SELECT clip, min(frame_idx) AS a, max(frame_idx) AS b, min((-sv, frame_idx)) AS top FROM r GROUP BY clip, run HAVING max(sv) >= 0.5),
w AS (SELECT *, max(b) OVER (PARTITION BY clip ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM h),
i AS (SELECT *, sum(CASE WHEN a <= reach + 2 THEN 0 ELSE 1 END) OVER (PARTITION BY clip ORDER BY a) AS isl FROM w)
SELECT clip, min(a) AS first_idx, max(b) AS last_idx, count(*) AS n, min(top)[2] AS peak_idx, round(-min(top)[1], 6) AS confidence FROM i GROUP BY clip, isl"""


@query(DECODE)
def decode_events(spark, sf):
    """Posterior curves to events: median smoothing, hysteresis, gap merge, first largest frame as peak."""
    smooth = frames.median_smooth(d.scores(spark, sf), K, "frame_idx", "score", 5)
    h = islands.hysteresis(smooth, K, "frame_idx", "smooth", 0.5, 0.4)
    top = F.min(F.struct((-F.col("peak")).alias("s"), F.col("peak_idx").alias("i")))
    out = islands.merge_gaps(h, K, "first_idx", "last_idx", 2, [top.alias("top")])
    return out.select("clip", "first_idx", "last_idx", "n", F.col("top.i").alias("peak_idx"), F.round(-F.col("top.s"), 6).alias("confidence"))


@query(f"WITH {G_SQL}, r AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY clip ORDER BY frame_idx) AS run FROM g WHERE value > 60), l AS (SELECT clip, count(*) AS frames FROM r GROUP BY clip, run) SELECT clip, frames, count(*) AS runs FROM l GROUP BY ALL")
def run_lengths(spark, sf):
    runs = islands.flag_runs(d.grid(spark, sf), K, "frame_idx", F.col("value") > 60)
    return runs.groupBy("clip", "run").agg(F.count(F.lit(1)).alias("frames")).groupBy("clip", "frames").agg(F.count(F.lit(1)).alias("runs"))


MERGED = """w AS (SELECT *, max(end_us) OVER (PARTITION BY {k} ORDER BY t_us, end_us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
i AS (SELECT *, sum(CASE WHEN t_us <= reach + {gap} THEN 0 ELSE 1 END) OVER (PARTITION BY {k} ORDER BY t_us, end_us ROWS UNBOUNDED PRECEDING) AS isl FROM w)"""


@query(f"WITH {S_SQL}, {MERGED.format(k='clip, category', gap=HOUR)} SELECT clip, category, min(t_us) AS t_us, max(end_us) AS end_us, count(*) AS n, max((cents, t_us, end_us, event_id))[4] AS event_id, max(cents) AS cents FROM i GROUP BY clip, category, isl")
def sustained_merge(spark, sf):
    return islands.sustained_merge(d.spans(spark, sf), ["clip", "category"], "t_us", "end_us", "event_id", "cents", HOUR)


@query(f"WITH {S_SQL}, {MERGED.format(k='clip', gap=0)}, u AS (SELECT clip, min(t_us) AS a, max(end_us) AS b, count(*) AS n FROM i GROUP BY clip, isl) SELECT clip, CAST(sum(b - a) AS BIGINT) AS covered, count(*) AS islands, CAST(sum(n) AS BIGINT) AS spans FROM u GROUP BY clip")
def interval_union_coverage(spark, sf):
    return islands.union_length(d.spans(spark, sf), K, "t_us", "end_us")


@query(f"WITH {E_SQL}, l AS (SELECT *, lag(t_us) OVER (PARTITION BY clip, category ORDER BY t_us) AS last FROM e), c AS (SELECT *, sum(CASE WHEN t_us - last <= {12 * HOUR} THEN 0 ELSE 1 END) OVER (PARTITION BY clip, category ORDER BY t_us ROWS UNBOUNDED PRECEDING) AS isl FROM l) SELECT clip, category, min(t_us) AS t_us, max(t_us) AS end_us, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM c GROUP BY clip, category, isl")
def time_gap_clusters(spark, sf):
    e = d.events(spark, sf).withColumn("end_us", F.col("t_us"))
    return islands.merge_gaps(e, ["clip", "category"], "t_us", "end_us", 12 * HOUR, [F.sum("cents").alias("cents")])


# Peaks and folds


@query(f"WITH {G_SQL}, l AS (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS b FROM g WINDOW w AS (PARTITION BY clip ORDER BY frame_idx)) SELECT clip, frame_idx, round(value, 6) AS value FROM l WHERE value > 60 AND value >= coalesce(a, -1) AND value >= coalesce(b, -1)")
def local_peaks(spark, sf):
    w = Window.partitionBy("clip").orderBy("frame_idx")
    g = d.grid(spark, sf).withColumn("a", F.lag("value").over(w)).withColumn("b", F.lead("value").over(w))
    v = F.col("value")
    return g.where((v > 60) & (v >= F.coalesce("a", F.lit(-1.0))) & (v >= F.coalesce("b", F.lit(-1.0)))).select("clip", "frame_idx", F.round("value", 6).alias("value"))


@query(f"""WITH {E_SQL}, k AS (SELECT clip, list_reduce(list([t_us] ORDER BY cents DESC, t_us), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: abs(y - x[1]) < {24 * HOUR})) > 0 THEN acc ELSE list_concat(acc, x) END) AS kept FROM e GROUP BY clip)
SELECT clip, unnest(kept) AS t_us FROM k""")
def greedy_spacing(spark, sf):
    return folds.greedy_spacing(d.events(spark, sf).select("clip", "t_us", "cents"), K, "t_us", "cents", 24 * HOUR).select("clip", "t_us")


@query(f"""WITH RECURSIVE {E_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY clip, category ORDER BY t_us, cents DESC) AS rn FROM e),
st AS (SELECT clip, category, rn, t_us, cents, event_id, 1 AS no FROM o WHERE rn = 1
  UNION ALL SELECT o.clip, o.category, o.rn, CASE WHEN o.t_us - st.t_us <= {8 * HOUR} AND o.cents <= st.cents THEN st.t_us ELSE o.t_us END,
    CASE WHEN o.t_us - st.t_us <= {8 * HOUR} AND o.cents <= st.cents THEN st.cents ELSE o.cents END,
    CASE WHEN o.t_us - st.t_us <= {8 * HOUR} AND o.cents <= st.cents THEN st.event_id ELSE o.event_id END,
    CASE WHEN o.t_us - st.t_us <= {8 * HOUR} THEN st.no ELSE st.no + 1 END
  FROM st JOIN o ON o.clip = st.clip AND o.category = st.category AND o.rn = st.rn + 1)
SELECT clip, category, arg_max(event_id, rn) AS event_id FROM st GROUP BY clip, category, no""")
def dedupe_by_peak(spark, sf):
    e = d.events(spark, sf)
    return folds.dedupe_by_peak(e, ["clip", "category"], "t_us", "cents", 8 * HOUR).select("clip", "category", "event_id")


REFS = "a AS (SELECT * FROM e WHERE category = 'purchase'), b AS (SELECT * FROM e WHERE category = 'click')"


def refs_dets(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = d.events(spark, sf)
    return e.where("category = 'purchase'"), e.where("category = 'click'")


MATCH = f"""{E_SQL}, {REFS}, ra AS (SELECT clip, t_us, row_number() OVER (PARTITION BY clip ORDER BY t_us) AS rn FROM a), lb AS (SELECT clip, list(t_us ORDER BY t_us) AS ts FROM b GROUP BY clip),
st AS (SELECT DISTINCT ra.clip, 0::BIGINT AS rn, NULL::BIGINT AS ref_us, NULL::BIGINT AS det_us, coalesce(ts, []::BIGINT[]) AS free FROM ra LEFT JOIN lb ON lb.clip = ra.clip
  UNION ALL SELECT clip, rn, ref_us, det_us, list_filter(free, lambda x: det_us IS NULL OR x != det_us)
  FROM (SELECT st.clip, ra.rn, ra.t_us AS ref_us, st.free, list_sort(list_transform(list_filter(st.free, lambda x: abs(x - ra.t_us) <= {6 * HOUR}), lambda x: {{'d': abs(x - ra.t_us), 'x': x}}))[1].x AS det_us
        FROM st JOIN ra ON ra.clip = st.clip AND ra.rn = st.rn + 1))"""


@query(f"WITH RECURSIVE {MATCH} SELECT clip, ref_us, det_us FROM st WHERE rn > 0")
def one_to_one_match(spark, sf):
    a, b = refs_dets(spark, sf)
    return folds.one_to_one(a.select("clip", F.col("t_us").alias("ref_us")), b.select("clip", F.col("t_us").alias("det_us")), "clip", "ref_us", "det_us", 6 * HOUR).where("ref_us IS NOT NULL")


PRF = """SELECT clip, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp) ELSE 0.0 END, 4) AS precision, round(CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) ELSE 0.0 END, 4) AS recall,
round(CASE WHEN 2 * tp + fp + fn > 0 THEN (2 * tp)::DOUBLE / (2 * tp + fp + fn) ELSE 0.0 END, 4) AS f1 FROM """


@query(f"WITH RECURSIVE {MATCH}, h AS (SELECT clip, count(*) AS refs, count(det_us) AS tp FROM st WHERE rn > 0 GROUP BY clip), n AS (SELECT clip, count(*) AS dets FROM b GROUP BY clip), q AS (SELECT clip, coalesce(tp, 0) AS tp, coalesce(dets, 0) - coalesce(tp, 0) AS fp, coalesce(refs, 0) - coalesce(tp, 0) AS fn FROM h FULL JOIN n USING (clip)) {PRF} q")
def event_prf(spark, sf):
    a, b = refs_dets(spark, sf)
    hits = one_to_one_match(spark, sf).groupBy("clip").agg(F.count(F.lit(1)).alias("refs"), F.count("det_us").alias("hit"))
    n = b.groupBy("clip").agg(F.count(F.lit(1)).alias("dets"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    q = hits.join(n, "clip", "full").select("clip", zero("hit").alias("tp"), (zero("dets") - zero("hit")).alias("fp"), (zero("refs") - zero("hit")).alias("fn"))
    return metrics.with_prf(q)


@query(f"""WITH {E_SQL}, {REFS}, x AS (SELECT clip, t_us // {6 * HOUR} AS seg, max((category = 'purchase')::INT) AS r, max((category = 'click')::INT) AS q FROM e WHERE category IN ('purchase', 'click') GROUP BY ALL),
z AS (SELECT clip, CAST(sum(r * q) AS BIGINT) AS tp, CAST(sum((1 - r) * q) AS BIGINT) AS fp, CAST(sum(r * (1 - q)) AS BIGINT) AS fn FROM x GROUP BY clip) {PRF} z""")
def segment_prf(spark, sf):
    e = d.events(spark, sf).where(F.col("category").isin("purchase", "click"))
    has = lambda c: F.max((F.col("category") == c).cast("int"))
    x = e.groupBy("clip", F.floor(F.col("t_us") / F.lit(6 * HOUR)).alias("seg")).agg(has("purchase").alias("r"), has("click").alias("q"))
    z = x.groupBy("clip").agg(F.sum(F.col("r") * F.col("q")).alias("tp"), F.sum((1 - F.col("r")) * F.col("q")).alias("fp"), F.sum(F.col("r") * (1 - F.col("q"))).alias("fn"))
    return metrics.with_prf(z)


@query(f"WITH {S_SQL}, r AS (SELECT clip, t_us FROM s WHERE category = 'purchase'), k AS (SELECT * FROM s WHERE category = 'click'), z AS (SELECT clip, count(*) AS n_marks, CAST(sum(EXISTS (SELECT 1 FROM k WHERE k.clip = r.clip AND r.t_us BETWEEN k.t_us - {10 * MINUTE} AND k.end_us + {10 * MINUTE})::INT) AS BIGINT) AS covered FROM r GROUP BY clip) SELECT *, round(covered::DOUBLE / n_marks, 4) AS recall FROM z")
def coverage_recall(spark, sf):
    s = d.spans(spark, sf)
    return metrics.coverage(s.where("category = 'purchase'").select("clip", "t_us"), s.where("category = 'click'"), "clip", "t_us", "t_us", "end_us", 10 * MINUTE, 2 * HOUR)


# Joins


@query(f"WITH {E_SQL}, {REFS}, p AS (SELECT a.event_id, min((abs(a.t_us - b.t_us), b.t_us, b.event_id)) AS x FROM a JOIN b ON a.clip = b.clip AND abs(a.t_us - b.t_us) <= {12 * HOUR} GROUP BY a.event_id) SELECT a.event_id, x[1] AS dist, x[3] AS near_event_id FROM a LEFT JOIN p USING (event_id)")
def nearest_mark(spark, sf):
    a, b = refs_dets(spark, sf)
    right = b.select("clip", F.col("t_us").alias("b_us"), F.col("event_id").alias("b_id"))
    out = joins.nearest(a, right, K, "event_id", "t_us", "b_us", 12 * HOUR, ["b_id"])
    return out.select("event_id", "dist", F.col("near_b_id").alias("near_event_id"))


@query(f"WITH {E_SQL}, {REFS} SELECT a.event_id, max(b.cents) AS cents, min((-b.cents, b.t_us, b.event_id))[3] AS best_id, count(*) AS n FROM a JOIN b ON a.clip = b.clip AND abs(a.t_us - b.t_us) <= {24 * HOUR} GROUP BY a.event_id")
def band_best_score(spark, sf):
    a, b = refs_dets(spark, sf)
    right = b.select("clip", F.col("t_us").alias("b_us"), F.col("event_id").alias("b_id"), F.col("cents").alias("b_cents"))
    pairs = joins.band_join(a, right, K, "t_us", "b_us", 24 * HOUR)
    return pairs.groupBy("event_id").agg(F.max("b_cents").alias("cents"), F.min(F.struct((-F.col("b_cents")).alias("s"), "b_us", "b_id"))["b_id"].alias("best_id"), F.count(F.lit(1)).alias("n"))


SPAN_PAIR = "a AS (SELECT * FROM s WHERE category = 'purchase'), b AS (SELECT * FROM s WHERE category = 'view')"


def span_pair(spark, sf):
    s = d.spans(spark, sf)
    return s.where("category = 'purchase'"), s.where("category = 'view'").select("clip", F.col("event_id").alias("b_id"), F.col("t_us").alias("b_s"), F.col("end_us").alias("b_e"))


@query(f"WITH {S_SQL}, {SPAN_PAIR} SELECT a.event_id, b.event_id AS b_id FROM a JOIN b ON a.clip = b.clip AND a.t_us < b.end_us AND b.t_us < a.end_us")
def overlap_join(spark, sf):
    a, b = span_pair(spark, sf)
    return joins.overlap_join(a, b, K, "t_us", "end_us", "b_s", "b_e", HOUR).select("event_id", "b_id")


@query(f"WITH {S_SQL}, {SPAN_PAIR} SELECT event_id FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.clip = b.clip AND a.t_us < b.end_us AND b.t_us < a.end_us)")
def anti_overlap(spark, sf):
    a, b = span_pair(spark, sf)
    hit = joins.overlap_join(a, b, K, "t_us", "end_us", "b_s", "b_e", HOUR).select("event_id")
    return a.join(hit, "event_id", "left_anti").select("event_id")


@query(f"WITH {S_SQL} SELECT p.event_id, list_sort(list(DISTINCT s.category)) AS categories FROM s p JOIN s ON s.clip = p.clip AND p.t_us > s.t_us AND p.t_us < s.end_us AND p.event_id != s.event_id GROUP BY p.event_id")
def point_in_interval(spark, sf):
    s = d.spans(spark, sf)
    points = s.select("clip", "event_id", F.col("t_us").alias("p_us")).withColumn("q_us", F.col("p_us"))
    right = s.select("clip", F.col("event_id").alias("b_id"), F.col("t_us").alias("b_s"), F.col("end_us").alias("b_e"), "category")
    hit = joins.overlap_join(points, right, K, "p_us", "q_us", "b_s", "b_e", HOUR).where("event_id != b_id")
    return hit.groupBy("event_id").agg(F.array_sort(F.collect_set("category")).alias("categories"))


@query(f"WITH {E_SQL}, {REFS} SELECT event_id FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.clip = b.clip AND abs(a.t_us - b.t_us) <= {6 * HOUR})")
def chips_under_peaks(spark, sf):
    a, b = refs_dets(spark, sf)
    near = joins.band_join(a, b.select("clip", F.col("t_us").alias("b_us")), K, "t_us", "b_us", 6 * HOUR).select("event_id")
    return a.join(near, "event_id", "left_anti").select("event_id")


@query(f"WITH {S_SQL}, l AS (SELECT *, lead(t_us) OVER (PARTITION BY clip ORDER BY t_us, event_id) AS nxt FROM s) SELECT event_id, least(end_us, coalesce(nxt, end_us)) AS end_us FROM l")
def trim_to_next(spark, sf):
    nxt = F.lead("t_us").over(Window.partitionBy("clip").orderBy("t_us", "event_id"))
    return d.spans(spark, sf).select("event_id", F.least("end_us", F.coalesce(nxt, F.col("end_us"))).alias("end_us"))


# Measures of peaks


@query(f"WITH {G_SQL}, m AS (SELECT *, quantile_cont(value, 0.5) OVER (PARTITION BY clip ORDER BY frame_idx ROWS BETWEEN 13 PRECEDING AND 2 PRECEDING) AS bed, count(*) OVER (PARTITION BY clip ORDER BY frame_idx ROWS BETWEEN 13 PRECEDING AND 2 PRECEDING) AS n FROM g) SELECT clip, frame_idx, round(CASE WHEN n < 4 THEN 0.0 WHEN bed <= 0 THEN 999.0 ELSE least(value / bed, 999.0::DOUBLE) END, 6) AS prominence FROM m")
def flux_prominence(spark, sf):
    """Value over the median of what lies just before it; 0 without enough of that, 999 at most."""
    w = Window.partitionBy("clip").orderBy("frame_idx").rowsBetween(-13, -2)
    m = d.grid(spark, sf).withColumn("bed", F.percentile("value", 0.5).over(w)).withColumn("n", F.count(F.lit(1)).over(w))
    p = F.when(F.col("n") < 4, 0.0).when(F.col("bed") <= 0, 999.0).otherwise(F.least(F.try_divide("value", "bed"), F.lit(999.0)))
    return m.select("clip", "frame_idx", F.round(p, 6).alias("prominence"))


@query(f"WITH {G_SQL}, m AS (SELECT *, max(value) OVER (PARTITION BY clip ORDER BY frame_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near, max(value) OVER (PARTITION BY clip) AS top FROM g) SELECT clip, frame_idx, round(CASE WHEN top > 0 THEN near / top ELSE 0.0 END, 4) AS rel_max FROM m")
def measure_attacks(spark, sf):
    g = frames.peak_hold(d.grid(spark, sf), K, "frame_idx", "value", 2, "near").withColumn("top", F.max("value").over(Window.partitionBy("clip")))
    return g.select("clip", "frame_idx", F.round(F.when(F.col("top") > 0, F.try_divide("near", "top")).otherwise(0.0), 4).alias("rel_max"))


@query(f"""WITH {S_SQL}, k AS (SELECT clip, category, list_reduce(list([t_us] ORDER BY cents DESC, t_us), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: abs(y - x[1]) < {12 * HOUR})) > 0 THEN acc ELSE list_concat(acc, x) END) AS kept FROM s GROUP BY ALL),
u AS (SELECT clip, category, unnest(kept) AS t_us FROM k), j AS (SELECT s.* FROM s JOIN u USING (clip, category, t_us))
SELECT event_id, least(end_us, coalesce(lead(t_us) OVER (PARTITION BY clip ORDER BY t_us, event_id), end_us)) AS end_us FROM j""")
def suppress_overlaps(spark, sf):
    """Of each category the strongest, spaced apart; then every span ends where the next one starts."""
    kept = folds.greedy_spacing(d.spans(spark, sf), ["clip", "category"], "t_us", "cents", 12 * HOUR)
    nxt = F.lead("t_us").over(Window.partitionBy("clip").orderBy("t_us", "event_id"))
    return kept.select("event_id", F.least("end_us", F.coalesce(nxt, F.col("end_us"))).alias("end_us"))


@query(f"WITH {G_SQL}, m AS (SELECT *, max(value) OVER (PARTITION BY clip) AS top FROM g) SELECT clip, min(frame_idx) FILTER (value >= 0.18::DOUBLE * top) AS onset FROM m GROUP BY clip")
def segment_onset(spark, sf):
    m = d.grid(spark, sf).withColumn("top", F.max("value").over(Window.partitionBy("clip")))
    return m.groupBy("clip").agg(F.min(F.when(F.col("value") >= F.lit(0.18) * F.col("top"), F.col("frame_idx"))).alias("onset"))


@query(f"WITH {G_SQL}, l AS (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS b FROM g WINDOW w AS (PARTITION BY clip ORDER BY frame_idx)) SELECT clip, frame_idx, round(value, 6) AS value FROM l WHERE value >= coalesce(a, -1) AND value >= coalesce(b, -1) ORDER BY l.value DESC, frame_idx, clip LIMIT 40")
def attack_scan_topn(spark, sf):
    w = Window.partitionBy("clip").orderBy("frame_idx")
    g = d.grid(spark, sf).withColumn("a", F.lag("value").over(w)).withColumn("b", F.lead("value").over(w))
    v = F.col("value")
    top = g.where((v >= F.coalesce("a", F.lit(-1.0))) & (v >= F.coalesce("b", F.lit(-1.0)))).orderBy(F.desc("value"), "frame_idx", "clip").limit(40)
    return top.select("clip", "frame_idx", F.round("value", 6).alias("value"))


@query(f"WITH {V_SQL}, l AS (SELECT clip, frame_idx, vec AS a, lag(vec) OVER (PARTITION BY clip ORDER BY frame_idx) AS b FROM v), q AS (SELECT *, len(a) AS n, list_sum(a) AS sa, list_sum(b) AS sb, list_sum(list_transform(a, lambda x: x * x)) AS aa, list_sum(list_transform(b, lambda x: x * x)) AS bb, list_sum(list_transform(list_zip(a, b), lambda z: z[1] * z[2])) AS ab FROM l WHERE b IS NOT NULL) SELECT clip, frame_idx, round((n * ab - sa * sb) / (sqrt(n * aa - sa * sa) * sqrt(n * bb - sb * sb)), 5) AS continuity FROM q")
def vector_continuity(spark, sf):
    """Pearson correlation of each vector with the one before."""
    v = d.vectors(spark, sf).withColumn("last", F.lag("vec").over(Window.partitionBy("clip").orderBy("frame_idx"))).where("last IS NOT NULL")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    a, b = F.col("vec"), F.col("last")
    dot = lambda x, y: total(F.zip_with(x, y, lambda p, q: p * q))
    n = F.size(a)
    q = v.select("clip", "frame_idx", n.alias("n"), total(a).alias("sa"), total(b).alias("sb"), dot(a, a).alias("aa"), dot(b, b).alias("bb"), dot(a, b).alias("ab"))
    c = F.expr("(n * ab - sa * sb) / (sqrt(n * aa - sa * sa) * sqrt(n * bb - sb * sb))")
    return q.select("clip", "frame_idx", F.round(c, 5).alias("continuity"))


@query(f"WITH {S_SQL}, {MERGED.format(k='clip, category', gap=0)}, u AS (SELECT clip, category, min(t_us) AS a, max(end_us) AS b, count(*) AS n FROM i GROUP BY clip, category, isl), t AS (SELECT clip, category, CAST(sum(n) AS BIGINT) AS spans, CAST(sum(b - a) AS BIGINT) AS covered FROM u GROUP BY ALL) SELECT *, spans >= 3 OR spans >= 2 AND covered / {720 * HOUR}.0 >= 0.15 AS intermittent FROM t")
def intermittent_flag(spark, sf):
    u = islands.union_length(d.spans(spark, sf), ["clip", "category"], "t_us", "end_us")
    share = F.col("covered") / F.lit(720.0 * HOUR)
    return u.select("clip", "category", "spans", "covered", ((F.col("spans") >= 3) | (F.col("spans") >= 2) & (share >= 0.15)).alias("intermittent"))


@query(f"WITH {E_SQL} SELECT clip, CASE WHEN grouping(category) = 1 THEN 'all' ELSE category END AS category, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents, max(cents) AS top FROM e GROUP BY GROUPING SETS ((clip, category), (clip))")
def category_totals(spark, sf):
    """Per category and over all categories in one pass, as scores are reported."""
    e = d.events(spark, sf).rollup("clip", "category").agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"), F.max("cents").alias("top"), F.grouping("category").alias("g"), F.grouping("clip").alias("gc"))
    return e.where("gc = 0").select("clip", F.when(F.col("g") == 1, "all").otherwise(F.col("category")).alias("category"), "n", "cents", "top")


@query(f"WITH {E_SQL}, x AS (SELECT clip, t_us // {24 * HOUR} AS day, coalesce(max(cents) FILTER (category = 'click'), 0) / 30000.0::DOUBLE AS au, coalesce(max(cents) FILTER (category = 'view'), 0) / 30000.0::DOUBLE AS vi, bool_or(category = 'error') AS ctx FROM e GROUP BY ALL), y AS (SELECT *, greatest(au, vi, 0.7::DOUBLE * au + 0.3::DOUBLE * vi) AS base FROM x), z AS (SELECT clip, day, CASE WHEN ctx THEN least(1.0::DOUBLE, base * 1.05::DOUBLE) ELSE base END AS s FROM y) SELECT clip, day, round(s, 6) AS score FROM z WHERE s >= 0.35")
def weighted_score(spark, sf):
    """Two sources' scores under weights, raised a little where a context token stands, over a threshold."""
    e = d.events(spark, sf)
    top = lambda c: F.coalesce(F.max(F.when(F.col("category") == c, F.col("cents"))), F.lit(0)) / F.lit(30000.0)
    x = e.groupBy("clip", F.floor(F.col("t_us") / F.lit(24 * HOUR)).alias("day")).agg(top("click").alias("au"), top("view").alias("vi"), F.bool_or(F.col("category") == "error").alias("ctx"))
    base = F.greatest("au", "vi", F.lit(0.7) * F.col("au") + F.lit(0.3) * F.col("vi"))
    s = x.withColumn("s", F.when(F.col("ctx"), F.least(F.lit(1.0), base * 1.05)).otherwise(base)).where("s >= 0.35D")
    return s.select("clip", "day", F.round("s", 6).alias("score"))


@query(f"WITH {E_SQL}, r AS (SELECT clip, min(t_us) AS lo, max(t_us) AS hi FROM e GROUP BY clip), w AS (SELECT clip, lo, hi, unnest(range(lo + {HOUR * 12}, hi + 1, {HOUR * 24})) AS centre FROM r) SELECT clip, centre, greatest(lo, centre - {HOUR * 18}) AS start_us, least(hi, centre + {HOUR * 18}) AS end_us FROM w")
def uniform_windows(spark, sf):
    r = d.events(spark, sf).groupBy("clip").agg(F.min("t_us").alias("lo"), F.max("t_us").alias("hi")).where(F.col("lo") + 12 * HOUR <= F.col("hi"))
    w = r.withColumn("centre", F.explode(F.sequence(F.col("lo") + 12 * HOUR, F.col("hi"), F.lit(24 * HOUR))))
    return w.select("clip", "centre", F.greatest("lo", F.col("centre") - 18 * HOUR).alias("start_us"), F.least("hi", F.col("centre") + 18 * HOUR).alias("end_us"))


@query(f"WITH {G_SQL}, q AS (SELECT clip, quantile_cont(value, 0.28) AS q28, max(value) AS top FROM g GROUP BY clip), n AS (SELECT clip, frame_idx, CASE WHEN top > 0 THEN value / top ELSE 0.0::DOUBLE END AS v, CASE WHEN top > 0 THEN least(q28 / top, 0.15::DOUBLE) ELSE 0.0::DOUBLE END AS gate FROM g JOIN q USING (clip)) SELECT clip, frame_idx, round(CASE WHEN v < gate THEN 0.0 ELSE pow(v, 0.65) END, 6) AS shape FROM n")
def dynamics_curve(spark, sf):
    """Level over the clip's largest, gated by its lower quantile, to the power 0.65."""
    w = Window.partitionBy("clip")
    g = d.grid(spark, sf).withColumn("q28", F.percentile("value", 0.28).over(w)).withColumn("top", F.max("value").over(w))
    v, gate = (F.when(F.col("top") > 0, x).otherwise(0.0) for x in (F.try_divide("value", "top"), F.least(F.try_divide("q28", "top"), F.lit(0.15))))
    return g.withColumn("v", v).withColumn("gate", gate).select("clip", "frame_idx", F.round(F.when(F.col("v") < F.col("gate"), 0.0).otherwise(F.pow("v", F.lit(0.65))), 6).alias("shape"))


@query(f"WITH {G_SQL}, {ADAPTIVE_SQL} SELECT clip, mode, rhythmic, round(CASE WHEN mode = 'split' THEN split ELSE greatest(0.6::DOUBLE * quiet, 0.3::DOUBLE * mid) END, 6) AS threshold FROM o")
def adaptive_floor(spark, sf):
    return adaptive.adaptive_floor(d.grid(spark, sf), K, "frame_idx", "value").withColumn("threshold", F.round("threshold", 6))


@query(f"WITH {G_SQL}, x AS (SELECT clip, max(frame_idx) AS hi, min(frame_idx) AS lo FROM g GROUP BY clip), p AS (SELECT e.event_id, e.category AS clip, CAST(round_even((e.t_us - (SELECT min(slot) FROM c) * 3600000000) / 3600000000.0::DOUBLE, 0) AS BIGINT) AS i FROM e) SELECT event_id, round(g.value, 6) AS value FROM p JOIN x ON x.clip = p.clip JOIN g ON g.clip = p.clip AND g.frame_idx = greatest(lo, least(hi, p.i))")
def nearest_frame(spark, sf):
    """Each event with the value of the frame nearest to it; the grid is regular, so it is found by number."""
    e, g = d.events(spark, sf), d.grid(spark, sf)
    start = e.agg((F.floor(F.min("t_us") / F.lit(HOUR)) * HOUR).alias("t0"))
    ends = g.groupBy("clip").agg(F.min("frame_idx").alias("lo"), F.max("frame_idx").alias("hi"))
    i = F.bround((F.col("t_us") - F.col("t0")) / F.lit(float(HOUR))).cast("long")
    p = e.crossJoin(F.broadcast(start)).select("event_id", F.col("category").alias("clip"), i.alias("i")).join(ends, "clip")
    return p.withColumn("frame_idx", F.greatest("lo", F.least("hi", "i"))).join(g, ["clip", "frame_idx"]).select("event_id", F.round("value", 6).alias("value"))


@query(f"WITH {G_SQL}, r AS (SELECT *, frame_idx - row_number() OVER (PARTITION BY clip ORDER BY frame_idx) AS run FROM g WHERE value > 0), k AS (SELECT clip, count(*) AS len FROM r GROUP BY clip, run), a AS (SELECT clip, round(100.0::DOUBLE * count(*) FILTER (value > 0) / count(*), 4) AS active_pct, round(quantile_cont(value, 0.5) FILTER (value > 0), 6) AS median, round(avg(value) FILTER (value > 0), 6) AS mean FROM g GROUP BY clip), n AS (SELECT clip, count(*) AS runs, max(len) AS longest FROM k GROUP BY clip) SELECT * FROM a JOIN n USING (clip)")
def track_summary(spark, sf):
    g = d.grid(spark, sf)
    on = F.when(F.col("value") > 0, F.col("value"))
    a = g.groupBy("clip").agg(F.round(F.lit(100.0) * F.count(on) / F.count(F.lit(1)), 4).alias("active_pct"), F.round(F.percentile(on, 0.5), 6).alias("median"), F.round(F.avg(on), 6).alias("mean"))
    runs = islands.flag_runs(g, K, "frame_idx", F.col("value") > 0).groupBy("clip", "run").agg(F.count(F.lit(1)).alias("len"))
    return a.join(runs.groupBy("clip").agg(F.count(F.lit(1)).alias("runs"), F.max("len").alias("longest")), "clip")


# Labels, rules, rows


@query("""WITH l AS (SELECT trim(lower(p_type)) AS n FROM part), c(category, ord, label) AS (VALUES %s)
SELECT n AS label, (SELECT arg_min(category, ord) FROM c WHERE contains(n, label) OR contains(label, n)) AS category, count(*) AS parts FROM l GROUP BY n""" % ", ".join(f"('{c}', {i}, '{x.lower()}')" for i, (c, _, ls) in enumerate(labels.CATEGORIES) for x in ls))
def label_match(spark, sf):
    t = table(spark, sf, "part").withColumn("label", labels.normalize_label(F.col("p_type")))
    return t.groupBy("label").agg(F.count(F.lit(1)).alias("parts")).withColumn("category", labels.label_category(F.col("label")))


@query("WITH r AS (SELECT event_id, 'Vehicle, ' || event_type || ',engine start, vehicle,Car-Crash' AS reply FROM events) SELECT event_id, ['vehicle', 'engine_start', 'car_crash'] AS categories FROM r")
def parse_reply(spark, sf):
    reply = F.concat(F.lit("Vehicle, "), F.col("event_type"), F.lit(",engine start, vehicle,Car-Crash"))
    return table(spark, sf, "events").select("event_id", labels.parse_reply(reply).alias("categories"))


@query(f"""WITH {E_SQL}, w AS (SELECT clip, t_us // {24 * HOUR} AS win, coalesce(max(cents) FILTER (category = 'click'), 0) / 100.0 AS li, coalesce(max(cents) FILTER (category = 'view'), 0) / 100.0 AS ra, coalesce(sum(cents) FILTER (category = 'purchase'), 0) / 100.0 AS au FROM e GROUP BY ALL),
k AS (SELECT *, CASE WHEN li > 30 AND au > 100 THEN 'thunder_both' WHEN li > 120 THEN 'thunder_visual' WHEN ra > 40 THEN 'rain' WHEN au > 16 THEN 'audio' ELSE 'none' END AS kind FROM w),
v AS (SELECT *, CASE WHEN kind LIKE 'thunder%' THEN 255 WHEN kind = 'rain' THEN CAST(floor(ra) AS INT) WHEN kind = 'audio' THEN CAST(floor(au) AS INT) ELSE 0 END AS lv FROM k)
SELECT clip, win, CASE WHEN lv < 16 THEN 'none' ELSE kind END AS type, CASE WHEN lv < 16 THEN 0 ELSE lv END AS intensity FROM v""")
def rule_windows(spark, sf):
    e = d.events(spark, sf)
    of = lambda f, c: F.coalesce(f(F.when(F.col("category") == c, F.col("cents"))), F.lit(0)) / 100.0
    w = e.groupBy("clip", F.floor(F.col("t_us") / F.lit(24 * HOUR)).alias("win")).agg(of(F.max, "click").alias("li"), of(F.max, "view").alias("ra"), of(F.sum, "purchase").alias("au"))
    return w.select("clip", "win", labels.rule_window(F.col("li"), F.col("ra"), F.col("au"), 30, 120, 40).alias("r")).select("clip", "win", "r.type", "r.intensity")


@query(f"WITH {S_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY clip ORDER BY t_us, event_id) AS rn FROM s) SELECT clip, format('event_{{:03d}}', rn) AS event_name, category, round(t_us / 1e6, 3) AS start_sec, round(end_us / 1e6, 3) AS end_sec, category IN ('click', 'error') AS impulsive FROM o WHERE category != 'view'")
def event_rows(spark, sf):
    w = Window.partitionBy("clip").orderBy("t_us", "event_id")
    s = d.spans(spark, sf).withColumn("rn", F.row_number().over(w)).where("category != 'view'")
    sec = lambda c: F.round(F.col(c) / 1e6, 3)
    return s.select("clip", F.format_string("event_%03d", "rn").alias("event_name"), "category", sec("t_us").alias("start_sec"), sec("end_us").alias("end_sec"), F.col("category").isin("click", "error").alias("impulsive"))


@query("SELECT user_id AS clip, list_sort(list(DISTINCT event_type)) AS sources FROM events GROUP BY user_id")
def set_union_sources(spark, sf):
    return d.events(spark, sf).groupBy("clip").agg(F.array_sort(F.collect_set("category")).alias("sources"))


@query("(SELECT DISTINCT user_id AS clip FROM events WHERE event_type = 'purchase' AND value > 100) INTERSECT (SELECT DISTINCT user_id FROM events WHERE event_type = 'click' AND value > 100)")
def category_intersect(spark, sf):
    e = d.events(spark, sf).where("cents > 10000")
    return e.where("category = 'purchase'").select("clip").intersect(e.where("category = 'click'").select("clip"))


@query("(SELECT DISTINCT user_id AS clip FROM events WHERE event_type = 'purchase' AND value > 100) EXCEPT (SELECT DISTINCT user_id FROM events WHERE event_type = 'click' AND value > 100)")
def category_except(spark, sf):
    e = d.events(spark, sf).where("cents > 10000")
    return e.where("category = 'purchase'").select("clip").subtract(e.where("category = 'click'").select("clip"))


# Rendering


@query(f"WITH {S_SQL}, {SPAN_PAIR}, x AS (SELECT DISTINCT clip, unnest(range(t_us // {HOUR}, (end_us - 1) // {HOUR} + 1)) AS hour FROM a WHERE end_us > t_us) SELECT clip, count(*) AS hours, min(hour) AS first_hour, max(hour) AS last_hour FROM x GROUP BY clip")
def event_mask(spark, sf):
    a, _ = span_pair(spark, sf)
    at = lambda c: F.floor(c / F.lit(HOUR)).cast("long")
    x = a.where("end_us > t_us").select("clip", F.explode(F.sequence(at(F.col("t_us")), at(F.col("end_us") - 1))).alias("hour")).distinct()
    return x.groupBy("clip").agg(F.count(F.lit(1)).alias("hours"), F.min("hour").alias("first_hour"), F.max("hour").alias("last_hour"))


@query(f"WITH {G_SQL} SELECT clip, frame_idx, round(CASE WHEN max(abs(value)) OVER (PARTITION BY clip) > 0 THEN value / max(abs(value)) OVER (PARTITION BY clip) * 0.9::DOUBLE ELSE value END, 6) AS value FROM g")
def peak_normalize(spark, sf):
    top = F.max(F.abs("value")).over(Window.partitionBy("clip"))
    return d.grid(spark, sf).select("clip", "frame_idx", F.round(F.when(top > 0, F.col("value") / top * 0.9).otherwise(F.col("value")), 6).alias("value"))


@query(f"WITH {G_SQL}, x AS (SELECT DISTINCT category AS clip, unnest(range(t_us // {HOUR} - (SELECT min(slot) FROM c), (t_us + cents * 60000) // {HOUR} - (SELECT min(slot) FROM c) + 1)) AS frame_idx FROM e WHERE cents > 20000) SELECT clip, frame_idx, round(CASE WHEN x.clip IS NULL THEN 0.0 ELSE value END, 6) AS value FROM g LEFT JOIN x USING (clip, frame_idx)")
def gated_signal(spark, sf):
    """The signal under spans of its clip, 0 elsewhere: spans are dealt to frames, so the gate is a join by frame."""
    e, g = d.events(spark, sf), d.grid(spark, sf)
    hour = lambda c: F.floor(c / F.lit(HOUR)).cast("long")
    start = e.agg(hour(F.min("t_us")).alias("h0"))
    spans = e.where("cents > 20000").crossJoin(F.broadcast(start))
    mask = spans.select(F.col("category").alias("clip"), F.explode(F.sequence(hour(F.col("t_us")) - F.col("h0"), hour(F.col("t_us") + F.col("cents") * 60000) - F.col("h0"))).alias("frame_idx")).distinct()
    on = g.join(mask.withColumn("on", F.lit(True)), ["clip", "frame_idx"], "left")
    return on.select("clip", "frame_idx", F.round(F.when(F.col("on"), F.col("value")).otherwise(0.0), 6).alias("value"))


@query(f"WITH {G_SQL}, k AS (SELECT clip, frame_idx, value AS v, CASE WHEN frame_idx % 4 = 0 THEN value END AS kv, CASE WHEN frame_idx % 4 = 0 THEN frame_idx END AS ki FROM g), n AS (SELECT clip, frame_idx, last_value(kv IGNORE NULLS) OVER b AS v0, last_value(ki IGNORE NULLS) OVER b AS i0, first_value(kv IGNORE NULLS) OVER f AS v1, first_value(ki IGNORE NULLS) OVER f AS i1 FROM k WINDOW b AS (PARTITION BY clip ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY clip ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT clip, frame_idx, round(CASE WHEN i1 IS NULL OR i1 = i0 THEN v0 ELSE v0 + (v1 - v0) * (frame_idx - i0) / (i1 - i0) END, 6) AS value FROM n")
def interpolate_curve(spark, sf):
    """Straight lines between every fourth frame; after the last of them its value."""
    w = Window.partitionBy("clip").orderBy("frame_idx")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    knot = F.when(F.col("frame_idx") % 4 == 0, F.struct(F.col("frame_idx").alias("i"), F.col("value").alias("v")))
    n = d.grid(spark, sf).withColumn("k", knot).withColumn("a", F.last("k", True).over(back)).withColumn("b", F.first("k", True).over(ahead))
    flat = F.col("b").isNull() | (F.col("a.i") == F.col("b.i"))
    line = F.col("a.v") + (F.col("b.v") - F.col("a.v")) * (F.col("frame_idx") - F.col("a.i")) / F.when(~flat, F.col("b.i") - F.col("a.i"))
    return n.select("clip", "frame_idx", F.round(F.when(flat, F.col("a.v")).otherwise(line), 6).alias("value"))


@query(f"WITH {G_SQL}, l AS (SELECT *, lag(value) OVER w AS a, lead(value) OVER w AS b FROM g WINDOW w AS (PARTITION BY clip ORDER BY frame_idx)), k AS (SELECT * FROM l WHERE value >= a AND value >= b AND value > 0), h AS (SELECT e.event_id, k.frame_idx, k.value, max(k.value) OVER (PARTITION BY e.event_id) AS top FROM e JOIN k ON k.clip = e.category AND abs(k.frame_idx - (e.t_us // {HOUR} - (SELECT min(slot) FROM c))) <= 3 WHERE e.cents > 15000) SELECT event_id, min(frame_idx) AS attack_idx, round(max(top), 6) AS loudest FROM h WHERE value >= 0.65::DOUBLE * top GROUP BY event_id")
def snap_to_attack(spark, sf):
    """Each strong event at the earliest local maximum near it that has at least 0.65 of the loudest one's level."""
    w = Window.partitionBy("clip").orderBy("frame_idx")
    g = d.grid(spark, sf).withColumn("a", F.lag("value").over(w)).withColumn("b", F.lead("value").over(w))
    peaks = g.where("value >= a AND value >= b AND value > 0").select("clip", F.col("frame_idx").alias("p_idx"), "value")
    e = d.events(spark, sf)
    hour = lambda c: F.floor(c / F.lit(HOUR)).cast("long")
    at = e.where("cents > 15000").crossJoin(F.broadcast(e.agg(hour(F.min("t_us")).alias("h0")))).select("event_id", F.col("category").alias("clip"), (hour(F.col("t_us")) - F.col("h0")).alias("f_idx"))
    near = joins.band_join(at, peaks, K, "f_idx", "p_idx", 3).withColumn("top", F.max("value").over(Window.partitionBy("event_id")))
    return near.where(F.col("value") >= F.lit(0.65) * F.col("top")).groupBy("event_id").agg(F.min("p_idx").alias("attack_idx"), F.round(F.max("top"), 6).alias("loudest"))


SESSION_SQL = f"WITH {E_SQL}, l AS (SELECT *, lag(t_us) OVER (PARTITION BY clip ORDER BY t_us) AS last FROM e), c AS (SELECT *, sum(CASE WHEN t_us - last <= {3 * HOUR} THEN 0 ELSE 1 END) OVER (PARTITION BY clip ORDER BY t_us ROWS UNBOUNDED PRECEDING) AS isl FROM l) SELECT clip, min(t_us) AS start_us, max(t_us) + {3 * HOUR} AS end_us, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents FROM c GROUP BY clip, isl"


@query(SESSION_SQL)
def session_clusters(spark, sf):
    e = d.events(spark, sf).withColumn("at", F.timestamp_micros("t_us"))
    s = e.groupBy("clip", F.session_window("at", "3 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("cents").alias("cents"))
    return s.select("clip", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "n", "cents")


@query(f"SELECT event_type AS category, epoch_us(ts) // {HOUR} AS hour, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY ALL")
def stream_tumbling(spark, sf):
    return tumbling.hourly_totals(spark, sf)


@query(SESSION_SQL)
def stream_sessions(spark, sf):
    return tumbling.sessions(spark, sf)
