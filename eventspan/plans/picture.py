"""Queries on flashes, fires and shake. The hourly means stand for warmth; an hour without events is a cut."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import folds, picture
from . import derived as d
from .derived import G_SQL, V_SQL
from .gating import event_frames, event_frames_sql
from .registry import K, query

FLASH_SQL = f"""{G_SQL},
fr AS (SELECT *, value - coalesce(lag(value) OVER w, value) AS rise, lead(value) OVER w AS nxt FROM g WINDOW w AS (PARTITION BY clip ORDER BY frame_idx)),
fc AS (SELECT *, last_value(CASE WHEN value < 15 THEN (frame_idx, nxt) END IGNORE NULLS) OVER (PARTITION BY clip ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cut FROM fr),
fk AS (SELECT clip, list_reduce(list([frame_idx] ORDER BY rise DESC, frame_idx DESC), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: abs(y - x[1]) < 4)) > 0 THEN acc ELSE list_concat(acc, x) END) AS kept
  FROM fc WHERE rise >= 15 AND value >= 60 AND NOT coalesce(cut[1] >= frame_idx - 3 AND cut[2] >= 60, false) GROUP BY clip),
flash AS (SELECT clip, unnest(kept) AS at_idx FROM fk)"""
FIRE_SQL = f"""{FLASH_SQL},
fh AS (SELECT clip, at_idx, frame_idx, CASE WHEN frame_idx - coalesce(lag(frame_idx) OVER (PARTITION BY clip, at_idx ORDER BY frame_idx), at_idx) > 3 THEN 1 ELSE 0 END AS far FROM flash JOIN g USING (clip) WHERE frame_idx BETWEEN at_idx AND at_idx + 12 AND value >= 50),
fs AS (SELECT *, sum(far) OVER (PARTITION BY clip, at_idx ORDER BY frame_idx ROWS UNBOUNDED PRECEDING) AS gone FROM fh),
fire AS (SELECT flash.clip, flash.at_idx, coalesce(max(frame_idx) FILTER (gone = 0), flash.at_idx) AS end_idx FROM flash LEFT JOIN fs ON fs.clip = flash.clip AND fs.at_idx = flash.at_idx GROUP BY flash.clip, flash.at_idx)"""


def flash_rows(spark, sf):
    return picture.flashes(d.grid(spark, sf), K, "frame_idx", "value", 15.0, 60.0, F.col("value") < 15, 3, 4).select("clip", F.col("frame_idx").alias("at_idx"))


def fire_rows(spark, sf):
    return picture.fire_spans(flash_rows(spark, sf), d.grid(spark, sf), K, "at_idx", "frame_idx", "value", 50.0, 12, 2)


@query(f"WITH {FLASH_SQL} SELECT clip, at_idx FROM flash")
def flash_onsets(spark, sf):
    return flash_rows(spark, sf)


@query(f"WITH {FIRE_SQL} SELECT * FROM fire")
def fireball_spans(spark, sf):
    return fire_rows(spark, sf)


@query(f"""WITH {FIRE_SQL}, {event_frames_sql(5000)}, ev AS (SELECT *, event_id % 3 = 0 AS flash FROM ef),
pa AS (SELECT fire.clip, fire.at_idx, end_idx, max((cents, -ev.at_idx)) AS p FROM fire JOIN ev ON ev.clip = fire.clip AND ev.flash AND abs(ev.at_idx - fire.at_idx) <= 2 GROUP BY ALL)
SELECT DISTINCT event_id FROM pa JOIN ev ON ev.clip = pa.clip AND NOT ev.flash AND ev.at_idx BETWEEN pa.at_idx AND end_idx AND ev.at_idx + p[2] >= 1 AND cents < p[1]""")
def decay_inside_span(spark, sf):
    ev = event_frames(spark, sf, 5000).withColumn("flash", F.col("event_id") % 3 == 0).withColumnRenamed("at_idx", "t")
    return picture.fading(ev, fire_rows(spark, sf), K, "event_id", "t", "cents", "flash", "at_idx", "end_idx", 2, 1)


@query(f"""WITH RECURSIVE {FLASH_SQL}, {event_frames_sql(15000)}, av AS (SELECT clip, at_idx, min(event_id) AS event_id FROM ef GROUP BY ALL), af AS (SELECT clip, at_idx, row_number() OVER (PARTITION BY clip ORDER BY at_idx) AS rn FROM flash), al AS (SELECT clip, list(at_idx) AS ts FROM av GROUP BY clip),
st AS (SELECT DISTINCT af.clip, 0::BIGINT AS rn, NULL::BIGINT AS flash_idx, NULL::BIGINT AS ev_idx, coalesce(ts, []::BIGINT[]) AS free FROM af LEFT JOIN al ON al.clip = af.clip
  UNION ALL SELECT clip, rn, flash_idx, ev_idx, list_filter(free, lambda x: ev_idx IS NULL OR x != ev_idx)
  FROM (SELECT st.clip, af.rn, af.at_idx AS flash_idx, st.free, -list_sort(list_transform(list_filter(st.free, lambda x: abs(x - af.at_idx) <= 2), lambda x: {{'d': abs(x - af.at_idx), 'x': -x}}))[1].x AS ev_idx FROM st JOIN af ON af.clip = st.clip AND af.rn = st.rn + 1)),
hit AS (SELECT clip, flash_idx, ev_idx FROM st WHERE rn > 0)
SELECT coalesce(hit.clip, av.clip) AS clip, coalesce(flash_idx, at_idx) AS peak_idx, event_id, CASE WHEN flash_idx IS NULL THEN 'kept' WHEN event_id IS NULL THEN 'added' ELSE 'moved' END AS what FROM hit FULL JOIN av ON av.clip = hit.clip AND av.at_idx = ev_idx""")
def flash_align(spark, sf):
    """Flashes in time order each take the nearest unused strong event within two frames; a flash without one makes an event of
    its own and events without a flash stay."""
    ev = event_frames(spark, sf, 15000).groupBy("clip", "at_idx").agg(F.min("event_id").alias("event_id"))
    pairs = folds.one_to_one(flash_rows(spark, sf).withColumnRenamed("at_idx", "flash_idx"), ev.select("clip", F.col("at_idx").alias("ev_idx")), "clip", "flash_idx", "ev_idx", 2, later=True)
    all_ = pairs.join(ev.withColumnRenamed("at_idx", "ev_idx"), ["clip", "ev_idx"], "full")
    kind = F.when(F.col("flash_idx").isNull(), "kept").when(F.col("event_id").isNull(), "added").otherwise("moved")
    return all_.select("clip", F.coalesce("flash_idx", "ev_idx").alias("peak_idx"), "event_id", kind.alias("what"))


@query(f"""WITH {V_SQL}, b0 AS (SELECT clip, row_number() OVER (PARTITION BY clip ORDER BY frame_idx) - 1 AS i, vec[1] AS x, vec[2] AS y, abs(vec[3]) > 0.25 AS cut FROM v),
b1 AS (SELECT clip, i, cut, coalesce(last_value(CASE WHEN NOT cut THEN x END IGNORE NULLS) OVER w, 0) AS x, coalesce(last_value(CASE WHEN NOT cut THEN y END IGNORE NULLS) OVER w, 0) AS y FROM b0 WINDOW w AS (PARTITION BY clip ORDER BY i ROWS UNBOUNDED PRECEDING)),
hi AS (SELECT clip, max(i) AS hi FROM b1 GROUP BY clip),
p1 AS (SELECT b1.clip, b1.i, avg(q.x) AS mx, avg(q.y) AS my FROM b1 JOIN hi USING (clip), unnest(range(-2, 3)) AS o(k) JOIN b1 q ON q.clip = b1.clip AND q.i = greatest(0, least(hi.hi, b1.i + o.k)) GROUP BY b1.clip, b1.i),
sq AS (SELECT clip, i, CASE WHEN cut THEN 0 ELSE (x - mx) * (x - mx) + (y - my) * (y - my) END AS s FROM b1 JOIN p1 USING (clip, i)),
p2 AS (SELECT sq.clip, sq.i, avg(q.s) AS s FROM sq JOIN hi USING (clip), unnest(range(-1, 2)) AS o(k) JOIN sq q ON q.clip = sq.clip AND q.i = greatest(0, least(hi.hi, sq.i + o.k)) GROUP BY sq.clip, sq.i)
SELECT clip, i AS frame_idx, round(sqrt(s), 5) AS strength FROM p2""")
def shake_strength(spark, sf):
    v = d.vectors(spark, sf).select("clip", (F.row_number().over(Window.partitionBy("clip").orderBy("frame_idx")) - 1).cast("long").alias("frame_idx"), F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y"), (F.abs(F.col("vec")[2]) > 0.25).alias("cut"))
    return picture.shake(v, K, "frame_idx", ["x", "y"], "cut", 5, 3).select("clip", "frame_idx", F.round("strength", 5).alias("strength"))
