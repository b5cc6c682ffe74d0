"""Scores of detections against references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    return F.round(F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0)), 4)


def with_prf(df: DataFrame) -> DataFrame:
    """Adds precision, recall and f1 to tp, fp and fn; zero where there is nothing to divide by."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return df.select("*", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(tp * 2, tp * 2 + fp + fn).alias("f1"))


def coverage(marks: DataFrame, spans: DataFrame, key: str, t: str, start: str, end: str, tolerance: int, bucket: int) -> DataFrame:
    """Per key the marks and how many of them a span contains, widened by the tolerance."""
    wide = spans.select(F.col(key).alias("__k"), (F.col(start) - tolerance).alias("__s"), (F.col(end) + tolerance).alias("__e"))
    wide = wide.withColumn("__b", F.explode(F.sequence(F.floor(F.col("__s") / bucket), F.floor(F.col("__e") / bucket))))
    m = marks.withColumn("__b", F.floor(F.col(t) / bucket))
    hit = m.join(wide, (m[key] == wide["__k"]) & (m["__b"] == wide["__b"]) & F.col(t).between(F.col("__s"), F.col("__e")), "left_semi")
    n = marks.groupBy(key).agg(F.count(F.lit(1)).alias("n_marks"))
    return n.join(hit.groupBy(key).agg(F.count(F.lit(1)).alias("c")), key, "left").select(key, "n_marks", F.coalesce("c", F.lit(0)).cast("long").alias("covered")).withColumn("recall", ratio(F.col("covered"), F.col("n_marks")))


def references_of_rows(rows: DataFrame) -> DataFrame:
    """clip, category, onset_us, offset_us of rows that name an onset onset_us, start_us or peak_us and an offset offset_us or end_us."""
    return rows.select("clip", "category", F.coalesce("onset_us", "start_us", "peak_us").alias("onset_us"), F.coalesce("offset_us", "end_us").alias("offset_us"))


def references_of_map(rows: DataFrame, marks: str) -> DataFrame:
    """The same of a map from category to onsets for each clip."""
    by = rows.select("clip", F.explode(marks).alias("category", "times"))
    return by.select("clip", "category", F.explode("times").alias("onset_us"), F.lit(None).cast("long").alias("offset_us"))


def onset_of(chosen: Column, start: Column, peak: Column) -> Column:
    return F.coalesce(chosen, start, peak, F.lit(0))


def by_category(hits: DataFrame, dets: DataFrame, ref: str, det: str) -> DataFrame:
    """hits: category, ref, det (null for a miss). Scores of each category and, as `micro`, of all; macro_f1 is the mean of the
    categories' and stands in the micro row."""
    h = hits.groupBy("category").agg(F.count(F.lit(1)).alias("refs"), F.count(det).alias("tp"), F.sum(F.abs(F.col(det) - F.col(ref))).alias("err"))
    n = dets.groupBy("category").agg(F.count(F.lit(1)).alias("dets"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    q = h.join(n, "category", "full").select("category", zero("tp").alias("tp"), (zero("dets") - zero("tp")).alias("fp"), (zero("refs") - zero("tp")).alias("fn"), zero("err").alias("err"))
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "fn", "err")]
    each = with_prf(q)
    micro = with_prf(q.agg(*sums).withColumn("category", F.lit("micro"))).crossJoin(F.broadcast(each.agg(F.round(F.avg("f1"), 4).alias("macro_f1"))))
    out = each.withColumn("macro_f1", F.lit(None).cast("double")).unionByName(micro)
    return out.withColumn("mean_error_sec", F.round(F.try_divide(F.col("err").cast("double"), F.col("tp")) / 1e6, 3)).drop("err")


def span_distance(marks: DataFrame, spans: DataFrame, key: str, t: str, start: str, end: str) -> DataFrame:
    """marks with `distance` to the nearest span of their key, 0 inside one, null without any.

    Marks and starts are one series by time: the largest end so far and the next start give the distance, at any reach and
    without pairs.
    """
    rest = [c for c in marks.columns if c != key]
    a = marks.select(key, F.col(t).alias("__t"), F.lit(1).alias("__m"), F.lit(None).cast("long").alias("__e"), F.struct(*rest).alias("__row"))
    b = spans.select(key, F.col(start).alias("__t"), F.lit(0).alias("__m"), F.col(end).cast("long").alias("__e"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("__t", "__m")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    next_ = F.min(F.when(F.col("__m") == 0, F.col("__t"))).over(ahead)
    far = both.withColumn("__a", F.greatest(F.lit(0), F.col("__t") - F.max("__e").over(back))).withColumn("__b", next_ - F.col("__t"))
    none = F.max("__e").over(back).isNull()
    far = far.withColumn("__a", F.when(~none, F.col("__a")))
    return far.where("__m = 1").select(key, *[F.col(f"__row.{c}").alias(c) for c in rest], F.least("__a", "__b").cast("long").alias("distance"))


def coverage_of(far: DataFrame, spans: DataFrame, key: str, start: str, end: str, tolerance: int, duration: int) -> DataFrame:
    """Per key marks, covered ones, recall, spans, their summed length and its share of the duration."""
    x = far.groupBy(key).agg(F.count(F.lit(1)).alias("n_marks"), F.count(F.when(F.col("distance") <= tolerance, 1)).alias("covered"))
    y = spans.groupBy(key).agg(F.count(F.lit(1)).alias("n_spans"), F.sum(F.greatest(F.lit(0), F.col(end) - F.col(start))).alias("active_us"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = x.join(y, key, "full").select(key, *map(zero, ("n_marks", "covered", "n_spans", "active_us")))
    return out.withColumn("recall", ratio(F.col("covered"), F.col("n_marks"))).withColumn("active_fraction", F.round(F.col("active_us") / F.lit(float(duration)), 4))


def gate_of(settings: DataFrame, named: list[str] | None) -> DataFrame:
    """Categories of the gate: those named, none of them too, or without a list the flagged ones."""
    return settings.where(F.col("in_gate") if named is None else F.col("category").isin(named)).select("category")
