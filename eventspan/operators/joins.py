"""Joins on nearness and overlap. All meet by equality of key and time bucket, so none is a nested loop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def band_join(left: DataFrame, right: DataFrame, keys: list[str], left_t: str, right_t: str, reach: int, how: str = "inner") -> DataFrame:
    """Pairs with |left_t - right_t| <= reach (integer times). The right side is put into its bucket and both neighbours."""
    at = lambda c: F.floor(F.col(c) / F.lit(reach)).cast("long")
    l = left.withColumn("__b", at(left_t))
    r = right.withColumn("__b", F.explode(F.array(at(right_t) - 1, at(right_t), at(right_t) + 1)))
    for k in keys:
        r = r.withColumnRenamed(k, f"__r_{k}")
    on = [F.col(k) == F.col(f"__r_{k}") for k in keys] + [l["__b"] == r["__b"], F.abs(F.col(left_t) - F.col(right_t)) <= reach]
    out = l.join(r, on, how)
    return out.drop(*[f"__r_{k}" for k in keys], "__b")


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], ls: str, le: str, rs: str, re_: str, bucket: int, how: str = "inner") -> DataFrame:
    """Pairs of intervals that share more than a point. Both sides go to every bucket they touch; a pair counts in the bucket
    of the later start only, so it appears once."""
    at = lambda c: F.floor(F.col(c) / F.lit(bucket)).cast("long")
    l = left.withColumn("__b", F.explode(F.sequence(at(ls), at(le))))
    r = right.withColumn("__b", F.explode(F.sequence(at(rs), at(re_))))
    for k in keys:
        r = r.withColumnRenamed(k, f"__r_{k}")
    on = [F.col(k) == F.col(f"__r_{k}") for k in keys] + [l["__b"] == r["__b"], F.col(ls) < F.col(re_), F.col(rs) < F.col(le), l["__b"] == F.greatest(at(ls), at(rs))]
    return l.join(r, on, how).drop(*[f"__r_{k}" for k in keys], "__b")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, left_t: str, right_t: str, reach: int, take: list[str]) -> DataFrame:
    """Each left row with the nearest right row within reach, the earlier of equals; nulls where there is none."""
    pairs = band_join(left.select(*keys, left_id, left_t), right, keys, left_t, right_t, reach)
    best = pairs.groupBy(left_id).agg(F.min(F.struct(F.abs(F.col(left_t) - F.col(right_t)).alias("dist"), F.col(right_t).alias("t"), *[F.col(c).alias(c) for c in take])).alias("__best"))
    return left.join(best, left_id, "left").select("*", F.col("__best.dist").alias("dist"), *[F.col(f"__best.{c}").alias(f"near_{c}") for c in take]).drop("__best")


def best_near(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, left_t: str, right_t: str, reach: int, score: str, order: list[Column]) -> DataFrame:
    """The largest score near each left row; of equals the first in `order`."""
    pairs = band_join(left, right, keys, left_t, right_t, reach)
    return pairs.groupBy(*keys, left_id).agg(F.min(F.struct((-F.col(score)).alias("s"), *order)).alias("b"))


def nearest_any(left: DataFrame, right: DataFrame, key: str, left_t: str, right_t: str, order: list[Column]) -> DataFrame:
    """left with `nearest`: struct of dist, t and the `order` columns of the nearest right row of its key, at any distance; null
    without any. Of equals the earlier, then the first in `order`.

    Both sides are one series by time: the last right row up to a left one and the first from it on are all that can be nearest.
    """
    rest = [c for c in left.columns if c != key]
    a = left.select(key, F.col(left_t).alias("__t"), F.struct(*rest).alias("__row"))
    r = right.groupBy(key, F.col(right_t).alias("__t")).agg(F.min(F.struct(F.col(right_t).alias("t"), *order)).alias("__r"))
    both = a.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("__t")
    back = F.last("__r", True).over(w.rangeBetween(Window.unboundedPreceding, 0))
    ahead = F.first("__r", True).over(w.rangeBetween(0, Window.unboundedFollowing))
    x = both.withColumn("__a", back).withColumn("__b", ahead).where("__row IS NOT NULL")
    names = [f.name for f in r.schema["__r"].dataType.fields]
    far = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(f"{c}.t") - F.col("__t")).alias("dist"), *[F.col(f"{c}.{n}").alias(n) for n in names]))
    return x.select(key, *[F.col(f"__row.{c}").alias(c) for c in rest], F.least(far("__a"), far("__b")).alias("nearest"))
