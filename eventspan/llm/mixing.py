"""Mixing sources to target weights with an exact word budget for each source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, join_shared, n_words, row_key

WEIGHTS = (3.0, 1.0, 2.0)
BUCKET_ROWS = 5_000


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes: a row per source with skey, source, source_size. Adds target.

    Sources by code point, null last, weigh `weights` in turn and share `share` of all sizes. No target exceeds `most` times
    its source's size; the excess is reshared by weight until none does. That has a closed form: with sources ordered by
    limit over weight, the first k are at their limits and the others get one common rate; the rate is the first that is
    below the next source's ratio. One row per source is all that the unpartitioned windows see.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*map(F.lit, weights)), turn.cast("int") + 1)
    up = Window.orderBy("ratio", "skey")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    w = (
        sizes.withColumn("weight", weight)
        .withColumn("limit_", F.col("source_size") * most)
        .withColumn("ratio", F.col("limit_") / F.col("weight"))
        .withColumn("left_", F.sum("source_size").over(everything) * share - F.coalesce(F.sum("limit_").over(before), F.lit(0.0)))
        .withColumn("weights_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("rate", F.col("left_") / F.col("weights_left"))
    )
    rate = F.min(F.when(F.col("rate") <= F.col("ratio"), F.struct("ratio", "skey", "rate"))).over(everything)["rate"]
    return w.withColumn("target", F.least("limit_", F.coalesce(rate * F.col("weight"), F.col("limit_")))).select("skey", "source_size", "target")


def mix(docs: DataFrame, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, text_hash.

    Each row gets a hash-random key. Rows are dealt by source and by equal ranges of the key, as many as the source has rows for, sorted there, and a prefix sum
    runs inside each range; the sums of the ranges before it come from one small row per source and range. The source's
    whole words of target are cut exactly: whole epochs first, then rows in key order, the last one in part. A source of any
    size is spread over as many ranges as it has rows for, so none of it meets in one task.

    Null text has size 0; a null source is a source of its own, after the others; a null id has the key of an empty id.
    Repeated rows are told apart by size and text hash only, equal ones are interchangeable. Empty tables give no rows. Only
    the three columns are read. Reruns give the same rows: keys depend on the id and the seed alone.
    """
    text = F.col(text_col)
    slim = cut(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            n_words(text).alias("size"),
            row_key(id_col, text_col)[1].alias("text_hash"),
            F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary")).alias("key"),
        ),
        "mix",
    )
    slim = slim.withColumn("skey", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    large = slim.groupBy("skey").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket_rows)
    large = large.select("skey", F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n") / bucket_rows))).cast("long").alias("ranges"), "n")
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.coalesce("ranges", F.lit(1)) / F.lit(2**32)
    slim = join_shared(slim, large, "skey").withColumn("range_", F.floor(place)).drop("ranges")
    parts = slim.groupBy("skey", "range_").agg(F.sum("size").alias("part"), F.first("source").alias("source"))
    sources = targets(parts.groupBy("skey").agg(F.sum("part").alias("source_size"), F.first("source").alias("source")), weights, share, most)
    ahead = Window.partitionBy("skey").orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("ahead", F.coalesce(F.sum("part").over(ahead), F.lit(0))).join(sources, "skey").select("skey", "range_", "ahead", "source_size", "target")
    inside = Window.partitionBy("skey", "range_").orderBy("key", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    taken = F.col("size") * epochs + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    return slim.join(parts, ["skey", "range_"]).withColumn("before", before).select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "text_hash")


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixture itself: each row as often as the mix takes it, whole, and the last one of a source in part, cut after a
    word. All columns as they are, whatever their names, but the text of a row in part. Rows of which nothing is taken go, rows without words too
    (null and empty texts). Rows with equal id and text count as one that is taken for all of them. An empty table gives no rows."""
    k1, k2, turn, size, taken, copy = fresh(docs.columns, "k1", "k2", "turn", "size", "taken", "copy")
    key = row_key(id_col, text_col)
    plan = mix(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options).where("taken > 0")
    plan = plan.groupBy(F.coalesce("doc_id", F.lit(2**63 - 1)).alias(k1), F.col("text_hash").alias(k2)).agg(F.max("size").alias(size), F.sum("taken").alias(taken))
    one = docs.withColumn(k1, key[0]).withColumn(k2, key[1]).withColumn(turn, F.row_number().over(Window.partitionBy(k1, k2).orderBy(F.col(id_col)))).where(F.col(turn) == 1)
    rows = one.join(plan, [k1, k2]).withColumn(copy, F.explode(F.sequence(F.lit(1), F.ceil(F.col(taken) / F.col(size)).cast("int"))))
    rest = F.col(taken) - (F.col(copy) - 1) * F.col(size)
    part = F.array_join(F.slice(F.regexp_extract_all(F.col(text_col), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.greatest(rest, F.lit(1)).cast("int")), "")
    return rows.select(*[F.when(rest < F.col(size), part).otherwise(F.col(text_col)).alias(c) if c == text_col else F.col(c) for c in docs.columns])


SQL = """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
                  md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM d GROUP BY source),
r AS (SELECT *, source_size * 2.0::DOUBLE AS lim, source_size * 2.0::DOUBLE / w AS ratio FROM s),
q AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(lim) OVER (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS rate FROM r),
t AS (SELECT source, source_size, least(lim, coalesce((SELECT arg_min(rate, ratio) FROM q WHERE rate <= ratio) * w, lim)) AS target FROM q),
o AS (SELECT doc_id, size, source_size, target, CAST(floor(target) AS BIGINT) AS budget,
             CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE size * (budget // source_size) + greatest(0, least(size, budget % source_size - before)) END AS taken FROM o
"""
