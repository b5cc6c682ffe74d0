"""Exact dedup by skew-safe combining."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SALTS, bitmap, cut, join_shared, may_have


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Digests alone are counted first. Texts whose digest may stand twice (see common.may_have) are deduplicated within each task
    (map-side combine), then within salted digest groups, then the salts' winners globally; digest and full content are the key
    each time; the other texts are not moved. No group is gathered: a group is a maximum and a count, so a text that a third of
    all rows share costs one row per task. Rows are then joined to their group by digest, hot digests apart; a digest that two
    different contents share stops the job instead of merging them.

    Null text counts as empty; empty texts are equal to each other; texts of any length are compared whole. The largest id stays;
    null ids never win over others. Of repeated rows (equal id and text) one is kept. If all ids of a group are null, keep_id is
    null and one row is kept. Only the two columns are read, so extra columns can't clash. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keyed = rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    same = cut(keyed.groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("copies")), "digests")
    again = same.groupBy("digest").agg(F.sum("copies").alias("n")).where("n > 1")
    twice = may_have(keyed.withColumn("hash", F.xxhash64("digest")), bitmap(again.select(F.xxhash64("digest"))), "hash").where("__may")
    merge = (F.max("best").alias("best"), F.sum("n").alias("n"))
    local = (
        twice.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .groupBy("digest", "salt", "text")
        .agg(F.max("doc_id").alias("best"), F.count(F.lit(1)).alias("n"))
    )
    classes = local.groupBy("digest", "text").agg(*merge).groupBy("digest").agg(*merge, F.count(F.lit(1)).alias("contents"))
    groups = classes.where("n > 1").select(
        "digest", F.col("best").alias("keep_id"), F.when(F.col("contents") > 1, F.raise_error(F.lit("two contents share a SHA-256 digest"))).otherwise(F.col("n")).alias("group_size"), "n"
    )
    found = join_shared(same, groups, "digest").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (keep.eqNullSafe(F.col("doc_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""
