"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_path, hot_keys, join_hot, new_path


def components(links: DataFrame) -> DataFrame:
    """links: u, v (long). Returns node, root for every node of a link; root is the component's smallest node.

    Each round every node takes the smallest root among its own and its neighbours' (a minimum, combined before the shuffle)
    and then its root's root, so rounds grow with the logarithm of the diameter. Rows of a node with very many links, and of a
    root with very many nodes, meet it by broadcast: there are few such. Each round is written to the shared folder;
    the one before is removed. Repeated links and self-links do no harm; no links give no rows.
    """
    spark = links.sparkSession
    written = [new_path(spark, "links")]
    both = cut(links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links", written[0])
    hubs = hot_keys(both, "v")
    path = new_path(spark, "roots")
    now = cut(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("root")), "roots", path)
    total = now.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]
    while True:
        near = join_hot(both, now.select(F.col("node").alias("v"), "root"), "v", hubs).groupBy("u").agg(F.min("root").alias("near"))
        middle = new_path(spark, "hooked")
        hooked = cut(now.join(near, now["node"] == near["u"]).select("node", F.least("root", "near").alias("root")), "hooked", middle)
        up = now.select(F.col("node").alias("root"), F.col("root").alias("above"))
        jumped = join_hot(hooked, up, "root", hot_keys(hooked, "root")).select("node", F.least("root", F.coalesce("above", "root")).alias("root"))
        last, path = path, new_path(spark, "roots")
        now = cut(jumped, "roots", path)
        drop_path(spark, last)
        drop_path(spark, middle)
        before, total = total, now.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]
        if total == before:  # roots only ever fall
            drop_path(spark, written[0])
            return now
