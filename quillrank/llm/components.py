"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for each node of ``edges(src, dst)``; the root is the component's smallest node.

    Each round is two aggregations and joins on node ids; links are never gathered anywhere.  Every round's links are
    materialised in the shared folder, so that a lost executor costs one round at most.  Nulls and self-links are
    dropped; no links give no rows.
    """
    links = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    links = cut(links.where("u is not null and v is not null and u <> v").distinct())
    state = None
    for _ in range(max_rounds):
        both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = cut(small.unionAll(least.select("u", F.col("m").alias("v"))).distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    return links.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root") \
        .unionAll(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
