"""Connected components of an edge table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from starling.llm.common import saved


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of edges (src, dst, of one type).

    Each round sends a node to the smallest of itself and its neighbours and keeps the edges
    between different images, so stars vanish at once and every node that is not smaller than all
    its neighbours leaves. Rounds are written to the shared folder. A hash of the node is a second
    join key, so that joins shuffle both sides and Spark may split a hot node.
    """
    left = saved(edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "edges")
    maps = []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        step = both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("low")).select("node", F.least("node", "low").alias("to"))
        maps.append(step)
        keyed = step.select(F.xxhash64("node").alias("key"), "node", "to")
        for end in ("src", "dst"):
            left = left.withColumn("key", F.xxhash64(end)).join(keyed.withColumnRenamed("node", end), ["key", end]).withColumn(end, F.col("to")).select("src", "dst")
        left = saved(left.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "edges")
    if not maps:
        return left.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    labels = maps[0]
    for step in maps[1:]:
        keyed = step.select(F.xxhash64("node").alias("key"), F.col("node").alias("to"), F.col("to").alias("now"))
        labels = labels.withColumn("key", F.xxhash64("to")).join(keyed, ["key", "to"], "left").select("node", F.coalesce("now", "to").alias("to"))
    return labels.withColumnRenamed("to", "component")
