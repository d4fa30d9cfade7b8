"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` of longs -> ``(node, root)``; root is the smallest node reachable.

    Every node of ``edges`` appears once. Nulls and self loops are ignored.
    Each round shrinks stars around minima: a chain of n nodes needs
    O(log n) rounds, and a hub's rows are combined before they are shuffled.
    """
    e = materialize(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges"
    )
    before = _state(e)
    if before[0] == 0:
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v")))
        last, e = e, materialize(
            small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges"
        )
        release(last)
        after = _state(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    nodes = e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return nodes.unionByName(roots)
