"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, rekeyed


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """edges: u < v, without repeats. Large: each node's larger neighbours go to its smallest neighbour. Small: each node and its smaller neighbours do."""
    if large:
        seen = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = seen.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = seen.where("v > u").join(least.select(rekeyed(F.col("u")).alias("u"), "m"), "u").select("v", F.col("m").alias("u"))
    else:
        seen = edges.select(F.col("v").alias("node"), "u")
        least = seen.groupBy("node").agg(F.min("u").alias("m"))
        moved = seen.join(least.select(rekeyed(F.col("node")).alias("node"), "m"), "node").select(F.col("u").alias("v"), F.col("m").alias("u"))
        out = moved.unionByName(least.select(F.col("node").alias("v"), F.col("m").alias("u")))
    return out.where("u < v").select("u", "v").distinct()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for the nodes of the edges (two long columns a and b); component is the smallest node reachable.

    Each half round is a grouping with partial sums and a join whose skewed side adaptive execution splits, so a node with very many
    neighbours is no single task. A round is written to the shared folder. Null ends, loops and repeated edges are ignored;
    no edges give no rows.
    """
    e = cut(edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull()).where("u < v").distinct())
    before = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        e = cut(_stars(_stars(e, large=True), large=False))
    return e.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(e.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
