"""Connected components of an edge table as rounds of joins (large-star and small-star steps)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators.lineage import cut


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star step, then one small-star step. edges: a > b."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.join(least, "a").where("b > a and b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    moved = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select("a", F.col("m").alias("b"))).where("a != b").distinct()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node on an edge; component is the least node reachable.

    Edges with a null end and loops carry no link. An edge table without rows gives no rows. A node's
    edges meet only as partial minima and in joins that adaptive execution can split, so hubs are safe;
    the number of rounds grows with the logarithm of the longest path.
    """
    current = cut(edges.where(f"{a} is not null and {b} is not null and {a} != {b}").select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    state = None
    while True:
        now = current.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first()
        if state == tuple(now) or now[0] == 0:
            break
        state = tuple(now)
        current = cut(_stars(current))
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
