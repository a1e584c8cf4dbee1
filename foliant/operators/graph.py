"""Property-graph operators on edge tables (src, dst, type, rel_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.operators.components import connected_components
from foliant.operators.lineage import cut


def both_ways(edges: DataFrame) -> DataFrame:
    """(node, other, ...) of every edge from both ends; a loop appears once."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    there = edges.select(F.col("src").alias("node"), F.col("dst").alias("other"), *rest)
    back = edges.where("src != dst").select(F.col("dst").alias("node"), F.col("src").alias("other"), *rest)
    return there.unionByName(back)


def degrees(edges: DataFrame, loops_twice: bool = False) -> DataFrame:
    """(node, degree): the edges that touch a node; the ends of an edge are unfolded instead of joined by OR."""
    ends = F.array("src", "dst")
    return edges.select(F.explode(ends if loops_twice else F.array_distinct(ends)).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()


def within(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Edges whose both ends are chosen nodes."""
    one = edges.join(chosen.select(F.col("node").alias("src")), "src", "left_semi")
    return one.join(chosen.select(F.col("node").alias("dst")), "dst", "left_semi")


def breadth_first(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(node, depth) within ``depth`` steps of the seeds; depth is small and bounds the rounds of joins."""
    ways = both_ways(edges.select("src", "dst")).distinct()
    seen = seeds.select("node", F.lit(0).alias("depth")).distinct()
    front = seen
    for step in range(1, depth + 1):
        found = front.select("node").join(ways, "node").select(F.col("other").alias("node")).distinct()
        front = found.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(step))
        seen = seen.unionByName(front)
    return seen


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable. Nodes get numbers for the rounds, and their names back at the end."""
    numbered = cut(nodes(edges).where("node is not null")).withColumn("id", F.monotonically_increasing_id())
    ends = [numbered.select(F.col("node").alias(e), F.col("id").alias(i)) for e, i in (("src", "a"), ("dst", "b"))]
    links = edges.select("src", "dst").where("src != dst").distinct().join(ends[0], "src").join(ends[1], "dst").select("a", "b")
    found = connected_components(links, "a", "b").select(F.col("node").alias("id"), "component")
    labelled = cut(numbered.join(found, "id", "left").select("node", F.coalesce("component", "id").alias("group")))
    least = labelled.groupBy("group").agg(F.min("node").alias("component"))
    return labelled.join(least, "group").select("node", "component")


def fingerprint(node_rows: DataFrame, edge_rows: DataFrame, node_columns: list[str], edge_columns: list[str]) -> DataFrame:
    """Counts and an order-independent hash of nodes and edges, in one row."""
    a = node_rows.select(F.lit(0).alias("kind"), F.xxhash64(*node_columns).alias("h"))
    b = edge_rows.select(F.lit(1).alias("kind"), F.xxhash64(F.lit("edge"), *edge_columns).alias("h"))
    return a.unionByName(b).agg(F.count(F.when(F.col("kind") == 0, 1)).alias("nodes"), F.count(F.when(F.col("kind") == 1, 1)).alias("edges"), F.bit_xor("h").alias("hash"))


def resolve(mentions: DataFrame, name: str, order: str, kind: Column, description: Column, newest_wins: bool = True) -> DataFrame:
    """One entity for each lower-cased name: the first spelling and type, and the last (or first) description that isn't empty."""
    rows = mentions.select(F.lower(name).alias("key"), F.col(name).alias("name"), F.coalesce(F.nullif(F.lower(kind), F.lit("")), F.lit("concept")).alias("type"), F.nullif(description, F.lit("")).alias("description"), F.col(order).alias("seq"))
    told = F.when(F.col("description").isNotNull(), F.col("seq"))
    best = F.max_by("description", told) if newest_wins else F.min_by("description", told)
    return rows.groupBy("key").agg(F.min_by("name", "seq").alias("name"), F.min_by("type", "seq").alias("type"), best.alias("description"), F.count("*").alias("mentions"))


def first_unique(rows: DataFrame, value: str, order: str, most: int, scope: str) -> DataFrame:
    """The first ``most`` distinct values of each scope in an order."""
    once = rows.groupBy(scope, value).agg(F.min(order).alias(order))
    return once.withColumn("place", F.row_number().over(Window.partitionBy(scope).orderBy(order, value))).where(F.col("place") <= most)
