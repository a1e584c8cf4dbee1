"""Row operators on tables: filters, joins, latest-per-key, unions, patches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def in_scope(rows: DataFrame, scope: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys are in the scope table."""
    return rows.join(scope.select(*keys), [*keys], "left_semi")


def out_of_scope(rows: DataFrame, scope: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys aren't in the scope table."""
    return rows.join(scope.select(*keys), [*keys], "left_anti")


def first_per_key(rows: DataFrame, keys: list[str], *order: Column | str, most: int = 1) -> DataFrame:
    """The first rows of each key in an order, ties by the order's last column; only these rows leave their partition."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def patch(rows: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with the fields that a change supplies; a null in a change leaves the field alone."""
    new = changes.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    joined = rows.join(new, key, "left")
    return joined.select(*(F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns))


def null_safe_missing(rows: DataFrame, known: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that have no equal row (null equals null) in the known table."""
    other = known.select(*(F.col(c).alias(f"_{c}") for c in columns))
    condition = None
    for c in columns:
        one = rows[c].eqNullSafe(other[f"_{c}"])
        condition = one if condition is None else condition & one
    return rows.join(other, condition, "left_anti")


def upsert_latest(rows: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """The union of both tables with the newest row of each key."""
    return first_per_key(rows.unionByName(changes), [key], F.col(version).desc())


def percentile_exact(rows: DataFrame, keys: list[str], value: str, share: float, tie: str) -> DataFrame:
    """sorted[floor(share * n)] of each key, the last value where that is out of range."""
    w = Window.partitionBy(*keys)
    ranked = rows.select(*keys, value, F.row_number().over(w.orderBy(value, tie)).alias("_k"), F.count("*").over(w).alias("_n"))
    return ranked.where(F.col("_k") == F.least(F.floor(F.col("_n") * share) + 1, F.col("_n"))).select(*keys, value)
