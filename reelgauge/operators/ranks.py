"""Exact ranks and running sums without putting a whole group into one task.

Rows get a bucket that follows the order. Per-bucket totals (a few thousand rows a group at most)
give each bucket its offset; the window proper runs within (group, bucket).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded_order(key: Column, seed: int = 42) -> Column:
    """A fixed pseudo-random order of keys, the same on every engine that has md5."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def seeded_rank(df: DataFrame, groups: list[str], key: str, seed: int = 42) -> DataFrame:
    """df with rn (1 first) and n (rows of the group) in seeded order of key; key is unique within a group."""
    ordered = df.withColumn("__order", seeded_order(F.col(key), seed)).withColumn("__bucket", F.substring("__order", 1, 3))
    totals = ordered.groupBy(*groups, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*groups).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *[F.col(g).alias(f"__{g}") for g in groups],
        F.col("__bucket").alias("__at"),
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"),
        F.sum("__n").over(Window.partitionBy(*groups)).alias("n"),
    )
    same = F.col("__bucket") == F.col("__at")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"__{g}"))
    inner = Window.partitionBy(*groups, "__bucket").orderBy("__order", key)
    ranked = ordered.join(totals, same).withColumn("rn", F.col("__offset") + F.row_number().over(inner))
    return ranked.select(*df.columns, "rn", "n")


def descending_sums(df: DataFrame, groups: list[str], score: str, values: list[str], buckets: int = 1024) -> DataFrame:
    """df with cum_<value>: the sum of value over rows of the group with this score or a larger one; scores are distinct within a group."""
    bucketed = df.withColumn("__bucket", F.floor(F.greatest(F.lit(-1.0), F.least(F.lit(2.0), F.col(score))) * buckets))
    totals = bucketed.groupBy(*groups, "__bucket").agg(*[F.sum(v).alias(f"__{v}") for v in values])
    above = Window.partitionBy(*groups).orderBy(F.col("__bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *[F.col(g).alias(f"__{g}") for g in groups], F.col("__bucket").alias("__at"), *[F.coalesce(F.sum(f"__{v}").over(above), F.lit(0)).alias(f"__above_{v}") for v in values]
    )
    same = F.col("__bucket") == F.col("__at")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"__{g}"))
    inner = Window.partitionBy(*groups, "__bucket").orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = bucketed.join(totals, same)
    for v in values:
        out = out.withColumn(f"cum_{v}", F.col(f"__above_{v}") + F.sum(v).over(inner))
    return out.select(*df.columns, *[f"cum_{v}" for v in values])


def bucketed_places(df: DataFrame, groups: list[str], bucket: Column, order: list[Column]) -> DataFrame:
    """df with place (1 first) in the given order within a group; bucket is a whole number that never rises along the order.

    Rows are sorted within a bucket only; the places before it come from the counts of the buckets above.
    """
    bucketed = df.withColumn("__bucket", bucket.cast("long"))
    totals = bucketed.groupBy(*groups, "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    above = Window.partitionBy(*groups).orderBy(F.col("__bucket").desc()).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(g).alias(f"__{g}") for g in groups], F.col("__bucket").alias("__at"), F.coalesce(F.sum("__n").over(above), F.lit(0)).alias("__offset"))
    same = F.col("__bucket") == F.col("__at")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"__{g}"))
    inner = Window.partitionBy(*groups, "__bucket").orderBy(*order)
    return bucketed.join(totals, same).withColumn("place", F.col("__offset") + F.row_number().over(inner)).select(*df.columns, "place")
