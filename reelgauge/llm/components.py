"""Connected components of a large graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """edges (a long, b long, any order and repeats) -> node, component: the smallest node it can reach.

    Only nodes with an edge to another node appear. Each round is two aggregations, which combine a hub's edges before they
    are shuffled, with a join back to the edges, in which a hub's edges go to one task unless the adaptive skew rule
    splits them (it is on by default, from 256 MB a partition). The rounds grow
    with the logarithm of the longest chain. Each round is written to the shared folder.
    """
    stars = materialize(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), f"{tag}-edges"
    )
    mark = _mark(stars)
    while mark[0]:
        both = stars.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(stars.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).filter("hi <> lo").distinct()
        small = large.join(large.groupBy("hi").agg(F.min("lo").alias("m")), "hi")
        pairs = F.explode(F.array(F.struct(F.col("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo"))))
        stars = materialize(small.select(pairs.alias("e")).select("e.hi", "e.lo").filter("hi <> lo").distinct(), f"{tag}-round")
        before, mark = mark, _mark(stars)
        if mark == before:
            break
    return stars.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("component")).unionByName(
        stars.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )
