"""Exact quantiles by selection: histograms narrow down where a wanted rank lies, and only there are values put in order.

Equal values are collapsed first. A cell is a range of a group's values; a cell with more than FEW distinct values that holds a wanted rank is cut into
BUCKETS equal ranges, whose counts say in which of them the rank lies, and so on. So no task ever holds more of a group than FEW
values or BUCKETS counts, and values outside the cells of wanted ranks are read once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch_dir

FEW = 50_000
BUCKETS = 1024


def _written(df: DataFrame, tag: str) -> DataFrame:
    path = scratch_dir(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _its(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with its_ before the names of columns, so that frames of one origin can meet."""
    return df.select(*[F.col(c).alias(f"its_{c}" if c in columns else c) for c in df.columns])


def _same(columns: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"its_{c}")) for c in columns], F.lit(True))


def _joined(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """a with the other columns of b, by columns that may be null."""
    return a.join(_its(b, columns), _same(columns)).select(*a.columns, *[c for c in b.columns if c not in columns])


def _bucket() -> Column:
    """Equal ranges between the least and the largest finite value of a cell; what is not finite has places of its own."""
    x, lo, hi = F.col("x"), F.col("lo"), F.col("hi")
    finite = F.least(F.lit(BUCKETS - 1), F.floor((x / 2 - lo / 2) / (hi / 2 - lo / 2) * BUCKETS)).cast("int")
    return F.when(F.isnan(x), BUCKETS + 1).when(x == float("inf"), BUCKETS).when(x == float("-inf"), -1).when(lo == hi, 0).otherwise(finite)


def quantiles(df: DataFrame, groups: list[str], value: str, fractions: list[float], discrete: bool = False, few: int = FEW) -> DataFrame:
    """groups and q, an array of the values at the fractions: between neighbours by their distance, or with discrete the first value that reaches the fraction.

    Null values are left out; NaN is the largest value. Groups without values have no row.
    """
    keys = [*groups, "cell"]
    finite = lambda f, x: f(F.when(F.abs(x) < float("inf"), x))
    counted = df.select(*groups, F.col(value).cast("double").alias("x")).filter("x is not null").groupBy(*groups, "x").agg(F.count(F.lit(1)).alias("n"))
    held = _written(counted.withColumn("cell", F.lit("")), "quantile-values")
    describe = [F.count(F.lit(1)).alias("values"), F.sum("n").alias("rows"), finite(F.min, F.col("x")).alias("lo"), finite(F.max, F.col("x")).alias("hi")]
    cells = _written(held.groupBy(*keys).agg(*describe), "quantile-cells")
    sizes = cells.select(*keys, F.col("rows").alias("total"))
    at = F.array(*[F.lit(float(f)) for f in fractions])
    if discrete:
        wishes = F.transform(at, lambda f: F.greatest(F.lit(0), F.ceil(f * F.col("total")) - 1).cast("long"))
    else:
        wishes = F.array_distinct(F.flatten(F.transform(at, lambda f: F.array(F.floor(f * (F.col("total") - 1)).cast("long"), F.ceil(f * (F.col("total") - 1)).cast("long")))))
    wanted = sizes.select(*groups, F.lit("").alias("cell"), F.explode(F.array_distinct(wishes)).alias("rank"))
    wanted = _written(wanted.withColumn("left", F.col("rank")), "quantile-ranks")
    found = []
    while True:
        small = cells.filter(F.col("values") <= few)
        before = F.coalesce(F.sum("n").over(Window.partitionBy(*keys).orderBy("x").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = _joined(held, small.select(*keys), keys).withColumn("before", before)
        hit = placed.join(_its(wanted, keys), _same(keys) & (F.col("left") >= F.col("before")) & (F.col("left") < F.col("before") + F.col("n")))
        found.append(hit.select(*groups, "rank", "x"))
        large = cells.filter(F.col("values") > few)
        if large.isEmpty():
            break
        cut = _joined(held, large.select(*keys, "lo", "hi"), keys).withColumn("bucket", _bucket())
        bins = cut.groupBy(*keys, "bucket").agg(*describe)
        before = F.coalesce(F.sum("rows").over(Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        bins = _written(bins.withColumn("before", before), "quantile-bins")
        met = bins.join(_its(wanted, keys), _same(keys) & (F.col("left") >= F.col("before")) & (F.col("left") < F.col("before") + F.col("rows")))
        inner = F.concat_ws("/", "cell", F.col("bucket").cast("string"))
        met = met.select(*groups, inner.alias("cell"), "values", "rows", "lo", "hi", "rank", (F.col("left") - F.col("before")).alias("left"))
        met = _written(met, "quantile-met")
        cells, wanted = met.select(*keys, "values", "rows", "lo", "hi").distinct(), met.select(*keys, "rank", "left")
        inside = cut.withColumn("cell", F.concat_ws("/", "cell", F.col("bucket").cast("string"))).select(*groups, "x", "n", "cell")
        held = _written(_joined(inside, cells.select(*keys), keys), "quantile-values")
    ranks = reduce(DataFrame.unionByName, found)
    gathered = ranks.groupBy(*groups).agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("values"))  # twice as many as fractions at most
    met = _joined(gathered.withColumn("cell", F.lit("")), sizes, keys)
    value_at = lambda r: F.element_at("values", r.cast("long"))
    if discrete:
        answer = F.transform(at, lambda f: value_at(F.greatest(F.lit(0), F.ceil(f * F.col("total")) - 1)))
    else:
        place = lambda f: f * (F.col("total") - 1)
        between = lambda p: F.when(F.floor(p) == F.ceil(p), value_at(F.floor(p))).otherwise((F.ceil(p) - p) * value_at(F.floor(p)) + (p - F.floor(p)) * value_at(F.ceil(p)))
        answer = F.transform(at, lambda f: between(place(f)))
    return met.select(*groups, answer.alias("q"))
