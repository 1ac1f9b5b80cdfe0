"""Which frames and clips of a video to read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import seeded_order


def draw(key: Column, n: Column) -> Column:
    """A number in 0..n-1 that depends on the key only: seven hex digits of its md5."""
    return F.pmod(F.conv(F.substring(seeded_order(key), 1, 7), 16, 10).cast("long"), n)


def single_index(n: Column, key: Column | None = None) -> Column:
    """Centre frame, or one drawn by key; 0 for no frames."""
    at = F.floor(n / 2) if key is None else draw(key, F.greatest(n, F.lit(1)))
    return F.when(n <= 0, F.lit(0)).otherwise(at).cast("long")


def contiguous_clip(n: Column, length: int, key: Column | None = None) -> Column:
    """length indices: from the centre (or a drawn start); short videos repeat their last frame, empty ones give zeros."""
    start = F.floor((n - length) / 2) if key is None else draw(key, F.greatest(n - length + 1, F.lit(1)))
    start = F.when(n <= length, F.lit(0)).otherwise(start).cast("long")
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.greatest(F.lit(0), F.least(start + i, n - 1)).cast("long"))


def clamp(i: Column, n: Column) -> Column:
    return F.greatest(F.lit(0), F.least(i, n - 1))


def stride_indices(n: Column, stride: Column, cap: Column) -> Column:
    """0, s, 2s ... below n; more than cap are thinned evenly, ends kept. Null cap: all. No frames: empty."""
    every = F.when(n > 0, F.sequence(F.lit(0).cast("long"), (n - 1).cast("long"), F.greatest(F.lit(1), stride).cast("long"))).otherwise(F.array().cast("array<long>"))

    def thinned(all_: Column) -> Column:
        size = F.size(all_)
        step = (size - 1).cast("double") / F.greatest(F.lit(1), cap - 1)
        at = lambda k: F.when(k == cap - 1, size - 1).otherwise(F.floor(k * step)).cast("int")
        picked = F.when(cap == 1, F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), (cap - 1).cast("int")), at))
        return F.when(cap.isNull() | (size <= cap), all_).otherwise(F.transform(picked, lambda k: F.get(all_, k)))

    return F.element_at(F.transform(F.array(every), thinned), 1)


def probe_indices(n: Column) -> Column:
    """First, middle and last frame of three; fewer where there are fewer."""
    last = n - 1
    found = F.when(n <= 0, F.array().cast("array<long>")).when(n == 1, F.array(F.lit(0))).when(n == 2, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0), F.floor(last / 2), last))
    return F.array_sort(F.array_distinct(found.cast("array<long>")))


def folder_probes(n: Column) -> Column:
    return F.when(n <= 0, F.array().cast("array<long>")).otherwise(F.array_sort(F.array_distinct(F.array(F.lit(0), F.floor(n / 2), n - 1).cast("array<long>"))))


def frame_positions(files: DataFrame) -> DataFrame:
    """position of each file (path, folder) in the name order of its folder, from 0."""
    return files.withColumn("position", F.row_number().over(Window.partitionBy("folder").orderBy("path")) - 1)


def clip_files(files: DataFrame, length: int) -> DataFrame:
    """folder, out_idx, path: the centre clip of each folder, as files."""
    placed = frame_positions(files)
    sizes = files.groupBy("folder").agg(F.count(F.lit(1)).alias("n"))
    clips = sizes.select("folder", F.posexplode(contiguous_clip(F.col("n"), length)).alias("out_idx", "position"))
    return clips.join(placed, ["folder", "position"]).select("folder", "out_idx", "path")


def pad_clip(decoded: DataFrame) -> DataFrame:
    """clip, out_idx, frame (null where decoding failed): the last frame decoded before stands in."""
    return decoded.withColumn("frame", F.last("frame", ignorenulls=True).over(Window.partitionBy("clip").orderBy("out_idx").rowsBetween(Window.unboundedPreceding, 0)))


def sample_per(records: DataFrame, group: str, k: int) -> DataFrame:
    return records.withColumn("rn", F.row_number().over(Window.partitionBy(group).orderBy("path"))).filter(F.col("rn") <= k).drop("rn")
