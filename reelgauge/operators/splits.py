"""Seeded, identity-safe splits and class balance. One DataFrame with a split column, never three lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranks import seeded_rank

IMAGE_TRAIN = 1.0 - 0.15


def _cut(n: Column, share: float) -> Column:
    """floor(n * share) in doubles, as the fixed cuts need it: (0.7 + 0.1) * 10 gives 7."""
    return F.floor(n.cast("double") * F.lit(share))


def split_random(records: DataFrame, train: float, groups: list[str], key: str = "path") -> DataFrame:
    ranked = seeded_rank(records, groups, key)
    return ranked.withColumn("split", F.when(F.col("rn") <= _cut(F.col("n"), train), "train").otherwise("val")).drop("rn", "n")


def split_grouped(records: DataFrame, train: float, val: float, groups: list[str]) -> DataFrame:
    """Identities are ranked and cut; every record follows its identity."""
    ranked = seeded_rank(records.select(*groups, "identity").distinct(), groups, "identity")
    side = F.when(F.col("rn") <= _cut(F.col("n"), train), "train").when(F.col("rn") <= _cut(F.col("n"), train + val), "val").otherwise("test")
    return records.join(ranked.select(*groups, "identity", side.alias("split")), [*groups, "identity"])


def split_video(records: DataFrame) -> DataFrame:
    return split_grouped(records, 0.7, 0.1, ["dataset"])


def split_combined(records: DataFrame) -> DataFrame:
    return split_grouped(records, 0.7, 0.2, [])


def split_image(records: DataFrame) -> DataFrame:
    """Per dataset: source splits are kept, val is cut from train where there is none; without any of them, by identity.

    Rows of other source splits vanish where one of train, val, test exists.
    """
    known = records.groupBy("dataset").agg(
        F.max(F.coalesce(F.col("source_split").isin("train", "val", "test"), F.lit(False))).alias("has_any"),
        F.max(F.coalesce(F.col("source_split") == "val", F.lit(False))).alias("has_val"),
    )
    flagged = records.join(known, "dataset")
    kept = flagged.filter("has_any and (source_split in ('val', 'test') or (source_split = 'train' and has_val))").withColumn("split", F.col("source_split"))
    cut = split_random(flagged.filter("has_any and source_split = 'train' and not has_val"), IMAGE_TRAIN, ["dataset"])
    free = split_grouped(flagged.filter("not has_any"), 0.7, 0.2, ["dataset"])
    columns = [*records.columns, "split"]
    return kept.select(*columns).unionByName(cut.select(*columns)).unionByName(free.select(*columns))


SPLITTERS = {"image_only": split_image, "video_only": split_video, "frame_only": split_video, "combined_aux": split_combined}


def balance(records: DataFrame, key: str = "path") -> DataFrame:
    """Every label is repeated up to the largest: whole repeats, and one more for the first in seeded order.

    With fewer than two labels nothing changes. Rows are spread by key before they are repeated.
    """
    counts = records.groupBy("label").agg(F.count(F.lit(1)).alias("own")).crossJoin(
        F.broadcast(records.groupBy("label").count().agg(F.max("count").alias("most"), F.count(F.lit(1)).alias("labels")))
    )  # one row per label against one row
    ranked = seeded_rank(records, ["label"], key).join(F.broadcast(counts), "label")
    times = F.when(F.col("labels") < 2, F.lit(1)).otherwise(F.floor(F.col("most") / F.col("own")) + (F.col("rn") <= F.col("most") % F.col("own")).cast("int"))
    return ranked.withColumn("copy", F.explode(F.sequence(F.lit(1), times.cast("int")))).select(*records.columns, "copy")


def filter_records(records: DataFrame, dtype: str | None = None, datasets: list[str] | None = None) -> DataFrame:
    if dtype:
        records = records.filter(F.col("dtype") == dtype)
    if datasets:
        records = records.filter(F.col("dataset").isin(*datasets))
    return records


def prepare_records(records: DataFrame, dtype: str | None = None, protocol: str | None = None, datasets: list[str] | None = None, balanced: bool = True) -> DataFrame:
    """Filter, split by protocol, balance train: records with split and copy (1 where not repeated)."""
    names = {"image": "image_only", "video": "video_only", "frame": "frame_only"}
    split = SPLITTERS[protocol or names.get(dtype, "combined_aux")](filter_records(records, dtype, datasets))
    train, rest = split.filter("split = 'train'"), split.filter("split <> 'train'").withColumn("copy", F.lit(1))
    train = balance(train) if balanced else train.withColumn("copy", F.lit(1))
    return train.unionByName(rest)
