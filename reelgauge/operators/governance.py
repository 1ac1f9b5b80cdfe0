"""Audits of splits: leaks of identities or content, repeats outside train."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def leak_identity(split: DataFrame) -> DataFrame:
    """Identities of a dataset that are in more than one split."""
    return split.groupBy("dataset", "identity").agg(F.count_distinct("split").alias("splits")).filter("splits > 1")


def leak_content(split: DataFrame) -> DataFrame:
    """Content digests (md5) that are in more than one split."""
    return split.groupBy("digest").agg(F.count_distinct("split").alias("splits"), F.count(F.lit(1)).alias("n")).filter("splits > 1")


def balance_audit(prepared: DataFrame) -> DataFrame:
    """Per split: records, distinct paths, repeats, and whether repeats are allowed there."""
    per = prepared.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("path").alias("paths"))
    return per.select("split", "n", "paths", (F.col("n") - F.col("paths")).alias("repeats"), ((F.col("split") == "train") | (F.col("n") == F.col("paths"))).alias("ok"))


def split_summary(split: DataFrame) -> DataFrame:
    """Records and identities per split, dataset and label; a null identity counts as one."""
    grouped = split.groupBy("split", "dataset", "label").agg(
        F.count(F.lit(1)).alias("n"), (F.count_distinct("identity") + F.max(F.col("identity").isNull().cast("int"))).alias("identities")
    )
    totals = split.groupBy("split").agg(F.count(F.lit(1)).alias("split_n"))
    return grouped.join(totals, "split").select("split", "dataset", "label", "n", "identities", (100.0 * F.col("n") / F.col("split_n")).alias("percent"))


def split_composition(split: DataFrame) -> DataFrame:
    """Per split, dataset and label: records and their share of the dataset's; identities of the dataset; frames and their share; the split's share of all.

    split: split, dataset, label, dtype, identity, saved_frames. Only records of frames weigh in frame_mass, which is null for datasets without
    any; a null identity counts as one. The windows see one row per split, dataset and label.
    """
    framed = F.when(F.col("dtype") == "frame", F.coalesce("saved_frames", F.lit(0)))
    cells = split.groupBy("split", "dataset", "label").agg(F.count(F.lit(1)).alias("n"), F.sum(framed).alias("frame_mass"))
    known = split.groupBy("split", "dataset").agg((F.count_distinct("identity") + F.max(F.col("identity").isNull().cast("int"))).alias("identities"))
    of_set, of_split = Window.partitionBy("split", "dataset"), Window.partitionBy("split")
    share = lambda part, whole: F.when(whole > 0, 100.0 * part / whole).otherwise(0.0)
    cells = cells.withColumns({"set_n": F.sum("n").over(of_set), "split_n": F.sum("n").over(of_split), "set_mass": F.sum("frame_mass").over(of_set), "all_n": F.sum("n").over(Window.partitionBy())})
    known = known.select("split", F.col("dataset").alias("of"), "identities").withColumnRenamed("split", "at")
    met = cells.join(known, (F.col("split") == F.col("at")) & F.col("dataset").eqNullSafe(F.col("of")))
    return met.select(
        "split", "dataset", "label", "n", "identities", "split_n", share(F.col("split_n"), F.col("all_n")).alias("split_percent"), share(F.col("n"), F.col("set_n")).alias("percent"),
        "frame_mass", F.when(F.col("frame_mass").isNotNull(), share(F.col("frame_mass"), F.col("set_mass"))).alias("frame_percent"),
    )
