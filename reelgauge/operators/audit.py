"""Counts of what was discovered, what is on disk and what can be read."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.values import ratio
from ..sources import files
from ..sources.scratch import scratch_dir
from .quantiles import quantiles


def record_counts(records: DataFrame) -> DataFrame:
    """Counts by dtype; by label; by dtype, dataset, label; by dtype, dataset, source split: one pass of grouping sets. level names the set."""
    marked = records.select("dtype", "dataset", "label", F.coalesce("source_split", F.lit("unspecified")).alias("source_split"))
    counted = marked.groupingSets(
        [["dtype"], ["label"], ["dtype", "dataset", "label"], ["dtype", "dataset", "source_split"]], "dtype", "dataset", "label", "source_split"
    ).agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"))
    return counted.select("level", "dtype", "dataset", "label", "source_split", "n")


def identity_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("dtype", "dataset").agg(F.count_distinct("identity").alias("identities"))


def label_share(records: DataFrame) -> DataFrame:
    total = F.sum("n").over(Window.partitionBy("dataset"))
    return records.groupBy("dataset", "label").agg(F.count(F.lit(1)).alias("n")).select("dataset", "label", "n", (100.0 * ratio(F.col("n"), total)).alias("percent"))


def frame_mass(folders: DataFrame) -> DataFrame:
    return folders.groupBy("dataset", "label").agg(F.sum("frames").alias("frames"))


def folder_length_stats(folders: DataFrame) -> DataFrame:
    """Saved frames per folder; both medians: between the middles, and the lower of them."""
    stats = folders.groupBy("dataset").agg(F.min("frames").alias("least"), F.max("frames").alias("most"), F.avg("frames").alias("mean"))
    middle = quantiles(folders, ["dataset"], "frames", [0.5]).select(F.col("dataset").alias("its"), F.get("q", F.lit(0)).alias("median"))
    lower = quantiles(folders, ["dataset"], "frames", [0.5], discrete=True).select(F.col("dataset").alias("lower_its"), F.get("q", F.lit(0)).cast("long").alias("lower_median"))
    met = stats.join(middle, F.col("dataset").eqNullSafe(F.col("its")), "left").join(lower, F.col("dataset").eqNullSafe(F.col("lower_its")), "left")
    return met.select("dataset", "least", "median", "lower_median", "most", "mean")


def numeric_distribution(df: DataFrame, value: str, groups: list[str]) -> DataFrame:
    """count, min, quartiles by linear interpolation, max, mean; zeros for no rows."""
    x, z = F.col(value).cast("double"), F.lit(0.0)
    stats = df.groupBy(*groups).agg(F.count(x).alias("n"), F.min(x).alias("least"), F.max(x).alias("most"), F.avg(x).alias("mean"))
    found = quantiles(df, groups, value, [0.25, 0.5, 0.75]).select(*[F.col(g).alias(f"its_{g}") for g in groups], "q")
    same = [F.col(g).eqNullSafe(F.col(f"its_{g}")) for g in groups]
    met = stats.join(found, reduce(lambda a, b: a & b, same) if same else F.lit(True), "left")
    return met.select(
        *groups, "n", F.coalesce("least", z).alias("least"), F.coalesce(F.get("q", 0), z).alias("p25"), F.coalesce(F.get("q", 1), z).alias("median"),
        F.coalesce(F.get("q", 2), z).alias("p75"), F.coalesce("most", z).alias("most"), F.coalesce("mean", z).alias("mean"),
    )


def mass_summary(videos: DataFrame) -> DataFrame:
    """Per dataset and overall (null dataset): videos, frames, seconds, means."""
    return videos.rollup("dataset").agg(
        F.count(F.lit(1)).alias("videos"), F.sum("frame_count").alias("frames"), F.sum("duration_sec").alias("seconds"),
        F.avg("frame_count").alias("mean_frames"), F.avg("duration_sec").alias("mean_seconds"),
    )


def label_balance(videos: DataFrame) -> DataFrame:
    per = videos.groupBy("dataset", "label").agg(F.count(F.lit(1)).alias("videos"), F.sum("frame_count").alias("frames"), F.sum("duration_sec").alias("seconds"))
    w = Window.partitionBy("dataset")
    shares = [(100.0 * ratio(F.col(c), F.sum(c).over(w))).alias(f"{c}_share") for c in ("videos", "frames", "seconds")]
    return per.select("dataset", "label", "videos", "frames", "seconds", *shares)


def frame_mass_dominant(videos: DataFrame) -> DataFrame:
    """fake, real or equal by frames, for datasets that have both labels."""
    real, fake = F.sum(F.when(F.col("label") == 1, F.col("frame_count"))), F.sum(F.when(F.col("label") == 0, F.col("frame_count")))
    both = videos.groupBy("dataset").agg(real.alias("real_frames"), fake.alias("fake_frames")).filter("real_frames is not null and fake_frames is not null")
    side = F.when(F.col("fake_frames") > F.col("real_frames"), "fake").when(F.col("real_frames") > F.col("fake_frames"), "real").otherwise("equal")
    return both.select("dataset", "real_frames", "fake_frames", side.alias("dominant"))


def reconcile(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Counts n of two sides by keys; a side that lacks a key counts 0."""
    a = expected.groupBy(*keys).agg(F.count(F.lit(1)).alias("census"))
    b = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("discovered"))
    both = a.join(b, keys, "full_outer").select(*keys, F.coalesce("census", F.lit(0)).alias("census"), F.coalesce("discovered", F.lit(0)).alias("discovered"))
    return both.withColumn("status", F.when(F.col("census") == F.col("discovered"), "OK").otherwise("MISMATCH"))


def clean_corpus(records: DataFrame, failures: DataFrame) -> DataFrame:
    return records.join(failures.select("path"), "path", "left_anti")


def validation_summary(results: DataFrame) -> DataFrame:
    return results.groupBy("dtype", "dataset").agg(F.count_if("ok").alias("readable"), F.count_if(~F.col("ok")).alias("failed"))


def failure_samples(results: DataFrame, k: int = 50) -> DataFrame:
    return results.filter(~F.col("ok")).orderBy("path").limit(k).select("path", "label", "dtype", "error")


def census_drift(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    both = reconcile(before, after, keys)
    return both.select(*keys, F.col("census").alias("before"), F.col("discovered").alias("after"), (F.col("discovered") - F.col("census")).alias("change"))


def repair_plan(results: DataFrame, action: str, root: str, quarantine: str) -> DataFrame:
    """What would be done to each unreadable file; nothing is touched. Action report, delete or quarantine."""
    target = F.concat(F.lit(quarantine.rstrip("/") + "/"), F.substring(F.col("path"), len(root.rstrip("/")) + 2, 1_000_000))
    below = F.col("path").startswith(root.rstrip("/") + "/")
    return results.filter(~F.col("ok")).select("path", F.lit(action).alias("action"), F.when(below & (F.lit(action) == "quarantine"), target).alias("target"))


ACTION = "action_id string, path string, action string, target string, at_source boolean, at_target boolean"
OUTCOME = "action_id string, path string, outcome string, reason string"


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _present(path: str | None) -> bool:
    from pyarrow import fs

    if path is None:
        return False
    try:
        files, name = _opened(path)
        return files.get_file_info(name).type != fs.FileType.NotFound
    except Exception:  # what cannot be asked for fails when it is acted on
        return False


def _plan_actions(batches):
    """What is there before anything is done, so that a later look can tell an action's own trace from a file that never was."""
    for batch in batches:
        act = batch["action"] != "report"
        yield batch.assign(at_source=[bool(a) and _present(p) for a, p in zip(act, batch["path"])], at_target=[bool(a) and _present(t) for a, t in zip(act, batch["target"])])


def _outcome(path: str, action: str, target: str | None, at_source: bool, at_target: bool) -> tuple[str, str | None]:
    try:
        if action == "report":
            return "reported", None
        files, source = _opened(path)
        if action == "delete":
            if at_source and not _present(path):
                return "deleted", None  # by an earlier attempt at this action
            files.delete_file(source)
            return "deleted", None
        if target is None:
            raise ValueError("not below the root")
        if (at_source or at_target) and not _present(path) and _present(target):
            return "moved", None
        goal = _opened(target)[1]
        files.create_dir(goal.rsplit("/", 1)[0], recursive=True)
        files.move(source, goal)
        return "moved", None
    except Exception as error:  # the reason is the result
        return "failed", f"{type(error).__name__}: {error}"


def _act(batches):
    for batch in batches:
        done = [_outcome(*row) for row in zip(*(batch[c] for c in ("path", "action", "target", "at_source", "at_target")))]
        yield batch[["action_id", "path"]].assign(outcome=[o for o, _ in done], reason=[r for _, r in done])


def apply_repair(plan: DataFrame, ledger: str | None = None) -> DataFrame:
    """path, outcome (reported, deleted, moved, failed), reason: does to files what repair_plan says, once, and keeps a ledger.

    Phase one writes every action, and whether its file and its target are there, before any file is touched; phase two
    acts on what the ledger has no outcome of, and writes the outcomes. A run that was killed is run again with the same ledger:
    the first plan holds, and a file that was there when it was planned and is gone now was deleted, or moved if it is at its
    target, so retried and speculative tasks report the same. Paths are those that pyarrow opens. A file that
    cannot be deleted or moved fails with its reason and stops nothing. Without a ledger's folder a new one is made in the scratch folder.
    """
    spark = plan.sparkSession
    ledger = (ledger or scratch_dir(spark, "repair")).rstrip("/")
    if not files.exists(spark, f"{ledger}/planned/_SUCCESS"):
        actions = plan.select(F.sha2(F.concat_ws("\0", "path", "action", F.coalesce("target", F.lit(""))), 256).alias("action_id"), "path", "action", "target").dropDuplicates(["action_id"])
        actions.mapInPandas(_plan_actions, ACTION).write.mode("overwrite").parquet(f"{ledger}/planned")
    planned = spark.read.schema(ACTION).parquet(f"{ledger}/planned")
    todo = planned.join(_outcomes(spark, ledger).select("action_id"), "action_id", "left_anti")
    todo.mapInPandas(_act, OUTCOME).write.parquet(f"{ledger}/done/{uuid.uuid4().hex}")
    return _outcomes(spark, ledger).select("path", "outcome", "reason")


def _outcomes(spark: SparkSession, ledger: str) -> DataFrame:
    done = [f"{ledger}/done/{n}" for n in files.names_in(spark, f"{ledger}/done") if files.exists(spark, f"{ledger}/done/{n}/_SUCCESS")]
    return spark.read.schema(OUTCOME).parquet(*done) if done else spark.createDataFrame([], OUTCOME)


def repair_tally(outcomes: DataFrame) -> DataFrame:
    """deleted, moved and failed files."""
    return outcomes.agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("deleted", "moved", "failed")])
