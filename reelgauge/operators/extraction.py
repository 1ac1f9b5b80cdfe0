"""Incremental frame extraction: what to do with each video, and which frames to read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import below
from .sampling import stride_indices

#: A folder with this many files comes from an old version of the extractor.
LEGACY = 16


def extraction_plan(videos: DataFrame, manifest: DataFrame, saved: DataFrame, stride: int, max_frames: int | None, overwrite: bool = False) -> DataFrame:
    """videos (path, frame_count) with their manifest row and saved files: decision skip, refresh or extract, and the reason."""
    m = manifest.withColumnRenamed("source_frame_count", "m_frames").withColumnRenamed("frame_stride", "m_stride").withColumnRenamed("max_frames", "m_max").withColumnRenamed("saved_frame_count", "m_saved")
    joined = (
        videos.join(m.withColumn("has_manifest", F.lit(True)), videos["path"] == m["source_path"], "left")
        .join(saved.select(F.col("source_path").alias("s_path"), "saved"), videos["path"] == F.col("s_path"), "left")
        .withColumn("saved", F.coalesce("saved", F.lit(0)))
        .withColumn("has_manifest", F.coalesce("has_manifest", F.lit(False)))
        .withColumn("expected", F.size(stride_indices(F.col("frame_count"), F.lit(stride), F.lit(max_frames).cast("int"))))
    )
    same4 = (
        F.col("has_manifest") & F.col("m_frames").eqNullSafe(F.col("frame_count")) & F.col("m_stride").eqNullSafe(F.lit(stride)) & F.col("m_max").eqNullSafe(F.lit(max_frames).cast("int"))
    )
    same5 = same4 & F.col("m_saved").eqNullSafe(F.col("expected"))
    legacy = (F.col("saved") == LEGACY) & (F.col("expected") != LEGACY)
    careful = F.lit(not overwrite)
    skip = careful & same5 & (F.col("saved") == F.col("expected"))
    reason = (
        F.when(legacy, "legacy_16_frame_output")
        .when(skip, F.lit(None))
        .when(careful & (F.col("saved") > 0) & (F.col("saved") != F.col("expected")), "partial_or_mismatched_frame_count")
        .when(careful & (F.col("saved") > 0) & ~F.col("has_manifest"), "missing_manifest")
        .when(careful & (F.col("saved") > 0) & ~same4, "stale_manifest")
    )
    out = joined.withColumn("reason", reason)
    decision = F.when(F.col("expected") == 0, "failed_metadata").when(~legacy & skip, "skipped").when(F.col("reason").isNotNull() | F.lit(overwrite), "refresh").otherwise("extract")
    return out.select("path", "expected", "saved", decision.alias("decision"), F.when(F.col("expected") > 0, F.col("reason")).alias("reason"))


def manifest_rows(done: DataFrame, stride: int, max_frames: int | None) -> DataFrame:
    """What the state table keeps of videos (path, frame_count, expected) that were extracted whole."""
    return done.select(
        F.col("path").alias("source_path"), F.col("frame_count").cast("long").alias("source_frame_count"), F.lit(stride).cast("int").alias("frame_stride"),
        F.lit(max_frames).cast("int").alias("max_frames"), F.col("expected").cast("int").alias("saved_frame_count"),
    )


def extraction_status(videos: DataFrame) -> DataFrame:
    """videos: path, opened, expected, saved_now, skipped."""
    status = (
        F.when(~F.col("opened"), "failed_open").when(F.col("expected") == 0, "failed_metadata").when(F.col("skipped"), "skipped").when(F.col("saved_now") == 0, "failed_decode").otherwise("ok")
    )
    return videos.select("path", status.alias("status"))


def extraction_tasks(records: DataFrame, limit: int | None = None) -> DataFrame:
    tasks = records.filter("dtype = 'video'").select("path", below(F.col("path"), "videos").alias("relative_path"))
    return tasks.orderBy("relative_path", "path").limit(limit) if limit is not None else tasks


def frame_read_plan(videos: DataFrame, stride: int, max_frames: int | None) -> DataFrame:
    picked = stride_indices(F.col("frame_count"), F.lit(stride), F.lit(max_frames).cast("int"))
    return videos.select("path", F.posexplode(picked).alias("out_idx", "frame_idx")).withColumn("file", F.format_string("%06d.jpg", F.col("out_idx")))
