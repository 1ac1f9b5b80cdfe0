"""A folder for intermediate files that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

from . import files

_made: dict[str, list[str]] = {}  # by application


def scratch_dir(spark: SparkSession, tag: str) -> str:
    """A new name below spark.checkpoint.dir; only where that is unset on one machine (tests) a local folder is chosen and set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="reelgauge-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop_scratch(spark: SparkSession, keep: tuple[str, ...] = ()) -> int:
    """Delete the intermediate files that this application has made so far, but for the paths to keep; returns how many folders went.

    To be called when what was computed from them is written elsewhere: frames that still read them fail afterwards.
    """
    gone = [p for p in _made.get(spark.sparkContext.applicationId, []) if p not in keep]
    _made[spark.sparkContext.applicationId] = list(keep)
    there = [p for p in gone if files.exists(spark, p)]
    for path in there:
        files.delete(spark, path)
    return len(there)
