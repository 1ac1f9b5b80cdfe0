"""Readability of media by structure. Pixels are not decoded: a picture's stream is followed to its end and a film's samples to their bytes.

A prober is a function of a ``containers.Reader`` that raises ``containers.Broken`` with the text of the failure. Probers go by dtype, and callers may
bring their own: they travel with the tasks. Where files are given by path, only the ranges that a prober asks for are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.containers import Broken, Reader, film_probes, probe_image, probe_video
from ..functions.paths import file_name

RESULT = "path string, label int, dtype string, ok boolean, error string"
SECONDS = 60.0  # for one file

Prober = Callable[[Reader], None]
PROBERS: dict[str, Prober] = {"image": probe_image, "video": probe_video}


def failure(prober: Prober | None, dtype: str, file: Reader) -> str | None:
    """None, or Type: message of what the prober found; an unknown dtype is a failure."""
    if prober is None:
        return f"ValueError: Unsupported dtype: {dtype}"
    try:
        prober(file)
    except Broken as error:
        return str(error)
    except Exception as error:  # whatever a foreign file does to a prober is the file's failure
        return f"{type(error).__name__}: {error}"
    return None


def image_error(data: bytes) -> str | None:
    return failure(probe_image, "image", Reader.of(data))


def video_error(data: bytes) -> str | None:
    return failure(probe_video, "video", Reader.of(data))


def open_range(path: str, seconds: float | None = None):
    """A Reader of a file that pyarrow opens, and the open file."""
    from pyarrow import fs

    files, name = fs.FileSystem.from_uri(path)
    file = files.open_input_file(name)

    def fetch(at: int, n: int) -> bytes:
        file.seek(at)
        return file.read(n)

    return Reader(fetch, file.size(), seconds), file


def _checked(probers: dict[str, Prober], seconds: float, keep: tuple[str, ...] = ()):
    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            errors = [failure(probers.get(d), d, Reader.of(bytes(c or b""), seconds)) for d, c in zip(batch["dtype"], batch["content"])]
            yield batch[["path", "label", "dtype"]].assign(ok=[e is None for e in errors], error=errors, **{c: batch[c] for c in keep})

    return check


def validate(media: DataFrame, probers: dict[str, Prober] | None = None, seconds: float = SECONDS) -> DataFrame:
    """media (path, label, dtype, content): one result row each; an unknown dtype is a failure."""
    return media.select("path", F.col("label").cast("int").alias("label"), "dtype", "content").mapInPandas(_checked(probers or PROBERS, seconds), RESULT)


def validate_paths(media: DataFrame, probers: dict[str, Prober] | None = None, seconds: float = SECONDS) -> DataFrame:
    """media (path, label, dtype): the same of files that pyarrow opens, by ranges; what cannot be opened is a failure."""
    known = probers or PROBERS

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            errors = []
            for path, dtype in zip(batch["path"], batch["dtype"]):
                try:
                    reader, file = open_range(path, seconds)
                except Exception as error:
                    errors.append(f"{type(error).__name__}: {error}")
                    continue
                with file:
                    errors.append(failure(known.get(dtype), dtype, reader))
            yield batch.assign(ok=[e is None for e in errors], error=errors)

    return media.select("path", F.col("label").cast("int").alias("label"), "dtype").mapInPandas(check, RESULT)


def with_second_opinion(spark: SparkSession, results: DataFrame, root: str) -> DataFrame:
    """results with decoded: whether Spark's image source, which decodes pictures, keeps the file; null for what is no picture.

    Paths are compared as that source names them, with their scheme.
    """
    decoded = spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True).load(root).select(F.col("image.origin").alias("origin"))
    named = results.withColumn("origin", F.when(F.col("dtype") == "image", F.regexp_replace("path", "^file:/*", "file:///")))
    met = named.join(decoded.withColumn("decoded", F.lit(True)), "origin", "left")
    return met.select(*results.columns, F.when(F.col("dtype") == "image", F.coalesce("decoded", F.lit(False))).alias("decoded"))


PROBES = "path string, n_samples long, probes array<struct<sample: long, at: long, size: long, readable: boolean>>, error string"


def video_probes(media: DataFrame, seconds: float = SECONDS) -> DataFrame:
    """media (path, content): what is known of the first, middle and last sample of each film."""

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"]):
                found: list = []
                error = failure(lambda file: found.extend(film_probes(file)), "video", Reader.of(bytes(content or b""), seconds))
                if error is None and not any(p[3] for p in found):
                    error = "VideoReadError: no readable frames"
                probes = [dict(zip(("sample", "at", "size", "readable"), p)) for p in found]
                rows.append((path, found[-1][0] + 1 if found else 0, probes, error))
            yield pd.DataFrame(rows, columns=["path", "n_samples", "probes", "error"])

    return media.select("path", "content").mapInPandas(probe, PROBES)


def validate_frame_dirs(files: DataFrame) -> DataFrame:
    """files (folder, label, path, content): a folder is readable if its first, middle and last file are. Paths are ranked without the files' bytes."""
    from pyspark.sql import Window

    w = Window.partitionBy("folder")
    placed = files.select("folder", "path").withColumn("at", F.row_number().over(w.orderBy("path")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    picked = placed.filter("at = 0 or at = floor(n / 2) or at = n - 1").select("folder", "path").distinct()
    probes = files.join(picked, ["folder", "path"], "left_semi").select(F.col("path"), F.col("label").cast("int").alias("label"), F.lit("image").alias("dtype"), "content", "folder")
    checked = probes.mapInPandas(_checked(PROBERS, SECONDS, ("folder",)), RESULT + ", folder string")
    return checked.groupBy("folder", "label").agg(F.bool_and("ok").alias("ok"), F.min(F.when(~F.col("ok"), F.concat(file_name(F.col("path")), F.lit(": "), F.col("error")))).alias("error"))
