"""The stream of bad-media events: one per path, over restarts, and a log that sessions write side by side."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files


def deduplicated(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """events (ts timestamp, path, ...): the first arrival of each path within the watermark. Events later than that are dropped."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["path"])


def read_log(spark: SparkSession, folder: str, schema: str, files_a_batch: int | None = None) -> DataFrame:
    """JSON lines that keep arriving in a folder."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).json(folder)


def run_to_table(stream: DataFrame, name: str, checkpoint: str, path: str) -> DataFrame:
    """Process what is there and stop; the parquet sink's files are the result. A later start with the same checkpoint goes on where this one stopped."""
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", path).queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


class SessionLog:
    """A JSON-lines log below root that many sessions append to, each in a folder of its own: at most one event a path and session.

    The paths that a session has logged are the state of its stream, kept by the checkpoint, so no log is read again. A
    micro-batch writes the folder of its number and replaces it when it is run again, so a restart loses and repeats nothing.
    compact() joins a session's batches into one folder and then names it in a marker; readers follow the last marker.
    """

    def __init__(self, spark: SparkSession, root: str, session: str):
        self.spark, self.root, self.session = spark, root.rstrip("/"), session
        self.folder = f"{self.root}/session={session}"

    def write_batch(self, events: DataFrame, batch: int) -> None:
        events.withColumn("session", F.lit(self.session)).write.mode("overwrite").json(f"{self.folder}/batch-{batch:012d}")

    def append(self, events: DataFrame, checkpoint: str) -> None:
        """Log what has arrived and stop."""
        first = events.filter("path is not null and path <> ''").dropDuplicates(["path"])
        query = first.writeStream.foreachBatch(self.write_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()

    def parts(self) -> list[str]:
        """Folders that hold the session's events."""
        names = files.names_in(self.spark, self.folder)
        upto, parts = "", []
        for marker in [n for n in names if n.startswith("marker-")][-1:]:
            said = json.loads(files.read_text(self.spark, f"{self.folder}/{marker}"))
            upto, parts = said["upto"], [said["folder"]]
        return [f"{self.folder}/{n}" for n in parts + [n for n in names if n.startswith("batch-") and n > upto]]

    def compact(self) -> None:
        """Join the batches that are complete; only then is the marker written, and only then do the batches go."""
        names = files.names_in(self.spark, self.folder)
        batches = [n for n in names if n.startswith("batch-") and files.exists(self.spark, f"{self.folder}/{n}/_SUCCESS")]
        parts = self.parts()
        if not batches or len(parts) < 2:
            return
        name = f"compact-{uuid.uuid4().hex}"
        self.spark.read.text(parts).coalesce(1 + len(parts) // 64).write.text(f"{self.folder}/{name}")
        marker = f"marker-{1 + sum(n.startswith('marker-') for n in names):012d}.json"
        if files.create_new(self.spark, f"{self.folder}/{marker}", json.dumps({"upto": batches[-1], "folder": name})):
            for n in [*batches, *[x for x in names if x.startswith("compact-")]]:
                files.delete(self.spark, f"{self.folder}/{n}")


def read_sessions(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Events of all sessions, with the session."""
    sessions = [n.partition("=")[2] for n in files.names_in(spark, root) if n.startswith("session=")]
    parts = [p for s in sessions for p in SessionLog(spark, root, s).parts()]
    return spark.read.schema(f"{schema}, session string").json(parts) if parts else spark.createDataFrame([], f"{schema}, session string")
