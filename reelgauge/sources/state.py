"""Tables that live on between runs: rows by key in buckets, with versions; snapshots by time.

A StateTable's data are Parquet folders, one for each bucket of keys. A version is a small file that names the folder of every bucket. An upsert reads and
rewrites only the buckets that its rows touch, into new folders, and then creates the next version's file, which fails
if another writer has created it: the loser reads the new version and merges again, so nothing is lost. Folders of
versions that nobody reads any more go with ``vacuum``.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import files


class StateTable:
    def __init__(self, spark: SparkSession, root: str, schema: str, key: str, buckets: int = 64):
        """buckets: fixed by the first version; a bucket should fit a task."""
        self.spark, self.root, self.schema, self.key, self.buckets = spark, root.rstrip("/"), schema, key, buckets

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in files.names_in(self.spark, f"{self.root}/versions") if n.endswith(".json") and n[0].isdigit()]

    def folders(self, version: int | None = None) -> dict[int, str]:
        """Folder of each bucket that has rows; an unfinished version file counts as the version before it."""
        known = [v for v in self.versions() if version is None or v <= version]
        for v in reversed(known):
            try:
                said = json.loads(files.read_text(self.spark, f"{self.root}/versions/{v:012d}.json"))
            except ValueError:
                continue
            return {int(b): f for b, f in said["folders"].items()}
        return {}

    def _rows(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/data/{f}" for f in folders])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the last one if none is given."""
        return self._rows(sorted(self.folders(version).values()))

    def upsert(self, changes: DataFrame, note: str = "") -> int:
        """Put rows in the place of those with their keys; returns the version. Null keys are left out; of rows that share a key the greatest stays."""
        columns = self.spark.createDataFrame([], self.schema).columns
        fresh = changes.select(*columns).filter(F.col(self.key).isNotNull())
        fresh = fresh.groupBy(self.key).agg(F.max(F.struct(*[c for c in columns if c != self.key])).alias("rest")).select(self.key, "rest.*").select(*columns)
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        own = f"{self.root}/changes/{uuid.uuid4().hex}"
        fresh.withColumn("bucket", bucket).write.partitionBy("bucket").parquet(own)
        touched = sorted(int(n.partition("=")[2]) for n in files.names_in(self.spark, own) if n.startswith("bucket="))
        fresh = self.spark.read.schema(f"{self.schema}, bucket int").parquet(own)
        while True:
            number, before = max(self.versions(), default=0), self.folders()
            old = self._rows([before[b] for b in touched if b in before]).join(fresh.select(self.key), self.key, "left_anti")
            merged = old.select(*columns).withColumn("bucket", bucket).unionByName(fresh.select(*columns, "bucket"))
            name = uuid.uuid4().hex
            if touched:
                merged.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.root}/data/{name}")
            after = before | {b: f"{name}/bucket={b}" for b in touched}
            said = json.dumps({"folders": {str(b): f for b, f in after.items()}, "touched": touched, "note": note})
            if files.create_new(self.spark, f"{self.root}/versions/{number + 1:012d}.json", said):
                files.delete(self.spark, own)
                return number + 1

    def vacuum(self, keep_from: int) -> list[str]:
        """Forget the versions before keep_from and delete data that no later version names; not while older versions are read or rows are upserted."""
        kept = [v for v in self.versions() if v >= keep_from]
        used = {f.split("/")[0] for v in kept for f in self.folders(v).values()}
        for v in set(self.versions()) - set(kept):
            files.delete(self.spark, f"{self.root}/versions/{v:012d}.json")
        gone = [n for n in files.names_in(self.spark, f"{self.root}/data") if n not in used]
        for n in gone:
            files.delete(self.spark, f"{self.root}/data/{n}")
        return gone


class SnapshotLog:
    """Censuses by the time they were taken: keys and one number. A census that is added again at its time replaces itself."""

    def __init__(self, spark: SparkSession, root: str, schema: str, keys: list[str], number: str = "n"):
        self.spark, self.root, self.schema, self.keys, self.number = spark, root.rstrip("/"), schema, keys, number

    def add(self, census: DataFrame, taken: str) -> None:
        census.select(*self.keys, self.number).write.mode("overwrite").parquet(f"{self.root}/taken={taken}")

    def read(self) -> DataFrame:
        if not files.names_in(self.spark, self.root):
            return self.spark.createDataFrame([], f"{self.schema}, taken string")
        return self.spark.read.schema(f"{self.schema}, taken string").option("basePath", self.root).parquet(self.root)

    def drift(self, before: str, after: str) -> DataFrame:
        """Keys, before, after, change between two times; a key that one lacks counts 0 there."""
        at = lambda t: F.coalesce(F.sum(F.when(F.col("taken") == t, F.col(self.number))), F.lit(0))
        both = self.read().filter(F.col("taken").isin(before, after)).groupBy(*self.keys).agg(at(before).alias("before"), at(after).alias("after"))
        return both.withColumn("change", F.col("after") - F.col("before"))

    def history(self) -> DataFrame:
        """Keys, taken, before, after, change for every key at every time after the first, in which the key's absence counts 0."""
        log = self.read()
        times = log.select("taken").distinct()
        steps = times.withColumn("previous", F.lag("taken").over(Window.orderBy("taken"))).filter("previous is not null")  # one row a snapshot
        side = lambda t, name: log.select(*self.keys, F.col("taken").alias(t), F.col(self.number).alias(name))
        ends = side("taken", "after").join(F.broadcast(steps), "taken")
        starts = side("previous", "before").join(F.broadcast(steps), "previous")
        out = starts.join(ends, [*self.keys, "taken", "previous"], "full").select(*self.keys, "taken", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))
        return out.withColumn("change", F.col("after") - F.col("before"))
