"""Media records from a file listing (path, length): image trees, video trees, frame folders, censuses.

On real trees the listing comes from ``file_listing``, which reads paths and sizes only. The
catalogue (kind, dataset, structure, class_dir, label) has a row per class folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from . import files

RECORD = ("path", "label", "dtype", "dataset", "source_split", "identity")


def file_listing(spark: SparkSession, root: str) -> DataFrame:
    """path, length, modificationTime of every file below root; the content column is never read. Spark leaves hidden files and folders out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return found.select("path", "length", "modificationTime")


def _below(listing: DataFrame, folder: str) -> DataFrame:
    """parts of the path after the segment ``folder``."""
    parts = P.segments(F.col("path"))
    at = F.array_position(parts, folder).cast("int")
    return listing.withColumn("parts", F.when(at > 0, F.slice(parts, at + 1, F.size(parts) - at))).filter("parts is not null")


def scan_images(listing: DataFrame, catalogue: DataFrame) -> DataFrame:
    """images/<dataset>/<split>/<class>/**: hidden splits are skipped, split names lower-cased, class names exact."""
    classes = catalogue.filter("kind = 'images'").select("dataset", "class_dir", "label")
    found = _below(listing.filter(P.is_image(F.col("path"))), "images").filter(F.size("parts") >= 4)
    named = found.select("path", F.get("parts", F.lit(0)).alias("dataset"), F.get("parts", F.lit(1)).alias("split"), F.get("parts", F.lit(2)).alias("class_dir"))
    kept = named.filter(~F.col("split").startswith(".")).join(classes, ["dataset", "class_dir"])
    return kept.select("path", "label", F.lit("image").alias("dtype"), "dataset", F.lower("split").alias("source_split"), F.col("path").alias("identity"))


def _videos(found: DataFrame) -> DataFrame:
    return found.select("path", "label", F.lit("video").alias("dtype"), "dataset", F.lit(None).cast("string").alias("source_split"), P.identity(F.col("path")).alias("identity"))


def scan_videos_flat(listing: DataFrame, catalogue: DataFrame) -> DataFrame:
    """videos/<dataset>/<class>/**"""
    classes = catalogue.filter("kind = 'videos' and structure = 'flat_class'").select("dataset", "class_dir", "label")
    found = _below(listing.filter(P.is_video(F.col("path"))), "videos").filter(F.size("parts") >= 3)
    return _videos(found.select("path", F.get("parts", F.lit(0)).alias("dataset"), F.get("parts", F.lit(1)).alias("class_dir")).join(classes, ["dataset", "class_dir"]))


def scan_videos_nested(listing: DataFrame, catalogue: DataFrame) -> DataFrame:
    """videos/<dataset>/**/<fake|real>/**: the rule folders may be at any depth; one record per file and rule that fits."""
    rules = catalogue.filter("kind = 'videos' and structure = 'deep_nested'").select("dataset", F.col("class_dir").alias("rule"), "label")
    found = _below(listing.filter(P.is_video(F.col("path"))), "videos").filter(F.size("parts") >= 3)
    named = found.select("path", F.get("parts", F.lit(0)).alias("dataset"), F.slice("parts", F.lit(2), F.size("parts") - 2).alias("folders"))
    return _videos(named.join(rules, "dataset").filter(F.array_contains("folders", F.col("rule"))))


def _folders(listing: DataFrame, root: str) -> DataFrame:
    """Folders below root that hold images directly, with their number."""
    found = _below(listing.filter(P.is_image(F.col("path"))), root)
    return found.groupBy(P.parent(F.col("path")).alias("path")).agg(F.count(F.lit(1)).alias("frames"), F.first("parts").alias("parts"))


def _frames(found: DataFrame, source: str) -> DataFrame:
    return found.select(
        "path", "label", F.lit("frame").alias("dtype"), "dataset", F.lit(None).cast("string").alias("source_split"), P.file_name(F.col("path")).alias("identity"), F.lit(source).alias("frame_source"), "frames"
    )


def scan_frames_mirror(listing: DataFrame, root: str = "preprocessed_frames") -> DataFrame:
    """A folder that holds images directly is one record; its label is read off its path, without one it is dropped."""
    found = _folders(listing, root).withColumn("label", P.label_by_segment(F.col("path"))).withColumn("dataset", F.get("parts", F.lit(0)))
    return _frames(found.filter("label is not null"), root)


def scan_frames_labelled(listing: DataFrame, root: str = "video-frames") -> DataFrame:
    """<root>/<label>/<dataset>/<video>: exactly that depth."""
    found = _folders(listing, root).filter(F.size("parts") == 4)
    label = F.when(F.get("parts", F.lit(0)) == "real", 1).when(F.get("parts", F.lit(0)) == "fake", 0)
    return _frames(found.withColumn("label", label).withColumn("dataset", F.get("parts", F.lit(1))).filter("label is not null"), root)


def listed_folders(catalogue: DataFrame, roots: tuple[str, ...] = ("preprocessed_frames", "video-frames")) -> list[str]:
    """The folders that discovery has rules for: a dataset's images or videos (a row or two of the catalogue each), and the frame roots."""
    return sorted(f"{r.kind}/{r.dataset}" for r in catalogue.select("kind", "dataset").distinct().collect()) + list(roots)


def listing_of(spark: SparkSession, root: str, catalogue: DataFrame) -> DataFrame:
    """file_listing of those folders alone; the rest of the tree is not listed."""
    there = [f"{root.rstrip('/')}/{f}" for f in listed_folders(catalogue) if files.exists(spark, f"{root.rstrip('/')}/{f}")]
    if not there:
        return spark.createDataFrame([], "path string, length long, modificationTime timestamp")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(there)
    return found.select("path", "length", "modificationTime")


def classified(listing: DataFrame, catalogue: DataFrame, hidden: bool = False) -> DataFrame:
    """One pass over the listing: each path with every rule that it fits.

    unit (the file, or the folder of a saved frame), kind, dataset, label, source_split, rule (class folder). Each path is cut into its rules' parts
    once, and all rules meet the catalogue in one join: images by their third part, flat videos by
    their second, nested ones by any folder. hidden: keep splits whose name begins with a dot, as a census does.
    """
    path = F.col("path")
    parts = P.segments(path)

    def below(folder: str) -> Column:
        at = F.array_position(parts, folder).cast("int")
        return F.when(at > 0, F.slice(parts, at + 1, F.size(parts) - at))

    part = lambda name, i: F.get(F.col(name), F.lit(i))
    split = listing.filter(P.is_image(path) | P.is_video(path)).select("path", P.is_image(path).alias("is_image"), below("images").alias("i"), below("videos").alias("v"), below("preprocessed_frames").alias("m"), below("video-frames").alias("f"))
    none, no_folders = F.lit(None).cast("string"), F.lit(None).cast("array<string>")

    def rule(fits: Column, kind: str, dataset: Column, class_dir: Column, source_split: Column, folders: Column, unit: Column, label: Column) -> Column:
        fields = {"kind": F.lit(kind), "dataset": dataset, "class_dir": class_dir, "source_split": source_split, "folders": folders, "unit": unit, "own_label": label}
        return F.when(fits, F.struct(*[v.alias(k) for k, v in fields.items()]))

    no_label, folder = F.lit(None).cast("int"), P.parent(path)
    shown = F.lit(True) if hidden else ~part("i", 1).startswith(".")
    labelled = F.when(part("f", 0) == "real", 1).when(part("f", 0) == "fake", 0)
    rules = F.array(
        rule(F.col("is_image") & (F.size("i") >= 4) & shown, "images", part("i", 0), part("i", 2), F.lower(part("i", 1)), no_folders, path, no_label),
        rule(~F.col("is_image") & (F.size("v") >= 3), "videos", part("v", 0), part("v", 1), none, F.slice("v", 2, F.size("v") - 2), path, no_label),
        rule(F.col("is_image") & F.col("m").isNotNull(), "preprocessed_frames", part("m", 0), none, none, no_folders, folder, P.label_by_segment(folder).cast("int")),
        rule(F.col("is_image") & (F.size("f") == 4), "video-frames", part("f", 1), none, none, no_folders, folder, labelled),
    )
    fitting = split.select(F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("r")).select("r.*")
    c = catalogue.select(F.col("kind").alias("c_kind"), F.col("dataset").alias("c_dataset"), "structure", F.col("class_dir").alias("c_class"), F.col("label").alias("c_label"))
    exact = (F.col("class_dir") == F.col("c_class")) & ((F.col("kind") == "images") | (F.col("structure") == "flat_class"))
    nested = (F.col("structure") == "deep_nested") & F.array_contains("folders", F.col("c_class"))
    met = fitting.join(c, (F.col("kind") == F.col("c_kind")) & (F.col("dataset") == F.col("c_dataset")) & (exact | nested), "left")
    return met.select("unit", "kind", "dataset", F.coalesce("own_label", "c_label").cast("int").alias("label"), "source_split", F.col("c_class").alias("rule")).filter("label is not null")


def discover(listing: DataFrame, catalogue: DataFrame) -> DataFrame:
    """All records: images, videos, frame folders, by one scan of the listing."""
    video, frame = F.col("kind") == "videos", ~F.col("kind").isin("images", "videos")
    rows = classified(listing, catalogue).groupBy("unit", "kind", "dataset", "label", "source_split", "rule").agg(F.count(F.lit(1)).alias("n"))
    return rows.select(
        F.col("unit").alias("path"), "label", F.when(video, "video").when(frame, "frame").otherwise("image").alias("dtype"), "dataset", "source_split",
        F.when(video, P.identity(F.col("unit"))).when(frame, P.file_name(F.col("unit"))).otherwise(F.col("unit")).alias("identity"), F.when(frame, F.col("kind")).alias("frame_source"), F.when(frame, F.col("n")).alias("frames"),
    )


def disk_census(listing: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Files by kind, dataset, split or class folder, and label, counted without discovery's rules: split names stay as they are, hidden ones count."""
    images = _below(listing.filter(P.is_image(F.col("path"))), "images").filter(F.size("parts") >= 4)
    images = images.select(F.lit("images").alias("kind"), F.get("parts", F.lit(0)).alias("dataset"), F.get("parts", F.lit(1)).alias("place"), F.get("parts", F.lit(2)).alias("class_dir"))
    videos = _below(listing.filter(P.is_video(F.col("path"))), "videos").filter(F.size("parts") >= 3)
    flat = videos.select(F.lit("videos").alias("kind"), F.get("parts", F.lit(0)).alias("dataset"), F.get("parts", F.lit(1)).alias("place"), F.get("parts", F.lit(1)).alias("class_dir"))
    exact = catalogue.filter("structure <> 'deep_nested'").select("kind", "dataset", "class_dir", "label")
    counted = images.unionByName(flat).join(exact, ["kind", "dataset", "class_dir"]).select("kind", "dataset", "place", "label")
    nested = videos.select(F.lit("videos").alias("kind"), F.get("parts", F.lit(0)).alias("dataset"), F.slice("parts", F.lit(2), F.size("parts") - 2).alias("folders"))
    rules = catalogue.filter("structure = 'deep_nested'").select("kind", "dataset", F.col("class_dir").alias("place"), "label")
    deep = nested.join(rules, ["kind", "dataset"]).filter(F.array_contains("folders", F.col("place"))).select("kind", "dataset", "place", "label")
    return counted.unionByName(deep).groupBy("kind", "dataset", "place", "label").agg(F.count(F.lit(1)).alias("n"))


def disk_census_mixed(listing: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Per kind, dataset and label: files, or folders with their saved frames, by one scan of the listing."""
    frame = ~F.col("kind").isin("images", "videos")
    units = classified(listing, catalogue, hidden=True).groupBy("kind", "dataset", "label", F.when(frame, F.col("unit")).alias("folder")).agg(F.count(F.lit(1)).alias("files"))
    kinds = units.groupBy(F.when(frame, "frames").otherwise(F.col("kind")).alias("kind"), "dataset", "label")
    counted = kinds.agg(F.sum(F.when(F.col("folder").isNull(), F.col("files")).otherwise(1)).alias("n"), F.sum(F.when(F.col("folder").isNotNull(), F.col("files"))).alias("frames"))
    return counted.select("kind", "dataset", "label", "n", "frames")
