"""Published totals: a corpus of 192,016 files is discovered whole, in one scan, and its images split as recorded; and gaps of run folders."""

import pytest
from pyspark.sql import functions as F

from reelgauge.operators import audit, runs, splits
from reelgauge.sources import scans

#: kind, dataset, structure, folders below the dataset, class folder, label, files.
CORPUS = [
    ("images", "a", "split_class", "test", "fake", 0, 6000), ("images", "a", "split_class", "test", "real", 1, 5997), ("images", "a", "split_class", "train", "fake", 0, 23998), ("images", "a", "split_class", "train", "real", 1, 23993),
    ("images", "b", "split_class", "test", "FAKE", 0, 10000), ("images", "b", "split_class", "test", "REAL", 1, 10000), ("images", "b", "split_class", "train", "FAKE", 0, 50000), ("images", "b", "split_class", "train", "REAL", 1, 50000),
    ("videos", "c", "flat_class", "", "Celeb-fake", 0, 5643), ("videos", "c", "flat_class", "", "Celeb-real", 1, 590), ("videos", "c", "flat_class", "", "YouTube-real", 1, 300),
    ("videos", "d", "deep_nested", "x/y", "fake", 0, 4066), ("videos", "d", "deep_nested", "x", "real", 1, 1363), ("videos", "e", "flat_class", "", "fake", 0, 33), ("videos", "e", "flat_class", "", "real", 1, 33),
]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = spark.createDataFrame(CORPUS, "kind string, dataset string, structure string, above string, class_dir string, label int, n int")
    names = F.concat_ws("/", F.lit("data"), "kind", "dataset", F.nullif("above", F.lit("")), "class_dir", F.concat("i", F.when(F.col("kind") == "images", ".jpg").otherwise(".mp4")))
    listing = rows.withColumn("i", F.explode(F.sequence(F.lit(1), "n"))).withColumn("i", F.col("i").cast("string")).select(names.alias("path"), F.lit(1).cast("long").alias("length"))
    return listing, rows.select("kind", "dataset", "structure", "class_dir", "label").distinct()


def test_totals_of_the_corpus(corpus):
    records = scans.discover(*corpus).cache()
    assert records.count() == 192_016
    assert {r.label: r.n for r in records.groupBy("label").agg(F.count("*").alias("n")).collect()} == {0: 99_740, 1: 92_276}
    assert {r.dtype: r.n for r in records.groupBy("dtype").agg(F.count("*").alias("n")).collect()} == {"image": 179_988, "video": 12_028}
    census = scans.disk_census_mixed(*corpus)
    assert {(r.dataset, r.label): r.n for r in census.collect()} == {(r.dataset, r.label): r["count"] for r in records.groupBy("dataset", "label").count().collect()}
    images = splits.split_image(records.filter("dtype = 'image'").select("path", "label", "dtype", "dataset", "source_split", "identity"))
    assert {r.split: r.n for r in images.groupBy("split").agg(F.count("*").alias("n")).collect()} == {"train": 125_792, "val": 22_199, "test": 31_997}
    train = audit.record_counts(splits.balance(images.filter("split = 'train'"))).filter("label is not null and dtype is null").collect()
    assert len({r.n for r in train}) == 1 and train[0].n >= 125_792 / 2
    records.unpersist()


def scanned(plan):
    return plan._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")


def test_one_scan_of_the_listing(spark, corpus, tmp_path):
    for name, df in zip(("listing", "catalogue"), corpus):
        df.write.parquet(f"{tmp_path}/{name}")
    listing, catalogue = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("listing", "catalogue"))
    assert scanned(scans.discover(listing, catalogue)) == 2 and scanned(scans.disk_census_mixed(listing, catalogue)) == 2  # the other is the catalogue


def test_one_pass_finds_what_the_rules_find_one_by_one(spark):
    paths = [
        "r/images/a/Train/real/1.PNG", "r/images/a/.hid/real/2.png", "r/images/a/test/other/3.jpg", "r/images/a/x.jpg", "r/videos/a/fake/1.mp4", "r/videos/d/real/x/fake/id1_2.mp4", "r/videos/d/fake.mp4", "r/videos/d/x/real/images/a/t/real/9.mp4",
        "r/images/a/t/real/videos/d/real/7.jpg", "r/preprocessed_frames/a/YouTube-real/v/0.jpg", "r/preprocessed_frames/a/YouTube-real/v/1.jpg", "r/preprocessed_frames/a/none/v/1.jpg", "r/video-frames/real/a/v/1.jpg", "r/video-frames/real/a/v/w/1.jpg", "r/video-frames/odd/a/v/1.jpg", "r/images/a/t/real/n.txt",
    ]
    listing = spark.createDataFrame([(p,) for p in paths], "path string")
    catalogue = spark.createDataFrame([("images", "a", "split_class", "real", 1), ("videos", "a", "flat_class", "fake", 0), ("videos", "d", "deep_nested", "fake", 0), ("videos", "d", "deep_nested", "real", 1)], "kind string, dataset string, structure string, class_dir string, label int")
    parts = [scans.scan_images(listing, catalogue), scans.scan_videos_flat(listing, catalogue), scans.scan_videos_nested(listing, catalogue), scans.scan_frames_mirror(listing), scans.scan_frames_labelled(listing)]
    apart = parts[0]
    for p in parts[1:]:
        apart = apart.unionByName(p, allowMissingColumns=True)
    columns = ["path", "label", "dtype", "dataset", "source_split", "identity", "frame_source", "frames"]
    rows = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert rows(scans.discover(listing, catalogue)) == rows(apart) and len(rows(apart)) == 8


def test_only_the_catalogue_s_folders_are_listed(spark, tmp_path):
    for name in ("images/a/t/real/1.png", "images/z/t/real/2.png", "videos/b/fake/3.mp4", "other/4.png", "video-frames/real/a/v/5.jpg"):
        f = tmp_path / name
        f.parent.mkdir(parents=True)
        f.write_bytes(b"1")
    catalogue = spark.createDataFrame([("images", "a", "split_class", "real", 1), ("videos", "b", "flat_class", "fake", 0), ("videos", "gone", "flat_class", "fake", 0)], "kind string, dataset string, structure string, class_dir string, label int")
    listing = scans.listing_of(spark, f"file://{tmp_path}", catalogue)
    assert sorted(r.path[-5:] for r in listing.collect()) == ["1.png", "3.mp4", "5.jpg"]
    assert {r.dtype for r in scans.discover(listing, catalogue).collect()} == {"image", "video", "frame"}
    assert scans.listing_of(spark, f"file://{tmp_path}/none", catalogue).count() == 0


def test_gaps_that_are_staged(spark):
    manifest = [("r1", "video", "convnext_base", "spatial", "none", 0.5), ("r2", "video", "convnext_base", "spatial", "focal", None), ("r3", "image", "convnext_base", "temporal", "none", 0.5), ("r4", "video", "convnext_base", "temporal", "weighted_ce", 0.1)]
    df = spark.createDataFrame(manifest, "run_name string, protocol string, model_name string, category string, loss_mode string, test_f1 double")
    assert sorted(map(tuple, runs.ablation_missing(df).collect())) == [("spatial", "focal"), ("spatial", "weighted_ce"), ("temporal", "focal"), ("temporal", "none")]
    files = spark.createDataFrame([("a", "config.json"), ("a", "history.csv"), ("b", "config.json")], "run_dir string, name string")
    assert {r.run_dir: (r.has_config, r.has_history, r.complete) for r in runs.run_completeness(files, ("config.json", "history.csv")).collect()} == {"a": (1, 1, True), "b": (1, 0, False)}
    lookup = spark.createDataFrame([("r1", "e1"), ("r2", "e1"), ("r3", "e2")], "run_name string, experiment_no string")
    assert {tuple(r) for r in runs.experiment_lookup(lookup).collect()} == {("e1", 2, "ambiguous", None), ("e2", 1, "found", "r3")}
    assert {tuple(r) for r in runs.experiment_candidates(lookup).collect()} == {("e1", "r1", 2), ("e1", "r2", 2)}


def test_runs_without_a_config_or_a_history_are_left_out(spark):
    text = "run_dir string, run_name string, experiment_no string, category string, model_name string, dataset_scope string, loss_mode string"
    row = lambda d: (d, d, "e", "c", "m", "all", "none")
    summaries = spark.createDataFrame([row(f"train/image/c/{d}") for d in "abc"], text).selectExpr("*", "1.0D as best_val_f1", "1.0D as best_val_acc", "named_struct('loss', 0D, 'acc', 1D, 'f1', 1D) as test_metrics", "'3' as best_epoch")
    configs = spark.createDataFrame([row(f"train/image/c/{d}") for d in "ab"], text).selectExpr("*", "'f' as family", "'f' as family_dir", "'5' as epochs", "'2' as batch_size", "'none' as seq_len")
    histories = spark.createDataFrame([("train/image/c/a", 1), ("train/image/c/a", 4), ("train/image/c/c", 1)], "run_dir string, epoch int")
    sizes = "struct<samples: long, fake: long, real: long>"
    none = spark.createDataFrame([], f"run_dir string, train {sizes}, val {sizes}, test {sizes}")
    assert [(r.run_name, r.epochs_observed, r.test_samples) for r in runs.assemble_runs(summaries, configs, histories, none).collect()] == [("train/image/c/a", 4, None)]
