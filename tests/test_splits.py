from pyspark.sql import functions as F

from reelgauge.operators import sampling, splits

RECORD = "path string, label int, dtype string, dataset string, source_split string, identity string"


def records(spark, n, dtype="video", split=None, people=None):
    rows = [(f"{dtype}/{i}", int(i % 4 == 0), dtype, f"d{i % 2}", split, f"p{i % (people or n)}") for i in range(n)]
    return spark.createDataFrame(rows, RECORD)


def sizes(df):
    return {r.split: r.n for r in df.groupBy("split").agg(F.count("*").alias("n")).collect()}


def test_double_cut_leaves_val_empty_at_ten(spark):
    assert sizes(splits.split_grouped(records(spark, 10), 0.7, 0.1, [])) == {"train": 7, "test": 3}
    assert sizes(splits.split_grouped(records(spark, 30), 0.7, 0.1, [])) == {"train": 21, "val": 2, "test": 7}


def test_identities_stay_together_on_any_partitioning(spark):
    df = records(spark, 400, people=37)
    one = splits.split_video(df).select("path", "split")
    assert one.join(df, "path").groupBy("dataset", "identity").agg(F.count_distinct("split").alias("n")).filter("n > 1").isEmpty()
    two = splits.split_video(df.repartition(13)).select("path", "split")
    assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


def test_image_split_keeps_test_and_cuts_val(spark):
    df = records(spark, 200, "image", "train").unionByName(records(spark, 40, "other", "test")).unionByName(records(spark, 6, "odd", "valid"))
    out = splits.split_image(df)
    assert sizes(out) == {"train": 170, "val": 30, "test": 40}  # unknown names vanish


def test_image_split_without_source_splits_goes_by_identity(spark):
    per_dataset = int(10 * (0.7 + 0.2))
    assert sizes(splits.split_image(records(spark, 20, "image"))) == {"train": 14, "val": 2 * (per_dataset - 7), "test": 2 * (10 - per_dataset)}


def test_balance_evens_train_only(spark):
    out = splits.prepare_records(records(spark, 400, people=400), "video")
    train = out.filter("split = 'train'").groupBy("label").count().collect()
    assert len({r["count"] for r in train}) == 1
    assert out.filter("split <> 'train' and copy > 1").isEmpty()
    single = splits.balance(records(spark, 8).withColumn("label", F.lit(1)))
    assert single.count() == 8


def test_empty_records(spark):
    assert splits.prepare_records(records(spark, 0)).count() == 0


def test_clips_and_strides(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 5, 16, 17, 100)], "n long")
    clips = {r.n: r.c for r in df.select("n", sampling.contiguous_clip(F.col("n"), 16).alias("c")).collect()}
    assert all(len(c) == 16 for c in clips.values())
    assert clips[0] == [0] * 16 and clips[5] == [0, 1, 2, 3, 4] + [4] * 11 and clips[100][0] == 42
    picked = df.select("n", sampling.stride_indices(F.col("n"), F.lit(3), F.lit(4)).alias("s")).collect()
    assert {r.n: r.s for r in picked} == {0: [], 1: [0], 5: [0, 3], 16: [0, 3, 9, 15], 17: [0, 3, 9, 15], 100: [0, 33, 66, 99]}
