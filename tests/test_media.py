import json
import struct
import zlib

import pytest

from reelgauge.functions import paths as P
from reelgauge.operators import media
from reelgauge.sources import artifacts, scans
from tests.test_containers import jpeg, mp4


def png():
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


@pytest.mark.parametrize(
    ("dtype", "data", "ok"),
    [
        ("image", png(), True), ("image", png()[:-10], False), ("image", png().replace(b"IDAT", b"IDAX"), False), ("image", b"", False), ("image", b"text", False),
        ("image", jpeg(), True), ("image", b"\xff\xd8\xff" + b"1" * 99, False),
        ("video", mp4(), True), ("video", mp4(()), False), ("video", mp4(index=False), False), ("video", b"", False), ("frame", b"x", False), ("image", None, False),
    ],
)
def test_readability(spark, dtype, data, ok):
    row = media.validate(spark.createDataFrame([("p", 1, dtype, data)], "path string, label int, dtype string, content binary")).first()
    assert row.ok is ok and (row.error is None) is ok


def test_listing_reads_no_contents_and_scans_find_the_files(spark, tmp_path):
    for name in ("images/a/Train/real/1.PNG", "images/a/.cache/real/2.png", "images/a/test/FAKE/3.jpg", "videos/b/x/fake/y/id7_id2_1.mp4", "preprocessed_frames/b/YouTube-real/v/000001.jpg", "preprocessed_frames/b/none/v/000001.jpg"):
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"1")
    listing = scans.file_listing(spark, str(tmp_path))
    assert "content" not in listing._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]
    catalogue = spark.createDataFrame([("images", "a", "split_class", "real", 1), ("images", "a", "split_class", "fake", 0), ("videos", "b", "deep_nested", "fake", 0), ("videos", "b", "deep_nested", "real", 1)], "kind string, dataset string, structure string, class_dir string, label int")
    found = {(r.dtype, r.dataset, r.label, r.source_split) for r in scans.discover(listing, catalogue).collect()}
    assert found == {("image", "a", 1, "train"), ("video", "b", 0, None), ("frame", "b", 1, None)}
    hidden = spark.createDataFrame([("x/images/a/.cache/real/2.png",)], "path string")  # Spark's own listing leaves hidden folders out
    listed = listing.select("path").unionByName(hidden)
    assert scans.scan_images(listed, catalogue).count() == 1
    census = {(r.place, r.n) for r in scans.disk_census(listed, catalogue).filter("kind = 'images'").collect()}
    assert census == {("Train", 1), (".cache", 1)}  # the census keeps what discovery skips


def test_the_two_label_rules_disagree(spark):
    df = spark.createDataFrame([("data/fake_set/real/a.mp4",), ("x/unreal/b.mp4",), ("x/ai/c.mp4",)], "path string")
    rows = df.select(P.label_by_segment(df.path).alias("a"), P.label_by_substring(df.path).alias("b")).collect()
    assert [(r.a, r.b) for r in rows] == [(1, 0), (None, 1), (0, 0)]


def test_run_folders(spark, tmp_path):
    run = tmp_path / "train/image/ViT/run1"
    run.mkdir(parents=True)
    (run / "final_summary.json").write_text(json.dumps({"run_name": "", "test_metrics": {"f1": 0.5}}))
    (run / "config.json").write_text(json.dumps({"run_name": "r1", "dataset_names": "only"}))
    (run / "history.csv").write_text("epoch,val_f1\n1,0.5\n2,0.7\n")
    history = artifacts.read_history(spark, str(tmp_path))
    assert [r.lr for r in history.collect()] == [None, None]
    configs = artifacts.read_configs(spark, str(tmp_path))
    assert configs.first().dataset_names == ["only"]
    summaries = artifacts.read_documents(spark, str(tmp_path), "final_summary.json", artifacts.SUMMARY)
    from reelgauge.operators.runs import assemble_runs

    splits = spark.createDataFrame([], "run_dir string, " + artifacts.SPLIT_SUMMARY)
    row = assemble_runs(summaries, configs, history, splits).first()
    assert (row.run_name, row.family, row.protocol, row.epochs_observed, row.test_f1, row.test_samples) == ("r1", "ViT", "image", 2, 0.5, None)


def test_export_of_nothing_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError):
        artifacts.write_predictions(spark.createDataFrame([], "label int, pred_label int, prob_real double"), str(tmp_path / "x"))
    assert artifacts.usable_predictions(spark.createDataFrame([(1,)], "label int")) is None


def test_histories_are_read_by_their_own_headers(spark, tmp_path):
    files = {"a": "epoch,val_f1\n1,0.5\n2,0.6\n", "b": "epoch,lr,val_f1\r\n1,0.01,0.7\r\n", "c": "val_f1,epoch,note\n0.8,1,x\n,2\n", "d": "epoch,val_f1\n", "e": ""}
    for run, text in files.items():
        (tmp_path / run).mkdir()
        (tmp_path / run / "history.csv").write_bytes(text.encode())
    got = {(r.run_dir.rpartition("/")[2], r.epoch): (r.lr, r.val_f1) for r in artifacts.read_history(spark, str(tmp_path)).collect()}
    assert got == {("a", 1): (None, 0.5), ("a", 2): (None, 0.6), ("b", 1): (0.01, 0.7), ("c", 1): (None, 0.8), ("c", 2): (None, None)}


def test_documents_of_several_lines(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "config.json").write_text(json.dumps({"run_name": "r1", "dataset_names": ["x", "y"]}, indent=2))
    (tmp_path / "r" / "final_summary.json").write_text(json.dumps({"run_name": "r1", "test_metrics": {"f1": 0.5}}, indent=2))
    assert [(r.run_name, r.dataset_names) for r in artifacts.read_configs(spark, str(tmp_path)).collect()] == [("r1", ["x", "y"])]
    assert [(r.run_name, r.test_metrics.f1) for r in artifacts.read_documents(spark, str(tmp_path), "final_summary.json", artifacts.SUMMARY).collect()] == [("r1", 0.5)]


def test_repair_deletes_moves_and_tallies(spark, tmp_path):
    from reelgauge.operators import audit

    root = tmp_path / "data"
    (root / "a").mkdir(parents=True)
    names = ["a/one.png", "a/two.png", "a/gone.png", "three.png"]
    for name in names:
        if "gone" not in name:
            (root / name).write_bytes(b"x")
    results = spark.createDataFrame([(f"{root}/{n}", n == "three.png") for n in names] + [("/elsewhere/x.png", False)], "path string, ok boolean")
    tally = lambda action: audit.repair_tally(audit.apply_repair(audit.repair_plan(results, action, str(root), f"{tmp_path}/kept"))).first()
    assert tuple(tally("report")) == (0, 0, 0)
    assert sorted(p.name for p in root.rglob("*.png")) == ["one.png", "three.png", "two.png"]
    assert tuple(tally("quarantine")) == (0, 2, 2)
    assert tuple(tally("quarantine")) == (0, 2, 2)  # a task that runs again
    assert sorted(p.name for p in (tmp_path / "kept" / "a").iterdir()) == ["one.png", "two.png"]
    (root / "a" / "one.png").write_bytes(b"x")
    assert tuple(tally("delete")) == (1, 0, 3)
    assert [p.name for p in root.rglob("*.png")] == ["three.png"]


def test_predictions_are_read_by_their_own_headers_in_ranges(spark, tmp_path):
    from reelgauge.sources import headed_csv

    files = {
        "a": "label,pred_label,prob_real\n1,0,0.25\n0,0,nan\n", "b": "path,label,pred_label,prob_real\r\n\"x,1\",1,1,0.5\r\ny,oops,1,\r\n", "c": "\ufeffprob_real, label ,note,pred_label\n0.75,1\n\n0.5,0,n,1",
        "d": "label,pred_label\n1,1\n", "e": "label,pred_label,prob_real\n", "f": "",
    }
    for run, text in files.items():
        (tmp_path / run).mkdir()
        (tmp_path / run / "predictions.csv").write_bytes(text.encode())
    (tmp_path / "a" / "other.csv").write_text("label,pred_label,prob_real\n9,9,9\n")
    got = {(r.file.split("/")[-2], r.path, r.label, r.pred_label, str(r.prob_real)) for r in artifacts.read_predictions(spark, str(tmp_path), "predictions.csv").collect()}
    assert got == {("a", None, 1, 0, "0.25"), ("a", None, 0, 0, "nan"), ("b", "x,1", 1, 1, "0.5"), ("b", "y", None, 1, "None"), ("c", None, 1, None, "0.75"), ("c", None, 0, 1, "0.5")}
    assert artifacts.read_predictions(spark, str(tmp_path / "f")).count() == 0 and artifacts.read_predictions(spark, str(tmp_path / "none")).count() == 0
    big = tmp_path / "big.csv"
    big.write_text("label,pred_label,prob_real\n" + "".join(f"{i % 2},1,{'0' * (i % 13)}{i}\n" for i in range(5000)))
    headed_csv.register(spark)
    for size in (61, 1000, 10**6):
        df = spark.read.format("headed_csv").options(path=str(big), columns="label,prob_real", range_bytes=str(size)).load() if size > 61 else None
        data, begin = big.read_bytes()[: 40_000], 27
        ranges = [list(headed_csv.lines_in(lambda at, n: data[at : at + min(n, 7)], len(data), a, min(a + size, len(data)), begin)) for a in range(0, len(data), size)]
        assert [x for r in ranges for x in r] == data[begin:].splitlines()
        assert df is None or (df.count() == 5000 and df.agg({"prob_real": "count"}).first()[0] == 5000 and df.selectExpr("sum(cast(prob_real as long))").first()[0] == sum(range(5000)))
