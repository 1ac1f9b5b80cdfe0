"""Runs are read from their folders, each folder in one place."""

import json
import os

import pytest

from reelgauge.plans import queries
from reelgauge.plans.bindings import Bound
from reelgauge.sources import artifacts
from reelgauge.sources.scratch import scratch_dir

CONFIG = {"run_name": "", "category": "Spatial", "family": "some_net", "epochs": "9", "batch_size": "4"}


def put(folder, history="epoch,val_f1\n1,0.5\n", split=None, **names):
    folder.mkdir(parents=True)
    (folder / "final_summary.json").write_text(json.dumps({"run_name": folder.name, "test_metrics": {"acc": 0.5, "f1": 0.25}}))
    if "no_config" not in names:
        (folder / "config.json").write_text(json.dumps(CONFIG))
    if history is not None:
        (folder / "history.csv").write_bytes(history.encode())
    if split:
        (folder / "split_summary.json").write_text(json.dumps(split))


def test_runs_at_any_depth_with_whole_and_empty_histories(spark, tmp_path):
    put(tmp_path / "train/image/a b/r1", "val_f1, epoch\r\n0.5,3\r\n0.5,11\r\n0.5,x\r\n", {"test": {"samples": 7, "fake": 3, "real": 4}})
    put(tmp_path / "train/video/deep/er/r2", "epoch,val_f1\n")
    put(tmp_path / "train/video/deep/er/r2/r3", "")
    put(tmp_path / "train/video/r4", no_config=True)
    put(tmp_path / "train/video/r5", None)
    put(tmp_path / "train/video/.kept/r6")
    (tmp_path / "train/video/empty").mkdir()
    got = {r.run_name: (r.protocol, r.category, r.family, r.epochs_observed, r.epochs_configured, r.test_f1, r.test_samples, r.relative_dir) for r in artifacts.load_runs(spark, f"file://{tmp_path}").collect()}
    assert got == {
        "r1": ("image", "spatial", "some net", 11, 9, 0.25, 7, "train/image/a b/r1"),
        "r2": ("video", "spatial", "some net", 0, 9, 0.25, None, "train/video/deep/er/r2"),
        "r3": ("video", "spatial", "some net", 0, 9, 0.25, None, "train/video/deep/er/r2/r3"),
    }
    assert artifacts.load_runs(spark, f"file://{tmp_path}/none").count() == 0


def test_files_of_runs_are_not_listed_one_by_one(spark, tmp_path):
    for i in range(60):
        put(tmp_path / f"train/image/a/r{i}")
    runs = artifacts.load_runs(spark, f"file://{tmp_path}")
    assert runs.count() == 60 and len(runs.inputFiles()) < 20


@pytest.mark.parametrize("share", [70, 1000])
def test_shares_of_folders_make_up_all_runs(spark, sf_dir, monkeypatch, share):
    monkeypatch.setattr(queries, "_RUNS_A_SHARE", share)
    got = queries.QUERIES["load_run_folders"].run(spark, sf_dir)
    n = spark.read.parquet(f"{sf_dir}/part.parquet").count()
    assert got.count() == n == got.select("run_name").distinct().count()


def test_folders_of_a_share_are_gone_before_the_next(spark, sf_dir, monkeypatch):
    made = []
    monkeypatch.setattr(queries, "_RUNS_A_SHARE", 30)
    monkeypatch.setattr(queries, "scratch_dir", lambda *a: made.append(scratch_dir(*a)) or made[-1])
    rows = queries.QUERIES["load_run_folders"].run(spark, sf_dir).select("run_name", "test_samples").collect()
    manifest = Bound(spark, sf_dir).manifest.collect()
    assert {tuple(r) for r in rows} == {(m.run_name, m.test_real_samples + m.test_fake_samples if m.best_val_f1 is not None else None) for m in manifest}
    left = [f for top in made for d, _, names in os.walk(top.removeprefix("file://")) for f in names if f == "config.json"]
    assert not left
