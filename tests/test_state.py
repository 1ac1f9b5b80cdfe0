"""Tables that live on between runs: buckets rewritten, writers side by side, logs over restarts, repairs run again."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from reelgauge.operators import audit, extraction
from reelgauge.sources import artifacts, files
from reelgauge.sources.state import SnapshotLog, StateTable
from reelgauge.streaming import bad_media

SCHEMA = "source_path string, source_frame_count long, frame_stride int, max_frames int, saved_frame_count int"


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_second_run_plans_and_rewrites_only_what_changed(spark, tmp_path):
    state = StateTable(spark, f"file://{tmp_path}/state", SCHEMA, "source_path", buckets=8)
    assert state.read().count() == 0 and state.versions() == []
    videos = spark.createDataFrame([(f"v{i}", 10 * i) for i in range(1, 41)], "path string, frame_count long")
    none = spark.createDataFrame([], "source_path string, saved long")
    first = extraction.extraction_plan(videos, state.read(), none, 5, None)
    assert {r.decision for r in first.collect()} == {"extract"}
    assert state.upsert(extraction.manifest_rows(first.join(videos, "path"), 5, None)) == 1
    saved = first.select(F.col("path").alias("source_path"), F.col("expected").cast("long").alias("saved"))
    changed = videos.withColumn("frame_count", F.when(F.col("path") == "v7", 200).otherwise(F.col("frame_count")))
    second = extraction.extraction_plan(changed, state.read(), saved, 5, None).filter("decision <> 'skipped'")
    assert rows(second, "path", "decision", "reason") == [("v7", "refresh", "partial_or_mismatched_frame_count")]
    before = state.folders()
    assert state.upsert(extraction.manifest_rows(second.join(changed, "path"), 5, None)) == 2
    after = state.folders()
    assert sum(before[b] != after[b] for b in before) == 1 and len(before) == len(after)
    assert state.read().count() == 40 and rows(state.read().filter("source_path = 'v7'"), "source_frame_count", "saved_frame_count") == [(200, 40)]
    assert rows(state.read(1).filter("source_path = 'v7'"), "source_frame_count") == [(70,)]
    assert len(state.vacuum(2)) == 0 and state.versions() == [2] and state.read().count() == 40  # the other buckets still lie in the first folder


def test_repeats_null_keys_and_unfinished_versions(spark, tmp_path):
    state = StateTable(spark, f"file://{tmp_path}/state", "k string, n long", "k", buckets=2)
    state.upsert(spark.createDataFrame([("a", 1), ("a", 3), (None, 5), ("b", None)], "k string, n long"))
    assert sorted(rows(state.read(), "k", "n"), key=str) == [("a", 3), ("b", None)]
    (tmp_path / "state" / "versions" / "000000000002.json").write_text('{"fold')
    assert state.read().count() == 2
    assert state.upsert(spark.createDataFrame([("c", 1)], "k string, n long")) == 3 and state.read().count() == 3
    assert state.upsert(spark.createDataFrame([], "k string, n long")) == 4 and state.read().count() == 3


def test_two_writers_lose_nothing(spark, tmp_path):
    root, errors = f"file://{tmp_path}/state", []

    def write(name):
        try:
            for i in range(3):
                StateTable(spark, root, "k string, n long", "k", buckets=2).upsert(spark.createDataFrame([(f"{name}{i}", i)], "k string, n long"))
        except Exception as error:  # seen by the test
            errors.append(error)

    writers = [threading.Thread(target=write, args=(n,)) for n in "xy"]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    state = StateTable(spark, root, "k string, n long", "k", buckets=2)
    assert not errors and rows(state.read(), "k") == [(f"{n}{i}",) for n in "xy" for i in range(3)] and state.versions() == list(range(1, 7))
    assert state.vacuum(6) and rows(state.read(), "k") == [(f"{n}{i}",) for n in "xy" for i in range(3)]


def test_snapshots_between_any_two_times(spark, tmp_path):
    log = SnapshotLog(spark, f"file://{tmp_path}/log", "dataset string, n long", ["dataset"])
    census = lambda **n: spark.createDataFrame(list(n.items()), "dataset string, n long")
    assert log.read().count() == 0
    log.add(census(a=5, b=7), "2024-01-01")
    log.add(census(a=1), "2024-03-01")
    log.add(census(a=6, c=2), "2024-02-01")
    log.add(census(a=6, c=2), "2024-02-01")  # a run that is repeated
    assert rows(log.drift("2024-01-01", "2024-03-01"), "dataset", "before", "after", "change") == [("a", 5, 1, -4), ("b", 7, 0, -7)]
    assert rows(log.history(), "taken", "dataset", "change") == [("2024-02-01", "a", 1), ("2024-02-01", "b", -7), ("2024-02-01", "c", 2), ("2024-03-01", "a", -5), ("2024-03-01", "c", -2)]


def event(ts, path):
    return json.dumps({"ts": ts, "path": path, "stage": "open", "detail": "d", "backend": "auto", "mode": "clip", "seq_len": 16})


def arrive(folder, name, *events):
    folder.mkdir(exist_ok=True, parents=True)
    (folder / name).write_text("\n".join(events) + "\n")


def test_sessions_over_restarts_replays_and_compaction(spark, tmp_path):
    root = f"file://{tmp_path}/log"
    logs = {name: bad_media.SessionLog(spark, root, name) for name in ("s1", "s2")}

    def append(name):
        logs[name].append(bad_media.read_log(spark, str(tmp_path / "in"), artifacts.BAD_MEDIA, 1), f"file://{tmp_path}/state/{name}")

    counted = lambda: rows(bad_media.read_sessions(spark, root, artifacts.BAD_MEDIA).groupBy("session", "path").count(), "session", "path", "count")
    assert bad_media.read_sessions(spark, root, artifacts.BAD_MEDIA).count() == 0
    arrive(tmp_path / "in", "a.json", event(1, "p"), event(2, "p"), event(3, ""), event(4, "q"))
    arrive(tmp_path / "in", "b.json", event(5, "q"), event(6, "r"))
    append("s1")
    assert counted() == [("s1", "p", 1), ("s1", "q", 1), ("s1", "r", 1)]
    append("s2")  # once per path and session: another session logs them again
    arrive(tmp_path / "in", "c.json", event(7, "p"), event(8, "t"))
    append("s1")
    want = [("s1", x, 1) for x in "pqrt"] + [("s2", x, 1) for x in "pqr"]
    assert counted() == want
    replay = spark.read.schema(artifacts.BAD_MEDIA).json(logs["s1"].parts()[0])
    logs["s1"].write_batch(spark.createDataFrame(replay.collect(), replay.schema), 0)
    assert counted() == want  # a batch that is run again replaces itself
    logs["s1"].compact()
    assert counted() == want and len(logs["s1"].parts()) == 1
    logs["s1"].compact()
    arrive(tmp_path / "in", "d.json", event(9, "u"))
    append("s1")
    append("s2")
    assert counted() == sorted(want + [("s1", "u", 1), ("s2", "t", 1), ("s2", "u", 1)])
    logs["s1"].compact()
    assert counted() == sorted(want + [("s1", "u", 1), ("s2", "t", 1), ("s2", "u", 1)])


def test_batches_left_behind_by_a_killed_compaction_count_once(spark, tmp_path):
    log = bad_media.SessionLog(spark, f"file://{tmp_path}/log", "s")
    for i, path in enumerate("abc"):
        log.write_batch(spark.createDataFrame([(1.0, path)], "ts double, path string"), i)
    kept = files.delete
    try:
        files.delete = lambda *a: (_ for _ in ()).throw(KeyboardInterrupt())
        with pytest.raises(KeyboardInterrupt):
            log.compact()
    finally:
        files.delete = kept
    assert rows(bad_media.read_sessions(spark, f"file://{tmp_path}/log", artifacts.BAD_MEDIA), "path") == [("a",), ("b",), ("c",)]


def test_stream_state_over_two_starts_and_late_rows(spark, tmp_path):
    hour = 3600

    def run():
        events = bad_media.read_log(spark, str(tmp_path / "in"), artifacts.BAD_MEDIA, 1).select(F.col("ts").cast("timestamp").alias("ts"), "path")
        return rows(bad_media.run_to_table(bad_media.deduplicated(events, "1 hour"), "t", f"file://{tmp_path}/state", f"file://{tmp_path}/out").groupBy("path").count(), "path", "count")

    arrive(tmp_path / "in", "a.json", event(10 * hour, "p"), event(10 * hour + 60, "p"))
    arrive(tmp_path / "in", "b.json", event(10 * hour + 120, "p"), event(10 * hour, "q"))
    assert run() == [("p", 1), ("q", 1)]  # two micro-batches
    arrive(tmp_path / "in", "c.json", event(10 * hour + 300, "p"), event(10 * hour + 300, "r"))
    assert run() == [("p", 1), ("q", 1), ("r", 1)]  # the state came back after the stop
    arrive(tmp_path / "in", "d.json", event(20 * hour, "s"))
    run()
    arrive(tmp_path / "in", "e.json", event(11 * hour, "late"), event(20 * hour + 1, "p"))
    assert run() == [("p", 2), ("q", 1), ("r", 1), ("s", 1)]  # beyond the watermark: late rows are dropped, p's state has gone


def test_repair_that_was_killed_has_the_same_tally(spark, tmp_path):
    data, ledger = tmp_path / "data", f"file://{tmp_path}/ledger"
    data.mkdir()
    for n in range(12):
        (data / f"{n}.png").write_bytes(b"x")
    results = spark.createDataFrame([(f"file://{data}/{n}.png", False) for n in range(14)], "path string, ok boolean")  # two were never there
    plan = audit.repair_plan(results, "delete", f"file://{data}", f"file://{tmp_path}/kept")
    act = audit._act
    try:
        audit._act = lambda batches: (_ for _ in ()).throw(RuntimeError("killed"))
        with pytest.raises(Exception, match="killed"):
            audit.apply_repair(plan, ledger)
    finally:
        audit._act = act
    for n in range(5):
        (data / f"{n}.png").unlink()  # what a task that was lost before it could report had done
    tally = tuple(audit.repair_tally(audit.apply_repair(plan, ledger)).first())
    assert tally == (12, 0, 2) and not list(data.iterdir())
    assert tuple(audit.repair_tally(audit.apply_repair(plan, ledger)).first()) == tally  # nothing is left to do
    assert audit.apply_repair(plan, ledger).count() == 14


def test_scratch_tables_go_when_they_are_dropped(spark):
    from reelgauge.sources.scratch import drop_scratch, scratch_dir

    a, b = scratch_dir(spark, "one"), scratch_dir(spark, "two")
    for path in (a, b):
        spark.range(3).write.parquet(path)
    assert drop_scratch(spark, keep=(b,)) >= 1 and not files.exists(spark, a) and spark.read.parquet(b).count() == 3
    assert drop_scratch(spark) == 1 and not files.exists(spark, b) and drop_scratch(spark) == 0
