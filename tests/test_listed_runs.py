"""Runs that share an experiment are listed, not only counted."""

from reelgauge.operators import runs
from reelgauge.plans.queries import QUERIES


def test_an_ambiguous_experiment_lists_its_matches(spark):
    lookup = spark.createDataFrame([("r2", "e1"), ("r1", "e1"), ("r3", "e2"), ("r5", None), (None, None), ("r4", None), ("r1", "e1"), (None, "e3")], "run_name string, experiment_no string")
    rows = {tuple(r) for r in runs.experiment_matches(lookup).collect()}
    assert rows == {("e1", 3, "ambiguous", None, "r1,r1,r2"), ("e2", 1, "found", "r3", "r3"), (None, 3, "ambiguous", None, "r4,r5"), ("e3", 1, "found", None, None)}


def test_every_run_is_among_its_experiment_s_matches(spark, sf_dir):
    got = QUERIES["experiment_lookup"].run(spark, sf_dir)
    n = spark.read.parquet(f"{sf_dir}/part.parquet").count()
    assert got.selectExpr("sum(matches) as n", "sum(size(split(run_names, ','))) as names").first() == (n, n)


def test_equal_results_list_their_runs(spark):
    kind = "run_name string, test_f1 double, best_val_f1 double"
    scored = spark.createDataFrame([("r2", 0.5, None), ("r1", 0.5, None), ("r3", 0.5, 0.25), ("r4", None, 0.5), ("r5", None, 0.5), ("r7", 0.25, 0.5), ("r10", 0.25, 0.5), ("r6", 0.25, 0.5)], kind)
    assert {(r.test_f1, r.best_val_f1, r.runs, r.first_run, r.run_names) for r in runs.duplicate_results(scored).collect()} == {(0.5, None, 2, "r1", "r1,r2"), (0.25, 0.5, 3, "r10", "r10,r6,r7")}
