"""Quantiles by selection against Spark's own, with cells so small that several rounds are needed; confusion counts in closed form against all candidates."""

import random

import pytest
from pyspark.sql import functions as F

from reelgauge.operators import metrics
from reelgauge.operators.quantiles import quantiles

FRACTIONS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


@pytest.mark.parametrize("few", [3, 50_000])
def test_quantiles(spark, few):
    rng = random.Random(few)
    rows = [("a", rng.gauss(0, 1) * 10 ** rng.randint(-3, 12)) for _ in range(1500)] + [("b", float(rng.randint(0, 5))) for _ in range(500)] + [("c", 3.5), ("d", None), (None, 1.0), (None, 4.0)]
    rows += [("e", x) for x in (float("inf"), float("-inf"), 1.0, 2.0, 5e-324, -1.7e308, 1.7e308)]
    df = spark.createDataFrame(rows, "g string, v double")
    want = {r.g: (list(r.q), list(r.d)) for r in df.filter("v is not null").groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, FRACTIONS))).alias("q"), *[F.array(*[F.expr(f"percentile_disc({f}) within group (order by v)") for f in FRACTIONS]).alias("d")]).collect()}
    for discrete in (False, True):
        got = {r.g: list(r.q) for r in quantiles(df, ["g"], "v", FRACTIONS, discrete, few).collect()}
        assert set(got) == set(want)
        for g in got:
            assert all(a == b or a != a and b != b or abs(a - b) <= 1e-9 * abs(b) for a, b in zip(got[g], want[g][discrete])), g


def test_quantiles_of_all_rows_and_of_none(spark):
    df = spark.range(1, 102).withColumn("v", F.col("id").cast("double"))
    assert quantiles(df, [], "v", [0.5, 0.25], few=10).first().q == [51.0, 26.0]
    assert quantiles(df.limit(0), [], "v", [0.5]).count() == 0
    nan = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),)], "v double")
    assert quantiles(nan, [], "v", [0.5], few=1).first().q == [2.0]


def brute(acc, f1, p, q, reach=400):
    best = None
    wrong = (1 - acc) * (p + q)
    for e in {max(0, int(x)) for x in (round(wrong), wrong // 1, -(-wrong // 1))}:
        centre = round(p if f1 >= 0.999999 else f1 * e / max(1e-9, 2 * (1 - f1)))
        for tp in range(max(0, centre - reach), min(p, centre + reach) + 1):
            fp, tn = e - (p - tp), q - e + (p - tp)
            if fp < 0 or tn < 0:
                continue
            miss = abs((tp + tn) / (p + q) - acc) + abs((2 * tp / (2 * tp + e) if tp + e else 0.0) - f1)
            if best is None or (miss, e, tp) < best[0]:
                best = ((miss, e, tp), (tp, p - tp, fp, tn))
    return best and best[1]


def test_confusion_counts_in_closed_form(spark):
    rng, rows = random.Random(2), []
    for i in range(400):
        p, q = rng.randint(0, 900), rng.randint(0, 900)
        tp, tn = rng.randint(0, p), rng.randint(0, q)
        if p + q:
            acc, f1 = (tp + tn) / (p + q), 2 * tp / (p + tp + q - tn) if p + tp + q - tn else 0.0
            rows.append((f"r{i}", *((acc, f1) if i % 3 else (rng.random(), rng.choice([0.0, 1.0, 0.9999995, rng.random()]))), p, q))
    df = spark.createDataFrame(rows, "run_name string, test_acc double, test_f1 double, test_real_samples long, test_fake_samples long")
    got = {r.run_name: (r.tp, r.fn, r.fp, r.tn) for r in metrics.reconstruct_confusion(df).collect()}
    assert got == {r[0]: b for r in rows if (b := brute(*r[1:]))}
