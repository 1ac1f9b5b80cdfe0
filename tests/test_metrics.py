import itertools
import random

import pytest

from reelgauge.operators import metrics

# Published accuracy and F1 of fifteen runs with their class sizes, and the only counts that explain them.
IMAGE, VIDEO = (15997, 16000), (463, 1985)
GOLDEN = [
    (0.9862799637466012, 0.9862722411582601, IMAGE, (15770, 227, 212, 15788)),
    (0.9839672469293996, 0.983980264185117, IMAGE, (15755, 242, 271, 15729)),
    (0.9841860174391349, 0.9841548193148368, IMAGE, (15714, 283, 223, 15777)),
    (0.970278463605963, 0.9701778042585217, IMAGE, (15469, 528, 423, 15577)),
    (0.954808263274682, 0.9546025367323873, IMAGE, (15203, 794, 652, 15348)),
    (0.8026960784313726, 0.47442872687704024, VIDEO, (218, 245, 238, 1747)),
    (0.8566176470588235, 0.7022900763358778, VIDEO, (414, 49, 302, 1683)),
    (0.8717320261437909, 0.6708595387840671, VIDEO, (320, 143, 171, 1814)),
    (0.7504084967320261, 0.5252525252525253, VIDEO, (338, 125, 486, 1499)),
    (0.7663398692810458, 0.5744047619047619, VIDEO, (386, 77, 495, 1490)),
    (0.9089052287581699, 0.7841239109390126, VIDEO, (405, 58, 165, 1820)),
    (0.8186274509803921, 0.6413570274636511, VIDEO, (397, 66, 378, 1607)),
    (0.8651960784313726, 0.708994708994709, VIDEO, (402, 61, 269, 1716)),
    (0.8831699346405228, 0.7099391480730223, VIDEO, (350, 113, 173, 1812)),
]


def test_counts_are_reconstructed(spark):
    rows = [(str(i), acc, f1, p, q) for i, (acc, f1, (p, q), _) in enumerate(GOLDEN)]
    runs = spark.createDataFrame(rows, "run_name string, test_acc double, test_f1 double, test_real_samples long, test_fake_samples long")
    found = {r.run_name: (r.tp, r.fn, r.fp, r.tn) for r in metrics.reconstruct_confusion(runs).collect()}
    assert found == {str(i): g[3] for i, g in enumerate(GOLDEN)}


def predictions(spark, rows):
    return spark.createDataFrame(rows, "run string, label int, pred_label int, prob_real double")


def test_auc_is_the_pair_statistic(spark):
    rng = random.Random(4)
    rows = [("a", rng.randint(0, 1), 0, rng.randint(0, 9) / 9) for _ in range(300)]
    pos, neg = ([r[3] for r in rows if r[1] == y] for y in (1, 0))
    pairs = sum((a > b) + 0.5 * (a == b) for a, b in itertools.product(pos, neg)) / (len(pos) * len(neg))
    got = metrics.ranking_metrics(predictions(spark, rows), ["run"]).first()
    assert got.roc_auc == pytest.approx(pairs, abs=1e-12)


def test_scores_that_are_not_finite_and_single_classes(spark):
    rows = [("a", 1, 1, float("nan")), ("a", 0, 0, float("inf")), ("a", 0, 1, 0.5), ("b", 1, 1, 0.2), ("b", 1, 0, 0.9), ("c", 1, 1, 0.9), ("c", 0, 0, 0.1), ("c", 0, 0, None)]
    got = {r.run: r for r in metrics.evaluation_report(predictions(spark, rows), ["run"]).collect()}
    assert (got["a"].finite_scores, got["a"].invalid_scores, got["a"].roc_auc) == (1, 2, None)
    assert got["b"].roc_auc is None and got["b"].precision == 1.0 and got["b"].recall == 0.5
    assert got["c"].roc_auc == 1.0 and got["c"].average_precision == 1.0
    assert metrics.evaluation_report(predictions(spark, []), ["run"]).count() == 0
