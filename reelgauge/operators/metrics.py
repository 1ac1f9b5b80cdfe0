"""Binary classifier metrics from predictions: label (1 = real, the positive class), pred_label, prob_real."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import ratio
from .ranks import descending_sums

COUNTS = ("tp", "fn", "fp", "tn")


def confusion_counts() -> list[Column]:
    real, said = F.col("label") == 1, F.col("pred_label") == 1
    return [
        F.count_if(real & said).alias("tp"), F.count_if(real & ~said).alias("fn"),
        F.count_if(~real & said).alias("fp"), F.count_if(~real & ~said).alias("tn"),
    ]


def confusion_matrix(predictions: DataFrame, groups: list[str]) -> DataFrame:
    return predictions.groupBy(*groups).agg(*confusion_counts())


def ratios() -> list[Column]:
    tp, fn, fp, tn = (F.col(c) for c in COUNTS)
    return [
        ratio(tp + tn, tp + fn + fp + tn).alias("acc"), ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    ]


def binary_metrics(predictions: DataFrame, groups: list[str]) -> DataFrame:
    """Accuracy, precision, recall, F1 (0 where undefined) and supports; one aggregation."""
    supports = [(F.col("tp") + F.col("fn")).alias("support_real"), (F.col("fp") + F.col("tn")).alias("support_fake")]
    return confusion_matrix(predictions, groups).select(*groups, *ratios(), *supports)


def normalised_confusion(predictions: DataFrame, groups: list[str]) -> DataFrame:
    tp, fn, fp, tn = (F.col(c) for c in COUNTS)
    return confusion_matrix(predictions, groups).select(
        *groups, ratio(tp, tp + fn).alias("real_real"), ratio(fn, tp + fn).alias("real_fake"), ratio(fp, fp + tn).alias("fake_real"), ratio(tn, fp + tn).alias("fake_fake")
    )


def finite(score: Column) -> Column:
    return score.isNotNull() & ~F.isnan(score) & (F.abs(score) != float("inf"))


def score_validity(predictions: DataFrame, groups: list[str]) -> DataFrame:
    ok = finite(F.col("prob_real"))
    return predictions.groupBy(*groups).agg(F.count_if(ok).alias("finite_scores"), F.count_if(~ok).alias("invalid_scores"))


def thresholds(predictions: DataFrame, groups: list[str]) -> DataFrame:
    """Per distinct finite score: pos, neg, and the running cum_pos, cum_neg from the top. Ties never straddle."""
    tied = (
        predictions.filter(finite(F.col("prob_real")))
        .groupBy(*groups, F.col("prob_real").alias("score"))
        .agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg"))
    )
    return descending_sums(tied, groups, "score", ["pos", "neg"])


def ranking_metrics(predictions: DataFrame, groups: list[str]) -> DataFrame:
    """roc_auc and average_precision per group; null unless both classes have finite scores."""
    t = thresholds(predictions, groups)
    pairs = F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2.0))
    steps = F.sum(F.col("pos") * (F.col("cum_pos").cast("double") / (F.col("cum_pos") + F.col("cum_neg"))))
    p, n = F.sum("pos"), F.sum("neg")
    both = (p > 0) & (n > 0)
    return t.groupBy(*groups).agg(
        F.when(both, pairs / (p.cast("double") * n)).alias("roc_auc"), F.when(both, steps / p).alias("average_precision")
    )


def roc_points(predictions: DataFrame, groups: list[str]) -> DataFrame:
    """Every distinct threshold and the origin, for groups with both classes: score (null at the origin), fpr, tpr."""
    t = thresholds(predictions, groups)
    totals = t.groupBy(*groups).agg(F.sum("pos").alias("p"), F.sum("neg").alias("q")).filter("p > 0 and q > 0")
    points = t.join(totals, groups).select(*groups, "score", (F.col("cum_neg") / F.col("q").cast("double")).alias("fpr"), (F.col("cum_pos") / F.col("p").cast("double")).alias("tpr"))
    return points.unionByName(totals.select(*groups, F.lit(None).cast("double").alias("score"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")))


def youden_points(predictions: DataFrame, groups: list[str]) -> DataFrame:
    """The point of largest tpr - fpr; the highest score among equals."""
    gap = F.col("tpr") - F.col("fpr")
    best = F.max_by(F.struct("score", "fpr", "tpr"), F.struct(gap, F.coalesce("score", F.lit(float("inf")))))
    return roc_points(predictions, groups).groupBy(*groups).agg(best.alias("b")).select(*groups, "b.score", "b.fpr", "b.tpr")


def roc_fallback(counts: DataFrame, groups: list[str]) -> DataFrame:
    """Three points from a single confusion matrix; denominators of 1 at least."""
    fpr = F.col("fp").cast("double") / F.greatest(F.lit(1), F.col("fp") + F.col("tn"))
    tpr = F.col("tp").cast("double") / F.greatest(F.lit(1), F.col("tp") + F.col("fn"))
    points = F.array(
        F.struct(F.lit(0).alias("point"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")),
        F.struct(F.lit(1).alias("point"), fpr.alias("fpr"), tpr.alias("tpr")),
        F.struct(F.lit(2).alias("point"), F.lit(1.0).alias("fpr"), F.lit(1.0).alias("tpr")),
    )
    return counts.select(*groups, F.explode(points).alias("__point")).select(*groups, "__point.*")


def evaluation_report(predictions: DataFrame, groups: list[str]) -> DataFrame:
    """Metrics, confusion counts, score validity and ranking metrics, one row per group."""
    ok = finite(F.col("prob_real"))
    base = predictions.groupBy(*groups).agg(*confusion_counts(), F.count_if(ok).alias("finite_scores"), F.count_if(~ok).alias("invalid_scores"))
    return base.select(*groups, *ratios(), *COUNTS, "finite_scores", "invalid_scores").join(ranking_metrics(predictions, groups), groups, "left")


def reconstruct_confusion(runs: DataFrame, reach: int = 400) -> DataFrame:
    """Confusion counts that best explain (test_acc, test_f1) with the class sizes: run_name, tp, fn, fp, tn.

    At most three error counts are tried for a run. With the errors fixed accuracy is, and F1 = 2 tp / (2 tp + errors) rises with tp,
    so the best tp is a neighbour of the one where it meets test_f1, or the end of the allowed range on that side. The
    closest in |acc| + |f1| wins, the one with fewer errors, then fewer hits, among equals. Rounding is half to even.
    """
    acc, f1, p, q, errors = F.col("test_acc"), F.col("test_f1"), F.col("p"), F.col("q"), F.col("errors")
    known = runs.select("run_name", acc, f1, F.col("test_real_samples").cast("long").alias("p"), F.col("test_fake_samples").cast("long").alias("q"))
    known = known.filter("test_acc is not null and test_f1 is not null and p is not null and q is not null and p + q > 0")
    wrong = (1.0 - acc) * (p + q)
    each = F.array_distinct(F.transform(F.array(F.bround(wrong), F.floor(wrong), F.ceil(wrong)), lambda e: F.greatest(F.lit(0), e.cast("long"))))
    tried = known.select("*", F.explode(each).alias("errors"))
    meets = F.least(p.cast("double"), f1 * errors / F.greatest(F.lit(1e-9), 2.0 * (1.0 - f1)))
    guess = F.when(f1 >= 0.999999, p.cast("double")).otherwise(f1 * errors / F.greatest(F.lit(1e-9), 2.0 * (1.0 - f1)))
    tried = tried.withColumn("centre", F.bround(guess).cast("long")).withColumn("meets", meets)
    low = F.greatest(F.lit(0), F.col("centre") - reach, p - errors)
    high = F.least(p, F.col("centre") + reach, p + q - errors)
    tried = tried.withColumn("low", low).withColumn("high", high).filter("low <= high")
    near = F.array(F.floor("meets"), F.ceil("meets"), F.col("centre") - 1, F.col("centre"), F.col("centre") + 1)
    allowed = F.transform(near, lambda t: F.greatest(F.col("low"), F.least(F.col("high"), t)))
    got_acc = ratio(p + q - errors, p + q)
    miss = lambda t: F.abs(got_acc - acc) + F.abs(ratio(2 * t, 2 * t + errors) - f1)
    best = F.array_min(F.transform(allowed, lambda t: F.struct(miss(t).alias("miss"), errors.alias("errors"), t.alias("tp"), p.alias("p"), q.alias("q"))))
    won = tried.select("run_name", best.alias("b")).groupBy("run_name").agg(F.min("b").alias("b")).select("run_name", "b.*")
    fn = p - F.col("tp")
    return won.select("run_name", "tp", fn.alias("fn"), (errors - fn).alias("fp"), (q - errors + fn).alias("tn"))
