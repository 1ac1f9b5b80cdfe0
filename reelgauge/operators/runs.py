"""Experiment runs: assembly, leaderboards, gaps, ablations, governance of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.values import paradigm
from .ranks import bucketed_places

METRIC_KEYS = ("loss", "acc", "f1", "precision", "recall", "roc_auc", "average_precision")
LOSS_ORDER = ("none", "weighted_ce", "focal")
ABLATION_CATEGORIES = ("spatial", "temporal")
MANIFEST_ORDER = ("protocol", "category", "family", "experiment_no", "run_name")
#: The run manifest's columns, fixed in name and order.
MANIFEST = (
    "run_name string, experiment_no string, protocol string, category string, family string, model_name string, loss_mode string, dataset_scope string, "
    "best_epoch int, best_val_f1 double, best_val_acc double, test_f1 double, test_acc double, test_loss double, epochs_observed int, epochs_configured int, "
    "batch_size int, seq_len int, train_samples long, val_samples long, test_samples long, test_fake_samples long, test_real_samples long, relative_dir string"
)
MANIFEST_COLUMNS = tuple(c.split()[0] for c in MANIFEST.split(", "))


def assemble_runs(summaries: DataFrame, configs: DataFrame, histories: DataFrame, splits: DataFrame) -> DataFrame:
    """One row per run_dir that has a summary, a config and a history; the split summary is optional.

    summaries: run_dir, text fields, best_epoch, best_val_f1, best_val_acc, test_metrics (loss, acc, f1); configs:
    run_dir and fields; histories: run_dir, epoch; splits: run_dir, train, val, test structs.
    """
    s, c = summaries.alias("s"), configs.alias("c")
    epochs = histories.groupBy("run_dir").agg(F.coalesce(F.max("epoch"), F.lit(0)).alias("epochs_observed"))
    return run_rows(s.join(c, "run_dir").join(epochs, "run_dir").join(splits, "run_dir", "left"))


def run_rows(frame: DataFrame) -> DataFrame:
    """One row per row of run_dir, the summary's fields as s, the config's as c, epochs_observed, train, val and test."""
    folder = F.substring_index("run_dir", "/", -1)
    protocol = F.when(F.col("run_dir").contains("train/image/"), "image").otherwise("video")

    def pick(*sources: Column) -> Column:
        return V.first_truthy(*sources)

    fallback_category = F.when(protocol == "image", F.lit("image")).otherwise(F.lit("unknown"))
    parent = F.element_at(F.split("run_dir", "/"), -2)
    return frame.select(
        "run_dir", pick(F.col("s.run_name"), F.col("c.run_name"), folder).alias("run_name"), pick(F.col("s.experiment_no"), F.col("c.experiment_no"), folder).alias("experiment_no"),
        protocol.alias("protocol"), F.lower(pick(F.col("s.category"), F.col("c.category"), fallback_category)).alias("category"),
        F.btrim(F.replace(pick(F.col("c.family"), F.col("c.family_dir"), parent), F.lit("_"), F.lit(" "))).alias("family"),
        pick(F.col("s.model_name"), F.col("c.model_name"), F.lit("unknown")).alias("model_name"),
        pick(F.col("s.dataset_scope"), F.col("c.dataset_scope"), F.lit("unknown")).alias("dataset_scope"),
        pick(F.col("s.loss_mode"), F.col("c.loss_mode"), F.lit("none")).alias("loss_mode"),
        "epochs_observed", V.safe_int(F.col("c.epochs")).alias("epochs_configured"), V.safe_int(F.col("c.batch_size")).alias("batch_size"),
        V.safe_int(F.col("c.seq_len")).alias("seq_len"), V.safe_int(F.col("s.best_epoch")).alias("best_epoch"), V.safe_double(F.col("s.test_metrics.loss")).alias("test_loss"),
        F.col("train.samples").alias("train_samples"), F.col("val.samples").alias("val_samples"), F.regexp_replace("run_dir", "^.*?/(?=train/)", "").alias("relative_dir"),
        V.safe_double(F.col("s.best_val_f1")).alias("best_val_f1"), V.safe_double(F.col("s.best_val_acc")).alias("best_val_acc"),
        V.safe_double(F.col("s.test_metrics.acc")).alias("test_acc"), V.safe_double(F.col("s.test_metrics.f1")).alias("test_f1"),
        F.col("test.samples").alias("test_samples"), F.col("test.fake").alias("test_fake_samples"), F.col("test.real").alias("test_real_samples"),
    )


def with_paradigm(manifest: DataFrame) -> DataFrame:
    return manifest.withColumn("paradigm", paradigm(F.col("family"), F.col("model_name")))


def generalization_gap(manifest: DataFrame) -> DataFrame:
    return manifest.dropna(subset=["best_val_f1", "test_f1"]).withColumn("gap", F.col("best_val_f1") - F.col("test_f1"))


def top_gaps(manifest: DataFrame, k: int = 6) -> DataFrame:
    return generalization_gap(manifest).orderBy(F.desc("gap"), "run_name").limit(k).select("run_name", "gap")


def category_summary(manifest: DataFrame) -> DataFrame:
    scored = manifest.filter("test_f1 is not null")
    return scored.groupBy("category").agg(F.max("test_f1").alias("best_f1"), F.avg("test_f1").alias("mean_f1"), F.avg("test_acc").alias("mean_acc"), F.count(F.lit(1)).alias("runs"))


def paradigm_summary(manifest: DataFrame) -> DataFrame:
    scored = with_paradigm(manifest).filter("paradigm in ('CNN', 'Transformer') and test_f1 is not null")
    return scored.groupBy("protocol", "paradigm").agg(F.max("test_f1").alias("best_f1"), F.avg("test_f1").alias("mean_f1"), F.count(F.lit(1)).alias("runs"))


def paradigm_pivot(manifest: DataFrame) -> DataFrame:
    scored = with_paradigm(manifest).filter("paradigm in ('CNN', 'Transformer') and test_f1 is not null")
    wide = scored.groupBy("protocol").pivot("paradigm", ["CNN", "Transformer"]).agg(F.max("test_f1"))
    return wide.fillna(0.0).select("protocol", F.col("CNN").alias("cnn"), F.col("Transformer").alias("transformer"))


def _order(*more: str) -> list[Column]:
    return [F.col("test_f1").desc_nulls_last(), F.col("best_val_f1").desc_nulls_last(), *[F.col(m) for m in (*more, "run_name")]]


def best_run(manifest: DataFrame, group: str = "protocol") -> DataFrame:
    """Highest (test_f1, best_val_f1) per group; runs without test_f1 are out, a null best_val_f1 counts as -1."""
    scored = manifest.filter("test_f1 is not null").withColumn("v", F.coalesce("best_val_f1", F.lit(-1.0)))
    first = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("test_f1"), F.desc("v"), "run_name"))
    return scored.withColumn("rn", first).filter("rn = 1").select(group, "run_name", "test_f1", "best_val_f1")


def _score_bucket() -> Column:
    """A whole number that never rises along _order: test_f1 in steps of 1/1024, then best_val_f1 likewise, null lowest."""
    step = lambda c: F.floor(F.greatest(F.lit(-1.0), F.least(F.lit(2.0), F.col(c))) * 1024)
    return step("test_f1") * 4096 + F.when(F.col("best_val_f1").isNull(), 0).otherwise(step("best_val_f1") + 1025)


def leaderboard(manifest: DataFrame, group: str | None = None) -> DataFrame:
    """place 1..; ranks within a group, or over all runs. Only runs of one bucket of scores meet in a task."""
    groups = [group] if group else []
    scored = manifest.filter("test_f1 is not null").select(*groups, "run_name", "test_f1", "best_val_f1")
    return bucketed_places(scored, groups, _score_bucket(), _order()).withColumn("place", F.col("place").cast("int"))


def best_epoch(history: DataFrame) -> DataFrame:
    """Epoch of the largest val_f1, the first among equals."""
    return history.filter("val_f1 is not null").groupBy("run").agg(F.max_by("epoch", F.struct("val_f1", -F.col("epoch"))).alias("best_epoch"), F.max("val_f1").alias("best_val_f1"))


def early_stop_epoch(history: DataFrame, patience: int = 3, delta: float = 1e-4) -> DataFrame:
    """First epoch at which patience epochs have passed without val_f1 beating the best so far by delta; null if never."""
    w = Window.partitionBy("run").orderBy("epoch")
    before = F.max("val_f1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    gains = history.withColumn("gain", before.isNull() | (F.col("val_f1") > before + delta))
    since = gains.withColumn("last_gain", F.max(F.when(F.col("gain"), F.col("epoch"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return since.groupBy("run").agg(F.min(F.when(F.col("epoch") - F.col("last_gain") >= patience, F.col("epoch"))).alias("stop_epoch"))


def _ablation(manifest: DataFrame) -> DataFrame:
    return manifest.filter((F.col("protocol") == "video") & (F.col("model_name") == "convnext_base") & F.col("loss_mode").isin(*LOSS_ORDER) & F.col("category").isin(*ABLATION_CATEGORIES))


def loss_ablation(manifest: DataFrame) -> DataFrame:
    """category x loss_mode, in the fixed loss order; the last run by name stands for repeats."""
    last = lambda c: F.max_by(c, "run_name").alias(c)
    cells = _ablation(manifest).groupBy("category", "loss_mode").agg(last("best_val_f1"), last("test_f1"))
    place = F.array_position(F.array(*[F.lit(x) for x in LOSS_ORDER]), F.col("loss_mode"))
    return cells.withColumn("place", place.cast("int"))


def loss_ablation_pivot(manifest: DataFrame) -> DataFrame:
    wide = _ablation(manifest).groupBy("category").pivot("loss_mode", list(LOSS_ORDER)).agg(F.max_by("test_f1", "run_name"))
    return wide.select("category", *[F.col(x).alias(f"{x}_f1") for x in LOSS_ORDER])


def ablation_missing(manifest: DataFrame) -> DataFrame:
    spark = manifest.sparkSession
    cells = [(c, x) for c in ABLATION_CATEGORIES for x in LOSS_ORDER]
    expected = spark.createDataFrame(cells, "category string, loss_mode string")
    return expected.join(_ablation(manifest).filter("test_f1 is not null"), ["category", "loss_mode"], "left_anti")


def primary_metrics(evaluations: DataFrame, summaries: DataFrame) -> DataFrame:
    """Evaluation metrics win over summary metrics, key by key."""
    e, s = evaluations.alias("e"), summaries.alias("s")
    return s.join(e, "run", "left").select("run", *[F.coalesce(F.col(f"e.{k}"), F.col(f"s.{k}")).alias(k) for k in METRIC_KEYS])


def experiment_lookup(manifest: DataFrame) -> DataFrame:
    """matches per experiment: found names its one run, ambiguous has none of its own (see experiment_matches)."""
    return _lookup(manifest)


def experiment_matches(manifest: DataFrame) -> DataFrame:
    """experiment_lookup with the names of all runs that match, in order; such a row is as long as its experiment has runs (experiment_candidates has a row for each)."""
    return _lookup(manifest, _names("run_names"))


def _lookup(manifest: DataFrame, *more: Column) -> DataFrame:
    grouped = manifest.groupBy("experiment_no").agg(F.count(F.lit(1)).alias("matches"), F.min("run_name").alias("only"), *more)
    one = F.col("matches") == 1
    status = [F.when(one, "found").otherwise("ambiguous").alias("status"), F.when(one, F.col("only")).alias("run_name")]
    return grouped.select("experiment_no", "matches", *status, *grouped.columns[3:])


def _names(alias: str) -> Column:
    return F.expr("listagg(run_name, ',') WITHIN GROUP (ORDER BY run_name)").alias(alias)


def experiment_candidates(manifest: DataFrame) -> DataFrame:
    """A row for each run of an ambiguous experiment, with the number of such runs; no group is gathered in one place."""
    many = manifest.groupBy(F.col("experiment_no").alias("__no")).agg(F.count(F.lit(1)).alias("matches")).filter("matches > 1")
    return manifest.join(many, F.col("experiment_no").eqNullSafe(F.col("__no"))).select("experiment_no", "run_name", "matches")


def status_tally(jobs: DataFrame, groups: list[str]) -> DataFrame:
    failed = F.col("status").startswith("failed")
    return jobs.groupBy(*groups).agg(F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.count_if(failed).alias("failed"), F.count(F.lit(1)).alias("total"))


def duplicate_results(manifest: DataFrame) -> DataFrame:
    """Metric values that more than one run reports, with the first of these runs and the names of all, in order (duplicate_members has a row for each)."""
    scored = manifest.filter("test_f1 is not null").groupBy("test_f1", "best_val_f1")
    return scored.agg(F.count(F.lit(1)).alias("runs"), F.min("run_name").alias("first_run"), _names("run_names")).filter("runs > 1")


def duplicate_members(manifest: DataFrame) -> DataFrame:
    """One row per run whose metric values another run reports too, with the number of such runs; no group is gathered in one place."""
    scored = manifest.filter("test_f1 is not null").select("run_name", "test_f1", "best_val_f1")
    shared = scored.groupBy(F.col("test_f1").alias("__t"), F.col("best_val_f1").alias("__v")).agg(F.count(F.lit(1)).alias("runs")).filter("runs > 1")
    return scored.join(shared, F.col("test_f1").eqNullSafe(F.col("__t")) & F.col("best_val_f1").eqNullSafe(F.col("__v"))).select("run_name", "test_f1", "best_val_f1", "runs")


def run_completeness(files: DataFrame, expected: tuple[str, ...]) -> DataFrame:
    """files: run_dir, name. Missing artefacts of each run."""
    has = [F.max((F.col("name") == e).cast("int")).alias(f"has_{e.split('.')[0]}") for e in expected]
    grouped = files.groupBy("run_dir").agg(*has)
    flags = [F.col(f"has_{e.split('.')[0]}") for e in expected]
    total = flags[0]
    for f in flags[1:]:
        total = total + f
    return grouped.withColumn("complete", total == len(expected))


def run_drift(summaries: DataFrame, configs: DataFrame, fields: list[str]) -> DataFrame:
    """Fields in which a run's summary and config disagree."""
    s, c = summaries.alias("s"), configs.alias("c")
    rows = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"s.{f}").cast("string").alias("summary"), F.col(f"c.{f}").cast("string").alias("config")) for f in fields])
    return s.join(c, "run").select("run", F.explode(rows).alias("__row")).select("run", "__row.*").filter(~F.col("summary").eqNullSafe(F.col("config")))


def artifact_registry(manifest: DataFrame) -> DataFrame:
    """One archive record per run and the number of bundles in its domain."""
    names = V.artifact_names(F.col("run_name"), F.coalesce("test_acc", "best_val_acc"), F.coalesce("test_f1", "best_val_f1"))
    domain = F.when(F.col("protocol") == "image", "Image").otherwise("Video")
    folder = V.sanitize(F.concat_ws("_", "family", "model_name"))
    record = manifest.select(
        F.concat_ws("/", domain, folder, names["archive_name"]).alias("archive"), "experiment_no", F.col("run_name").alias("bundle_id"), F.col("protocol").alias("domain"), folder.alias("family_model_dir")
    )
    counts = record.groupBy("domain").agg(F.count(F.lit(1)).alias("bundle_count"))
    return record.join(counts, "domain")


def compact_metrics(manifest: DataFrame) -> DataFrame:
    """Nested JSON payload per run."""
    names = V.artifact_names(F.col("run_name"), F.coalesce("test_acc", "best_val_acc"), F.coalesce("test_f1", "best_val_f1"))
    body = F.struct(
        "experiment_no", V.sanitize(F.col("run_name")).alias("run_name"), F.col("protocol").alias("domain"), "family", "model_name",
        F.struct(F.col("test_acc").alias("acc"), F.col("test_f1").alias("f1")).alias("metrics"),
        F.struct(names["checkpoint_name"].alias("checkpoint"), names["config_name"].alias("config"), names["summary_name"].alias("final_summary")).alias("paths"),
    )
    return manifest.select("run_name", F.to_json(body).alias("payload"))


def metrics_payload(bundles: DataFrame, metrics: DataFrame) -> DataFrame:
    """run_name, payload: the JSON record of each bundle, with all metrics that are known and nulls kept elsewhere.

    bundles: run_name, experiment_no, protocol, family, model_name, source_kind, acc and f1 (of the checkpoint's name), has_evaluation,
    dataset_scope, dataset_tag, category, mode, seq_len; metrics: run and METRIC_KEYS, as primary_metrics gives them. A bundle without
    metrics has an empty metrics object.
    """
    tag, names = V.sanitize(F.col("run_name")), V.artifact_names(F.col("run_name"), F.col("acc"), F.col("f1"))
    known = F.map_filter(F.create_map(*[x for k in METRIC_KEYS for x in (F.lit(k), F.col(k))]), lambda _, v: v.isNotNull())
    given = metrics.select(F.col("run").alias("__run"), known.alias("__metrics"))
    evaluation = F.when(F.col("has_evaluation"), F.concat(F.lit("test_evaluation_"), tag, F.lit(".json")))
    body = F.struct(
        "experiment_no", tag.alias("run_name"), F.lower("protocol").alias("domain"), "family", "model_name", "source_kind", F.coalesce("__metrics", F.create_map().cast("map<string, double>")).alias("metrics"),
        F.struct(names["checkpoint_name"].alias("checkpoint"), names["config_name"].alias("config"), names["summary_name"].alias("final_summary"), evaluation.alias("test_evaluation")).alias("paths"),
        F.struct("dataset_scope", "dataset_tag", "category", "mode", "seq_len").alias("config_summary"),
    )
    joined = bundles.join(given, F.col("run_name") == F.col("__run"), "left")
    return joined.select("run_name", F.to_json(body, {"ignoreNullFields": "false"}).alias("payload"))
