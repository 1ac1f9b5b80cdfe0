"""Run artefacts, predictions, logs and manifests: readers and writers."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.paths import parent
from ..operators.runs import run_rows
from . import headed_csv
from .scratch import scratch_dir

TEXT_FIELDS = "run_name string, experiment_no string, category string, model_name string, dataset_scope string, loss_mode string"
SUMMARY = TEXT_FIELDS + ", best_epoch int, best_val_f1 double, best_val_acc double, test_metrics struct<loss: double, acc: double, f1: double>"
CONFIG = TEXT_FIELDS + ", family string, family_dir string, epochs string, batch_size string, seq_len string, dataset_names array<string>"
SPLIT_SUMMARY = ", ".join(f"{s} struct<samples: long, fake: long, real: long>" for s in ("train", "val", "test"))
HISTORY = ("epoch", "train_loss", "train_acc", "train_f1", "val_loss", "val_acc", "val_f1", "lr", "seconds")
PREDICTION = ("label", "pred_label", "prob_real")
EXTRACTION = "source_path string, source_frame_count long, source_fps double, frame_stride int, max_frames int, requested_indices int, saved_frame_count int, backend string"
BAD_MEDIA = "ts double, path string, stage string, detail string, backend string, mode string, seq_len int"
#: The files of a run's folder; all but the last must be there.
RUN_FILES = {"summary": "final_summary.json", "config": "config.json", "history": "history.csv", "split": "split_summary.json"}
FOLDERS_A_TASK = 200


def read_documents(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """Whole JSON files called ``name`` below root: run_dir and their fields; unreadable ones give nulls."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(root, wholetext=True)
    return files.select(parent(F.col("_metadata.file_path")).alias("run_dir"), F.from_json("value", schema).alias("x")).select("run_dir", "x.*")


def read_configs(spark: SparkSession, root: str) -> DataFrame:
    """config.json files; a dataset_names that is one string becomes an array of one."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "config.json").text(root, wholetext=True)
    read = files.select(parent(F.col("_metadata.file_path")).alias("run_dir"), F.from_json("value", CONFIG).alias("x"), F.get_json_object("value", "$.dataset_names").alias("names"))
    return read.select("run_dir", "x.*", dataset_array(F.col("names")).alias("names")).drop("dataset_names").withColumnRenamed("names", "dataset_names")


def dataset_array(names):
    """A JSON array of strings, or a bare string, as an array."""
    return F.when(names.startswith("["), F.from_json(names, "array<string>")).when(names.isNotNull(), F.array(names))


def with_history_columns(frame: DataFrame) -> DataFrame:
    """All history columns in order; the missing ones null."""
    return frame.select(
        *[c for c in frame.columns if c not in HISTORY], *[F.col(c).cast("int" if c == "epoch" else "double") if c in frame.columns else F.lit(None).cast("double").alias(c) for c in HISTORY]
    )


def read_history(spark: SparkSession, root: str) -> DataFrame:
    """history.csv files (small, one per run) below root: run_dir and all history columns, each file read by its own header row.

    Columns are found by name whatever their order; one that a file lacks, a short row's missing cells and what is no number
    are null. A file without rows gives none.
    """
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "history.csv").text(root, wholetext=True)
    lines = files.select(parent(F.col("_metadata.file_path")).alias("run_dir"), history_lines(F.col("value")).alias("lines"))
    rows = lines.select("run_dir", cells(F.get("lines", F.lit(0))).alias("header"), F.explode(_below_header(F.col("lines"))).alias("line"))
    rows = rows.select("run_dir", "header", cells(F.col("line")).alias("cells"))
    return rows.select("run_dir", *[_cell(F.col("header"), F.col("cells"), c).try_cast("int" if c == "epoch" else "double").alias(c) for c in HISTORY])


def history_lines(text: Column) -> Column:
    """The lines of a history that are not blank, its header first."""
    return F.filter(F.split(text, r"\r?\n|\r"), lambda x: F.trim(x) != "")


def cells(line: Column) -> Column:
    return F.transform(F.split(line, ","), lambda c: F.btrim(c, F.lit(' "\ufeff')))


def _below_header(lines: Column) -> Column:
    return F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1)))


def _cell(header: Column, row: Column, name: str) -> Column:
    return F.get(row, (F.array_position(header, F.lit(name)) - 1).cast("int"))


def last_epoch(text: Column) -> Column:
    """The largest epoch of a history, found by its header; 0 if it has none."""
    lines = history_lines(text)
    epochs = F.transform(_below_header(lines), lambda line: _cell(cells(F.get(lines, F.lit(0))), cells(line), "epoch").try_cast("int"))
    return F.coalesce(F.array_max(epochs), F.lit(0))


def folder_tasks(spark: SparkSession, folders: int) -> int:
    """How many tasks share so many folders."""
    return max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-folders // FOLDERS_A_TASK)))


def run_folders(spark: SparkSession, root: str) -> DataFrame:
    """One row per folder below root with a summary, a config and a history: run_dir and the texts of its files; split is null where there is none.

    Folders are visited level by level, by tasks, each once; the driver learns how many there are. Names that begin with _ or . are
    passed over, as Spark's readers do. Files are those that pyarrow opens. What was read stays in the scratch folder.
    """
    _, top = _file_system(root)
    level, n, found = spark.createDataFrame([(top,)], "path string"), 1, []
    while n:
        place = scratch_dir(spark, "run-folders-level")
        level.repartition(folder_tasks(spark, n), "path").mapInPandas(_visits(root), _VISITED).write.parquet(place)
        seen = spark.read.schema(_VISITED).parquet(place)
        found.append(seen.filter("run").drop("run").withColumnRenamed("path", "run_dir"))
        level = seen.filter("not run").select("path")
        n = level.count()
    return reduce(DataFrame.unionByName, found)


RUN_TEXTS = "run_dir string, " + ", ".join(f"{c} string" for c in RUN_FILES)
_VISITED = RUN_TEXTS.replace("run_dir string", "path string, run boolean")


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def visit_folder(files, folder: str) -> tuple[list[str], list[str | None] | None]:
    """The folders in a folder and, where it is a run's, the texts of its files. files: a pyarrow file system."""
    from pyarrow import fs

    def text(path):
        with files.open_input_file(path) as file:
            return file.read().decode("utf-8", "replace")

    there, folders = set(), []
    for info in files.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
        if info.type == fs.FileType.File:
            there.add(info.base_name)
        elif info.type == fs.FileType.Directory and not info.base_name.startswith(("_", ".")):
            folders.append(info.path)
    *needed, split = RUN_FILES.values()
    return folders, [text(f"{folder}/{name}") if name in there else None for name in (*needed, split)] if there.issuperset(needed) else None


def runs_below(files, top: str) -> Iterator[tuple]:
    """run_dir and texts of the runs below a folder of few runs, in one walk."""
    left = [top]
    while left:
        folder = left.pop()
        folders, texts = visit_folder(files, folder)
        left += folders
        if texts:
            yield (folder, *texts)


def _visits(root: str):
    """For each folder a row for every folder in it and, where it is a run's, one with its files' texts."""

    def visit(batches):
        import pandas as pd

        files, _ = _file_system(root)
        columns = ["path", "run", *RUN_FILES]
        for batch in batches:
            rows = []
            for folder in batch["path"]:
                folders, texts = visit_folder(files, folder)
                rows += [(f, False, *[None] * len(RUN_FILES)) for f in folders]
                if texts:
                    rows.append((folder, True, *texts))
            yield pd.DataFrame(rows, columns=columns)

    return visit


def load_runs(spark: SparkSession, root: str) -> DataFrame:
    """The runs below root, from their folders' files: summary, config and history must be there, the split summary may be.

    A history without rows counts 0 epochs; JSON that can't be read gives nulls. Each folder is read in one place, so nothing is joined.
    """
    return runs_of(run_folders(spark, root))


def runs_of(texts: DataFrame) -> DataFrame:
    """The runs whose files have these texts (RUN_TEXTS)."""
    parsed = texts.select("run_dir", F.from_json("summary", SUMMARY).alias("s"), F.from_json("config", CONFIG).alias("c"), last_epoch(F.col("history")).alias("epochs_observed"), F.from_json("split", SPLIT_SUMMARY).alias("x"))
    return run_rows(parsed.select("run_dir", "s", "c", "epochs_observed", "x.*"))


def usable_predictions(frame: DataFrame) -> DataFrame | None:
    """The frame if it has the required columns, else nothing."""
    return frame if set(PREDICTION) <= set(frame.columns) else None


def read_predictions(spark: SparkSession, path: str, name: str = "*.csv", others: tuple[str, ...] = ("path",)) -> DataFrame:
    """Prediction files below path, each by its own header: file, the required columns as numbers and the others as text.

    A file that lacks a required column gives no rows; what is no number is null, and so are other columns that a file lacks.
    """
    headed_csv.register(spark)
    options = {"path": path, "name": name, "columns": ",".join([*PREDICTION, *others]), "required": ",".join(PREDICTION)}
    rows = spark.read.format("headed_csv").options(**options).load()
    kinds = dict(zip(PREDICTION, ("int", "int", "double")))
    return rows.select("file", *others, *[F.trim(c).try_cast(kinds[c]).alias(c) for c in PREDICTION])


def write_predictions(frame: DataFrame, path: str) -> None:
    if frame.isEmpty():
        raise ValueError("no predictions to write")
    frame.write.option("header", "true").csv(path)


def write_evaluation(report: DataFrame, path: str) -> None:
    report.write.json(path)


def read_evaluation(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_manifest(manifest: DataFrame, path: str) -> None:
    """Run manifest as CSV in its fixed order."""
    manifest.orderBy("protocol", "category", "family", "experiment_no", "run_name").write.option("header", "true").csv(path)


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").csv(path)


def first_bad_media(log: DataFrame) -> DataFrame:
    """The first event of each path."""
    first = F.row_number().over(Window.partitionBy("path").orderBy("ts", "event_id"))
    return log.withColumn("rn", first).filter("rn = 1").drop("rn")


def parse_extraction_manifest(raw: DataFrame, text: str = "value") -> DataFrame:
    """source_path and fields of JSON manifests; corrupt ones (no source_path) count as missing."""
    return raw.select(F.from_json(F.col(text), EXTRACTION).alias("m")).select("m.*").filter("source_path is not null")


def append_bad_media(log: DataFrame, path: str) -> None:
    """Adds events to a JSON-lines log: the first of each path, and none of a path that the log holds already. One writer at a time; streaming.bad_media.SessionLog is for many."""
    spark = log.sparkSession
    first = first_bad_media(log).filter("path is not null and path <> ''").select("ts", "path", "stage", "detail", "backend", "mode", "seq_len")
    spark.createDataFrame([], first.schema).write.mode("append").json(path)  # so that there is a log to read
    first.join(read_bad_media(spark, path).select("path"), "path", "left_anti").write.mode("append").json(path)


def read_bad_media(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BAD_MEDIA).json(path)


def write_extraction_manifests(manifests: DataFrame, path: str) -> None:
    """One JSON document a line, in the form that parse_extraction_manifest reads."""
    manifests.write.json(path)


def read_extraction_manifests(spark: SparkSession, path: str) -> DataFrame:
    return parse_extraction_manifest(spark.read.text(path))
