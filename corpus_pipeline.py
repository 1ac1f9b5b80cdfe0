"""The corpus pipeline: documents through five operators, each stage written and read again.

quality classifier -> near duplicates -> repeated passages -> source mix -> SentencePiece digests.
Near duplicates are documents whose five-word shingles reach a Jaccard similarity of 0.8; the
smallest doc_id of a group stays. Rows that share an id stand for themselves, by id and text; of rows equal in both one
stays. Rows with a null id link with nothing and stay, and null texts are scored, mixed and encoded as empty ones. A passage
that repeats in what is left is cut from all rows that hold it; a row of which nothing is left goes. The
mix repeats rows. Columns of any other name go through unchanged, whatever their names. Texts are taken whole, however long. Empty
input gives empty output with the same columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgauge.llm import jaccard_join, quality_classifier, sentence_pieces, source_mix, suffix_dedup
from reelgauge.llm.common import materialize, table

PIECES = "piece_bpe_32k.model"


#: Rows here are whole documents: Arrow batches of 1000 are a few MB in the JVM and in Python, where the default of 10,000 takes tens of each.
BATCH_ROWS = 1000


def small_batches(stage):
    """The stage with BATCH_ROWS in its session."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return run_stage


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_classifier.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.keep_good(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one_per_group(docs, k=5, num=80, den=100)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.cut_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mix.take_mix(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return sentence_pieces.piece_digests(docs, public_tokenizers.path(PIECES))


STAGES = [
    ("quality classifier", small_batches(keep_quality)),
    ("n-gram Jaccard join", small_batches(drop_near_duplicates)),
    ("suffix-array dedup", small_batches(cut_repeated_passages)),
    ("mixing sources to target weights", small_batches(mix_sources)),
    ("SentencePiece encoding and decoding", small_batches(encode_pieces)),
]

#: A trained model, components and random rounding are beyond SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.split()[0].lower())  # each stage's own tables stay until drop_scratch
    return STAGES[-1][1](spark, docs, sf_dir)
