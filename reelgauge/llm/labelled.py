"""The labelled rows a classifier may learn from, and the held-out rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves no remainder by FOLDS; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: int) -> DataFrame:
    """doc_id, y, text of at most per_class documents of each label, picked by hash, none held out.

    A document labelled twice counts by its larger label; null labels and ids are left out; of documents that
    share an id the smallest text is taken. At most 2 * per_class ids are broadcast.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("doc_id")).agg(F.max(label).cast("int").alias("y"))
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    picked = known.filter("y = 1").orderBy(*order).limit(per_class).unionByName(known.filter("y = 0").orderBy(*order).limit(per_class))
    texts = docs.select(docs["doc_id"].alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    joined = texts.join(F.broadcast(picked), "doc_id")
    return joined.groupBy("doc_id").agg(F.max("y").alias("y"), F.min("text").alias("text"))
