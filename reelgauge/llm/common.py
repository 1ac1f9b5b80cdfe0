"""Helpers the text operators share: the word rule, the scratch folder, table writes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import scratch_dir

#: A word is a run of anything but ASCII space and the controls 0x09 to 0x0D.
WORD_RE = re.compile(r"[^\x20\x09-\x0D]+")
BLANKS = " \t\n\x0b\x0c\r"
GAP_PATTERN = r"[\x20\x09-\x0D]+"
FOLD_ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_words(text: Column) -> Column:
    """Array of words; empty for a null or blank text."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP_PATTERN))


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df once into the shared folder and read it back; cuts the lineage."""
    path = scratch_dir(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of df has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


BROADCAST_BYTES = 32_000_000


def if_small(written: DataFrame, row_bytes: int) -> DataFrame:
    """A written table of fixed-width columns, to be broadcast if by its count it holds at most BROADCAST_BYTES; else it is shuffled."""
    return F.broadcast(written) if written.count() * row_bytes <= BROADCAST_BYTES else written


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def unit_hash(*cols: Column) -> Column:
    """Uniform double in [0, 1) that depends on nothing but the values given."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))
