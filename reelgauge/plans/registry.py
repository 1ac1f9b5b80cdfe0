"""A query with its SQL: results are made comparable by rounding the doubles that are named."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bindings import Bound, with_bindings

DIGITS = 8


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Bound], DataFrame]
    sql: str | None = None
    doubles: str = ""

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(Bound(spark, sf_dir))
        return df.withColumns({c: F.round(c, DIGITS) for c in self.doubles.split()}) if self.doubles else df

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        sql = with_bindings(self.sql)
        if not self.doubles:
            return sql
        return f"SELECT * REPLACE ({', '.join(f'round({c}, {DIGITS}) AS {c}' for c in self.doubles.split())}) FROM ({sql}) AS answer"
