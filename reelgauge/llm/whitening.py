"""Embedding whitening with multiplicities: equal vectors are fitted by their count and whitened once.

1. Entries become whole numbers, x = floor(SCALE * c) + OFFSET; equal x vectors are one group with its count.
2. The fit list is every group as often as it occurs (``weights="counts"``) or once (``"one"``). Sums S are exact;
   each task adds up its groups' weighted centred product in one GEMM, and the tasks' matrices are added row by row.
   Only the matrix, of the vectors' width squared, reaches the driver, which takes its eigenvectors.
3. Each group is whitened once, and the rows are joined back by x. Groups that hold more than one in HOT of all rows are
   fewer than HOT: they are broadcast, and their rows are not shuffled.

Rows with a null vector, or null or non-finite entries, are dropped, and so are rows of another width than the
commonest (of equally common ones the widest). Entries beyond 2^43 count as that. Rows may repeat, ids may be null or repeat: each gives its
own rows. Components whose eigenvalue is 0 within rounding have no whitened values and are left out, so a table of equal
vectors gives no rows, and an empty one none. deviation is null where it needs more than 64 bits. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shuffle_partitions

SCALE = 1024
OFFSET = 100_000
COMPONENTS = 8
FAR = float(1 << 43)
HOT = 1000
SAFE = 1 << 62
BATCH_FLOATS = 4_000_000


def whole_vectors(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id, x: array<long> of the usable rows."""
    c = lambda v: v.cast("double")
    given = vectors.select(vectors[vec_id].alias("vec_id"), vectors[vector].alias("v")).filter("v is not null")
    finite = F.forall("v", lambda v: F.coalesce(~F.isnan(c(v)) & (F.abs(c(v)) < float("inf")), F.lit(False)))
    near = lambda v: F.greatest(F.lit(-FAR), F.least(F.lit(FAR), c(v)))
    return given.filter(finite).select("vec_id", F.transform("v", lambda v: (F.floor(near(v) * SCALE) + OFFSET).cast("long")).alias("x"))


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Batches cut to BATCH_FLOATS, with their vectors as one matrix."""
    for batch in batches:
        if not len(batch):
            continue
        rows = max(1, BATCH_FLOATS // max(1, len(batch["x"].iloc[0])))
        for at in range(0, len(batch), rows):
            own = batch.iloc[at : at + rows]
            yield own, np.stack([np.asarray(v, "int64") for v in own["x"]])


def _fits(x: np.ndarray, n: int) -> bool:
    return n * max(1, int(np.abs(x).max(initial=0))) < SAFE


def offsets(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly: in 64 bits where they are enough, else as Python's numbers."""
    if _fits(x, n) and all(abs(s) < SAFE for s in sums):
        return x * np.int64(n) - np.array(sums, "int64")
    return x.astype(object) * n - np.array(sums, dtype=object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return (offsets(x, n, sums) / n).astype("float64")


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    off = offsets(x, n, sums)
    if off.dtype != object:
        if int(np.abs(off).max(initial=0)) ** 2 * max(1, x.shape[1]) < 1 << 63:
            return (off * off).sum(1).tolist()
        off = off.astype(object)
    exact = (off * off).sum(1)
    return [int(v) if v < 1 << 63 else None for v in exact]


def _sums(groups: DataFrame, width: int) -> list[int]:
    """Per dimension, the weighted sum of x."""

    def add(batches):
        total = np.zeros(width, dtype=object)
        for own, x in _blocks(batches):
            w = own["w"].to_numpy("int64")
            total += (w @ x if _fits(x, int(w.sum())) else w.astype(object) @ x.astype(object)).astype(object)
        yield pd.DataFrame({"part": [[Decimal(int(v)) for v in total]]})

    parts = groups.mapInPandas(add, "part array<decimal(38,0)>").select(F.posexplode("part").alias("i", "v"))
    return [int(r.s) for r in parts.groupBy("i").agg(F.sum("v").cast("decimal(38,0)").alias("s")).orderBy("i").collect()]


def _covariance(groups: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    width = len(sums)

    def multiply(batches):
        total, seen = np.zeros((width, width)), False
        for own, x in _blocks(batches):
            y, seen = centred(x, n, sums), True
            total += (y * own["w"].to_numpy("float64")[:, None]).T @ y
        if seen:
            yield pd.DataFrame({"i": np.arange(width), "row": list(total)})

    def add(batches):
        rows: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch["i"], batch["row"]):
                rows[i] = rows[i] + row if i in rows else np.array(row)
        if rows:
            yield pd.DataFrame({"i": list(rows), "row": list(rows.values())})

    parts = groups.mapInPandas(multiply, "i int, row array<double>")
    spread = min(width, shuffle_partitions(groups.sparkSession))
    out = np.zeros((width, width))
    for r in parts.repartition(spread, "i").mapInPandas(add, "i int, row array<double>").collect():
        out[r.i] = r.row
    return (out + out.T) / 2 / n


def principal(cov: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns; those of 0 within rounding are left out, and signs are fixed by the largest entry."""
    if not cov.size:
        return np.zeros(0), cov
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:most], axes[:, ::-1][:, :most]
    held = values > max(0.0, values.max(initial=0.0)) * len(cov) * np.finfo(float).eps
    values, axes = values[held], axes[:, held]
    signs = np.sign(axes[np.abs(axes).argmax(0), np.arange(len(values))])
    return values, axes * signs


def whiten(vectors: DataFrame, components: int = COMPONENTS, weights: str = "counts", vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per usable row and component."""
    if weights not in ("counts", "one"):
        raise ValueError("weights are counts or one")
    rows = whole_vectors(vectors, vec_id, vector)
    groups = materialize(rows.groupBy("x").agg(F.count(F.lit(1)).alias("n_rows")).withColumn("w", F.col("n_rows") if weights == "counts" else F.lit(1).cast("long")), "whitening-groups")
    widths = groups.groupBy(F.size("x").alias("width")).agg(F.sum("n_rows").alias("n_rows"), F.sum("w").alias("w"))
    common = widths.orderBy(F.desc("n_rows"), F.desc("width")).first()
    width, n = (common.width, common.w) if common else (0, 0)
    groups = groups.filter(F.size("x") == width)
    sums = _sums(groups, width) if width else []
    cov = _covariance(groups, n, sums) if width else np.zeros((0, 0))
    values, axes = principal(cov, components)
    project = axes / np.sqrt(values)
    kind = "x array<long>, n_rows long, w long, deviation long, z array<double>"

    def apply(batches):
        for own, x in _blocks(batches):
            z = centred(x, n, sums) @ project
            yield pd.DataFrame({"x": own["x"], "n_rows": own["n_rows"], "w": own["w"], "deviation": pd.array(deviations(x, n, sums), "Int64"), "z": list(z)})

    if len(values):
        white = materialize(groups.mapInPandas(apply, kind), "whitening-groups-white")
        error = _identity_error(white, n, len(values))
    else:
        white, error = groups.sparkSession.createDataFrame([], kind), 0.0
    hot = F.broadcast(white.filter(F.col("n_rows") * HOT > (common.n_rows if common else 0)).select("x", "deviation", "z"))
    cold = white.filter(F.col("n_rows") * HOT <= (common.n_rows if common else 0)).select("x", "deviation", "z")
    met = rows.join(hot, "x").unionByName(rows.join(hot.select("x"), "x", "left_anti").join(cold, "x"))
    shares = F.array(*[F.lit(float(v / np.trace(cov))) for v in values]) if len(values) else F.array().cast("array<double>")
    out = met.select("vec_id", "deviation", F.posexplode("z").alias("at", "whitened"))
    return out.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )


def _identity_error(white: DataFrame, n: int, k: int) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    z = [F.get("z", F.lit(i)) for i in range(k)]
    means = white.agg(*[F.sum(F.col("w") * v) / n for v in z]).first()
    off = [v - F.lit(float(m)) for v, m in zip(z, means)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    cov = white.agg(*[F.sum(F.col("w") * off[i] * off[j]) / n for i, j in pairs]).first()
    return float(max(abs(c - (i == j)) for c, (i, j) in zip(cov, pairs)))
