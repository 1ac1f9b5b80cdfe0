"""Quality classifier: a factorisation machine on hashed words, structure statistics and metadata.

The score is sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)): the
sum-of-squares identity gives all pairwise interactions in time linear in the features. x holds the
word counts of a document, hashed into ``BUCKETS`` and scaled to length one, and statistics of its
structure and its length (the only metadata; labels, lang, source and doc_id are no inputs).

The fit takes at most FIT_ROWS labelled rows of each class, picked by hash, with weights that
restore the classes' share among all labelled rows; it is the only bounded step. Every whole text
is scored. Null and empty texts have no words and statistics of 0: a score like any other. Without
rows of both classes to learn from, every score is their share (0.5 without any). A null doc_id,
repeated rows and extra columns make no difference: one row out for each row in, none for an empty table. A very long text is
scored whole, at about a hundred times its words in bytes of memory.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_names
from .labelled import held_out, training_rows

BUCKETS = 1 << 14
RANK = 8
FIT_ROWS = 2500
EPOCHS = 12
KEEP_AT = 0.3
STATISTICS = (
    "log_words", "word_bytes", "distinct_share", "upper_share", "digit_share", "symbol_share", "exclaim_share", "pipe_share",
    "twin_share", "dup_line_share", "words_per_line", "end_mark_share",
)


def document_features(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets (sorted, distinct), their scaled counts, and the statistics."""
    raw = text.encode()
    words = raw.split()  # bytes split at ASCII blanks: the word rule of this package
    n = len(words)
    if not n:
        return np.empty(0, "int64"), np.empty(0), np.zeros(len(STATISTICS))
    crc = zlib.crc32
    hashed = np.fromiter((crc(w) for w in words), "int64", n)
    buckets, counts = np.unique(hashed & (BUCKETS - 1), return_counts=True)
    values = counts / np.sqrt((counts.astype(float) ** 2).sum())
    size = np.bincount(np.frombuffer(raw, "u1"), minlength=256)
    solid = max(1, len(raw) - int(size[[9, 10, 11, 12, 13, 32]].sum()))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    marks = size[[33, 46, 63]].sum()
    stats = np.array(
        [
            np.log1p(n) / 5, solid / n / 10, len(np.unique(hashed)) / n, size[65:91].sum() / solid, size[48:58].sum() / solid,
            size[[35, 36, 37, 38, 42]].sum() / n, size[33] / n, size[124] / n, (hashed[1:] == hashed[:-1]).sum() / n,
            1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)) / 5, marks / n,
        ]
    )
    return buckets, values, np.minimum(stats, 4.0)


class FactorizationMachine:
    def __init__(self, n: int, rank: int = RANK, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.w0, self.w, self.v = 0.0, np.zeros(n), rng.normal(0, 0.05, (n, rank))

    def margins(self, idx: np.ndarray, val: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Raw scores of rows laid end to end (each with a feature at least), and sum_i v_i x_i of each."""
        xv = self.v[idx] * val[:, None]
        sums = np.add.reduceat(xv, starts)
        squares = np.add.reduceat((xv * xv).sum(1), starts)
        return self.w0 + np.add.reduceat(self.w[idx] * val, starts) + 0.5 * ((sums * sums).sum(1) - squares), sums

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 0.05, decay: float = 1e-4, seed: int = 11) -> None:
        """AdaGrad on the weighted logistic loss."""
        rng = np.random.default_rng(seed)
        g0, gw, gv = 1e-8, np.full(len(self.w), 1e-8), np.full(self.v.shape, 1e-8)
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), batch):
                own = order[at : at + batch]
                lengths = np.array([len(rows[i][0]) for i in own])
                idx, val = np.concatenate([rows[i][0] for i in own]), np.concatenate([rows[i][1] for i in own])
                starts = np.r_[0, np.cumsum(lengths)[:-1]]
                raw, sums = self.margins(idx, val, starts)
                slope = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[own]) * weight[own] / len(own)
                per = np.repeat(slope, lengths)
                u, where = np.unique(idx, return_inverse=True)
                dw = np.bincount(where, per * val, len(u)) + decay * self.w[u]
                dv_each = per[:, None] * (val[:, None] * np.repeat(sums, lengths, 0) - self.v[idx] * (val * val)[:, None])
                dv = np.stack([np.bincount(where, dv_each[:, f], len(u)) for f in range(self.v.shape[1])], 1) + decay * self.v[u]
                g0 += slope.sum() ** 2
                gw[u] += dw * dw
                gv[u] += dv * dv
                self.w0 -= rate * slope.sum() / np.sqrt(g0)
                self.w[u] -= rate * dw / np.sqrt(gw[u])
                self.v[u] -= rate * dv / np.sqrt(gv[u])


class QualityModel:
    """The fitted machine with the scale of its statistics; small enough to travel with the task."""

    def __init__(self, machine: FactorizationMachine | None, mean: np.ndarray, scale: np.ndarray, share: float):
        self.machine, self.mean, self.scale, self.share = machine, mean, scale, share

    def row(self, features) -> tuple[np.ndarray, np.ndarray]:
        buckets, values, stats = features
        return np.r_[buckets, BUCKETS + np.arange(len(stats))], np.r_[values, np.clip((stats - self.mean) / self.scale, -5, 5)]

    def score(self, texts: list[str]) -> np.ndarray:
        if self.machine is None or not texts:
            return np.full(len(texts), self.share)
        out = []
        for t in texts:
            idx, val = self.row(document_features(t))
            out.append(self.machine.margins(idx, val, np.zeros(1, int))[0][0])
        return 1 / (1 + np.exp(-np.clip(np.array(out), -30, 30)))


def fit_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, label: str = "quality") -> QualityModel:
    """Fit on the bounded sample of ``training_rows`` (collected: at most 2 * fit_rows rows)."""
    known = labels.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    ones, zeros = known.agg(F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)).first()
    share = ones / (ones + zeros) if ones + zeros else 0.5
    sample = training_rows(docs, labels, label, fit_rows).toPandas().sort_values("doc_id")
    nothing = np.zeros(len(STATISTICS))
    y = sample["y"].to_numpy(float)
    if len(set(y)) < 2:
        return QualityModel(None, nothing, nothing + 1, share)
    features = [document_features(t) for t in sample["text"]]
    stats = np.array([f[2] for f in features])
    model = QualityModel(FactorizationMachine(BUCKETS + len(STATISTICS)), stats.mean(0), stats.std(0) + 0.05, share)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    model.machine.fit([model.row(f) for f in features], y, weight)
    return model


def quality_score(model: QualityModel):
    """A vectorised function of a text column."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(model.score([t or "" for t in texts]), dtype="float64")

    return score


def score_quality(docs: DataFrame, model: QualityModel, keep_at: float = KEEP_AT, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), quality_score(model)(F.col(text)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= keep_at).cast("int"))


def keep_good(docs: DataFrame, model: QualityModel, keep_at: float = KEEP_AT, text: str = "text") -> DataFrame:
    """The rows of docs that are predicted 1, unchanged."""
    (score,) = free_names(docs, "score_here")
    return docs.withColumn(score, quality_score(model)(F.col(text))).filter(F.col(score) >= keep_at).select(*docs.columns)
