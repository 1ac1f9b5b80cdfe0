"""Language identification: multinomial logistic regression on TF-IDF character n-grams, calibrated by a temperature.

Features of a text are its n-grams of one to LONGEST characters, lower-cased, with each run of other characters than letters as one
blank, hashed into ``BUCKETS``; tf is an n-gram's share of all n-grams of the text, so that a text's margins are means
of its n-grams' weights and every text is scored in one pass, whole. Document frequencies are counted over all documents
that may be learned from. The weights come from follow-the-regularised-leader steps with L1 and L2 penalties on
at most FIT_ROWS documents in all, the same number of each language, picked by hash; one in HOLD of these is kept from
the fit and sets the temperature that its log loss is least at.

Only documents with a text, a lang and an id whose crc32 leaves no remainder of 1 by FOLDS are learned from. A text that is null or
has no letter is ``und`` with score 0, and so is every text where nothing can be learned (an empty table gives no rows). With one language
learned every other text is of it, with score 1. Ties go to the first language by code point. One row for each row in, repeats and null ids
included; a null id is not held out. Extra columns are ignored. A very long text is hashed CHUNK characters at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, unit_hash

BUCKETS = 1 << 16
BLOCK = 1 << 11  # buckets whose counts travel as one row
LONGEST = 3
FOLDS = 3
FIT_ROWS = 6000
HOLD = 5
EPOCHS = 3
CHUNK = 1_000_000
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 1, F.lit(False))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def gram_buckets(text: str) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of a text, in arrays of bounded size; none for a text without a letter."""
    for at in range(0, len(text), CHUNK):
        codes = np.frombuffer(text[at : at + CHUNK].lower().encode("utf-32-le", "surrogatepass"), "<u4")
        letter = _letters()[codes]
        if not letter.any():
            continue
        marked = np.where(letter, codes, 32).astype("uint64")
        marked = np.r_[np.uint64(32), marked[letter | np.r_[True, letter[:-1]]], np.uint64(32)]
        h = np.zeros(len(marked), "uint64")
        for size in range(1, LONGEST + 1):
            h = (h[: len(marked) - size + 1] * np.uint64(0x100000001B3)) + marked[size - 1 :]
            mixed = (h + np.uint64(size)) * np.uint64(0x9E3779B97F4A7C15)
            yield (mixed >> np.uint64(48)).astype("int64") & (BUCKETS - 1)


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their counts."""
    parts = list(gram_buckets(text))
    return np.unique(np.concatenate(parts), return_counts=True) if parts else (np.empty(0, "int64"), np.empty(0, "int64"))


class FollowTheLeader:
    """FTRL-Proximal steps for a softmax over classes; weights follow from z and n, and most stay exactly 0."""

    def __init__(self, classes: int, rate: float = 0.5, smooth: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.z, self.n = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))
        self.rate, self.smooth, self.l1, self.l2 = rate, smooth, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        pull = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -pull / ((self.smooth + np.sqrt(n)) / self.rate + self.l2)

    def learn(self, at: np.ndarray, values: np.ndarray, label: int) -> None:
        w = self.weights(at)
        slope = softmax((values @ w)[None])[0]
        slope[label] -= 1
        g = values[:, None] * slope
        n = self.n[at]
        step = (np.sqrt(n + g * g) - np.sqrt(n)) / self.rate
        self.z[at] += g - step * w
        self.n[at] = n + g * g


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def best_temperature(margins: np.ndarray, labels: np.ndarray) -> float:
    """Of temperatures from 1/64 to 64 the one with the least log loss."""
    if not len(labels):
        return 1.0
    tried = 2.0 ** np.linspace(-6, 6, 193)
    loss = [-np.log(np.maximum(softmax(margins / t)[np.arange(len(labels)), labels], 1e-300)).mean() for t in tried]
    return float(tried[int(np.argmin(loss))])


class LanguageModel:
    """names: languages by code point; table: a weight per bucket and language, idf and scale included."""

    def __init__(self, names: list[str], table: np.ndarray, temperature: float):
        self.names, self.table, self.temperature = names, table, temperature

    def margins(self, text: str) -> np.ndarray | None:
        total, n = np.zeros(len(self.names)), 0
        for buckets in gram_buckets(text):
            total += self.table[buckets].sum(0, dtype="float64")
            n += len(buckets)
        return total / n if n else None

    def predict(self, text: str | None) -> tuple[str, float]:
        margins = self.margins(text) if text is not None and self.names else None
        if margins is None:
            return UNKNOWN, 0.0
        p = softmax(margins[None] / self.temperature)[0]
        best = int(p.argmax())
        return self.names[best], float(p[best])


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of the texts each bucket occurs, and how many texts there are."""

    def count(batches):
        seen, n = np.zeros(BUCKETS, "int64"), 0
        for batch in batches:
            for t in batch["text"]:
                own = np.zeros(BUCKETS, bool)
                for buckets in gram_buckets(t):
                    own[buckets] = True
                seen += own
                n += 1
        yield pd.DataFrame({"block": np.arange(BUCKETS // BLOCK), "n": n * (np.arange(BUCKETS // BLOCK) == 0), "counts": list(seen.reshape(-1, BLOCK))})

    def add(batches):
        n, sums = {}, {}
        for batch in batches:
            for b, k, own in zip(batch["block"], batch["n"], batch["counts"]):
                n[b], sums[b] = n.get(b, 0) + k, sums.get(b, 0) + np.asarray(own)
        if sums:
            yield pd.DataFrame({"block": list(sums), "n": list(n.values()), "counts": list(sums.values())})

    kind = "block int, n long, counts array<long>"
    parts = texts.mapInPandas(count, kind).repartition(min(BUCKETS // BLOCK, shuffle_partitions(texts.sparkSession)), "block")
    df, n_docs = np.zeros((BUCKETS // BLOCK, BLOCK), "int64"), 0
    for r in parts.mapInPandas(add, kind).collect():
        df[r.block], n_docs = r.counts, n_docs + r.n
    return df.ravel(), n_docs


def fit_sample(known: DataFrame, counts: dict[str, int], fit_rows: int) -> pd.DataFrame:
    """lang, hold, at, n (n-gram counts) of at most fit_rows documents, the same number of each language."""
    quota = max(1, fit_rows // max(1, len(counts)))
    rates = F.create_map(*[F.lit(v) for lang, n in sorted(counts.items()) for v in (lang, min(1.0, 2 * quota / n))])
    order = (F.xxhash64("doc_id", F.lit("fit")), F.col("doc_id"), F.col("text"))
    thinned = known.filter(unit_hash(F.col("doc_id"), F.lit("fit")) < F.coalesce(F.try_element_at(rates, F.col("lang")), F.lit(0.0)))
    picked = thinned.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("nth") <= quota)

    def features(batches):
        for batch in batches:
            found = [gram_counts(t) for t in batch["text"]]
            yield pd.DataFrame({"lang": batch["lang"], "nth": batch["nth"], "at": [f[0] for f in found], "n": [f[1] for f in found]})

    got = picked.select("lang", "nth", "text").mapInPandas(features, "lang string, nth int, at array<int>, n array<int>").toPandas()
    got = got.sort_values(["lang", "nth"], ignore_index=True)
    return got[got["at"].map(len) > 0].assign(hold=lambda d: d["nth"] % HOLD == 0)


def fit_language(docs: DataFrame, fit_rows: int = FIT_ROWS, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", epochs: int = EPOCHS) -> LanguageModel:
    named = docs.select(docs[doc_id].alias("doc_id"), docs[lang].cast("string").alias("lang"), docs[text].alias("text"))
    known = named.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    sample = fit_sample(known, counts, fit_rows) if counts else pd.DataFrame({"lang": []})
    names = sorted(set(sample["lang"]))
    if len(names) < 2:
        return LanguageModel(names, np.zeros((BUCKETS, len(names)), "float32"), 1.0)
    df, n_docs = document_frequencies(known.select("text"))
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    at = [np.asarray(a, "int64") for a in sample["at"]]
    tf = [np.asarray(n, float) / np.sum(n) for n in sample["n"]]
    scale = 1 / np.median([np.linalg.norm(v * idf[a]) for a, v in zip(at, tf)])
    values = [v * idf[a] * scale for a, v in zip(at, tf)]
    labels = np.array([names.index(x) for x in sample["lang"]])
    fit, held = np.flatnonzero(~sample["hold"].to_numpy()), np.flatnonzero(sample["hold"].to_numpy())
    machine = FollowTheLeader(len(names))
    rng = np.random.default_rng(3)
    for _ in range(epochs):
        for i in rng.permutation(fit):
            machine.learn(at[i], values[i], labels[i])
    weights = machine.weights()
    margins = np.array([values[i] @ weights[at[i]] for i in held]).reshape(len(held), len(names))
    return LanguageModel(names, (weights * (idf * scale)[:, None]).astype("float32"), best_temperature(margins, labels[held]))


def identify_language(docs: DataFrame, model: LanguageModel, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred, score."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score"])

    scored = docs.select(docs[doc_id].alias("doc_id"), predict(docs[text]).alias("p"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "p.lang_pred", "p.score")
