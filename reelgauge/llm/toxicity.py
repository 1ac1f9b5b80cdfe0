"""Toxicity: a support vector machine on the subsequence string kernel with Nystroem landmarks.

The kernel of two words sums over their common subsequences of ``ORDER`` letters, gaps allowed,
each weighted by DECAY to the power of the stretches it spans, and is normed to 1 for equal words; an
inserted or dropped character thus lowers it only a little; the normed value is squared. A text is the bag of its
units: words (lower case, punctuation off), the heads of words, and letters set apart by blanks put together.
Landmarks are heads that a family of words shares and words that mark toxic training documents, by
presence or by use twice or more in one document, unlike one another. With each landmark a text has two values: its
best kernel, and the logarithm of one more than the sum of its kernels, so that words which clean texts hold
now and then count by their repetition. Both, multiplied by K_ZZ^-1/2, are the Nystroem features of the text. One linear machine (squared hinge
loss) is trained on them: labelled documents, the sentences of clean documents that are like a landmark, and insults with a strange or a
doubled letter, of landmarks that clean documents hardly hold. A logistic fit maps its value to 0..1.

K_ZZ is the whole kernel, so it is positive semidefinite. For a text only kernels of FLOOR (best) and HIT (sums) or more count,
and they are computed where the word has SHARED of the landmark's letter pairs.

The fit takes at most FIT_ROWS labelled rows of each class, picked by hash, chooses at most LANDMARKS landmarks of them and draws at most FIT_SENTENCES
of their sentences. Nothing else is bounded. Every whole text is scored; labels, lang, source and doc_id are no inputs. Null and empty
texts have no unit and score as one without any likeness. Without rows of both classes to
learn from, every score is 0. A null doc_id, repeated rows and extra columns make no difference:
one row out for each row in, none for an empty table. A very long text is scored whole, at about a hundred bytes a word.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, training_rows

ORDER = 3
DECAY = 0.9
LANDMARKS = 48
HEADS = range(3, 9)  # lengths of the heads of words that are counted as families
SURE = 9.0  # least log likelihood gain of a landmark over the share of toxic documents
COPIES = 8  # documents with the same least hash of words of this many letters count once for the choice
OFTENER = 4.0  # and how much oftener toxic documents hold it than clean ones
FLOOR = 0.3  # kernels from here on count as a text's best
HIT = 0.6  # and from here on add to its sum
SHARED = 0.4
RIDGE = 0.1
UNLIKE = 0.7  # a landmark's kernel with those chosen before it stays below this
CLEAN_LANDMARKS = 0
POWER = 2  # an integer power of a kernel is a kernel; it sets near words further off from chance likeness
FIT_ROWS = 1000
FIT_SENTENCES = 60_000
SENTENCE_WEIGHT = 0.1  # of a clean sentence, in documents
INSULT_WEIGHT = 0.3  # of a landmark that clean documents hardly hold, or of a disguise of it, standing alone
TOXIC_AT = 0.5
WINDOW = 24  # longer units are compared by overlapping windows of this many characters
CACHED_UNITS = 150_000

SENTENCE = re.compile(r"[.!?]+(?=[\x20\x09-\x0D]|$)|\n")
MARKS = re.compile(r"[\W_]+")


def unit_form(token: str) -> str:
    return MARKS.sub("", token.lower())


LETTERS_APART = re.compile("1{3,}")


def sentence_units(sentence: str) -> list[str]:
    """Tokens, and each run of three or more one-letter tokens as one unit more."""
    tokens = sentence.split()
    lengths = list(map(len, tokens))
    if lengths.count(1) < 3:
        return tokens
    marks = "".join(["1" if n == 1 else "0" for n in lengths])
    return tokens + ["".join(tokens[run.start() : run.end()]) for run in LETTERS_APART.finditer(marks)]


def windows(form: str) -> list[str]:
    if len(form) <= WINDOW:
        return [form]
    half = WINDOW // 2
    return [form[i : i + WINDOW] for i in range(0, len(form) - half, half)]


def _codes(words: list[str]) -> np.ndarray:
    """Code points, padded by -1; the words hold no NUL."""
    width = max(map(len, words))
    flat = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le"), "<i4").reshape(len(words), width)
    return np.where(flat == 0, -1, flat)


def _kernel(s: np.ndarray, t: np.ndarray, order: int, decay: float) -> np.ndarray:
    """Unnormed kernels of words s (rows, n; padded by -1) with t (padded by -2): all of (landmarks, m), or each row with its own of (rows, 1, m).

    The usual recursion over prefixes, one letter of s at a time; along t the decaying sums are one product with a triangle of powers.
    """
    m = t.shape[-1]
    t = t if t.ndim == 3 else t[None]
    gap = np.arange(m)[None, :] - np.arange(m)[:, None]
    triangle = np.where(gap >= 0, np.float32(decay) ** np.maximum(gap, 0), 0).astype("float32") * np.float32(decay * decay)
    prefix = [None] + [np.zeros((len(s), t.shape[1], m), "float32") for _ in range(order - 1)]  # without the empty prefix of t
    total = np.zeros((len(s), t.shape[1], m), "float32")
    for a in range(s.shape[1]):
        same = (s[:, a][:, None, None] == t).astype("float32")
        total[..., 1:] += same[..., 1:] * prefix[order - 1][..., :-1]
        for i in range(order - 1, 0, -1):
            step = same
            if i > 1:
                step = np.zeros_like(same)
                np.multiply(same[..., 1:], prefix[i - 1][..., :-1], out=step[..., 1:])
            prefix[i] *= np.float32(decay)
            prefix[i] += step @ triangle
    return total.sum(2) * np.float32(decay * decay)


class WordKernel:
    """Normed kernels of words with fixed landmarks.

    A kernel is computed where the word has SHARED of the landmark's letter pairs (at distance one or two); elsewhere it counts as 0.
    """

    def __init__(self, landmarks: list[str], order: int = ORDER, decay: float = DECAY, shared: float = SHARED):
        self.landmarks, self.order, self.decay = landmarks, order, decay
        if not landmarks:
            return
        self.codes = np.where((codes := _codes(landmarks)) == -1, -2, codes)
        self.own = self.self_kernel(landmarks)
        self.alphabet = np.unique(self.codes[self.codes > 0])
        k = len(self.alphabet) + 1
        self.pairs = np.zeros((k * k, len(landmarks)), "int16")
        letters = self._letters(self.codes)
        for i, z in enumerate(letters):
            z = z[: len(landmarks[i])]
            for step in (1, 2):
                self.pairs[z[:-step] * k + z[step:], i] = 1
        self.pairs[0] = 0
        self.pairs[:k] = 0
        self.pairs[::k] = 0  # pairs with a letter of no landmark
        self.least = shared * self.pairs.sum(0)

    def _letters(self, codes: np.ndarray) -> np.ndarray:
        """Places in the alphabet from 1; 0 for other letters."""
        at = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == codes, at + 1, 0)

    def self_kernel(self, words: list[str]) -> np.ndarray:
        """k(w, w) of each word."""
        s = _codes(words)
        return _kernel(s, np.where(s == -1, -2, s)[:, None, :], self.order, self.decay)[:, 0]

    def rows(self, words: list[str]) -> np.ndarray:
        """(len(words), landmarks); words by length, so that a block needs little padding."""
        out = np.zeros((len(words), len(self.landmarks)), "float32")
        by_length: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) >= self.order:
                by_length.setdefault((len(w) + 1) // 2, []).append(i)
        k = len(self.alphabet) + 1 if self.landmarks else 1
        for at in by_length.values():
            for a in range(0, len(at), 1024):
                own = np.array(at[a : a + 1024])
                codes = _codes([words[i] for i in own])
                letters = self._letters(codes)
                common = sum(self.pairs[letters[:, :-step] * k + letters[:, step:]].sum(1) for step in (1, 2))
                word, mark = np.nonzero(common >= self.least)
                if not len(word):
                    continue
                alike, back = np.unique(word, return_inverse=True)
                norm = self.self_kernel([words[i] for i in own[alike]])[back] * self.own[mark]
                found = np.concatenate([_kernel(codes[word[c : c + 1024]], self.codes[mark[c : c + 1024]][:, None, :], self.order, self.decay)[:, 0] for c in range(0, len(word), 1024)])
                out[own[word], mark] = (found / np.sqrt(np.maximum(norm, 1e-24))) ** POWER
        return out


class ToxicityModel:
    """weights: of the best kernels and of the logarithms of sums, landmark by landmark; slope and shift map the machine's value."""

    def __init__(self, landmarks: list[str], weights: np.ndarray, bias: float, slope: float, shift: float):
        self.landmarks, self.weights, self.bias, self.slope, self.shift = landmarks, weights, bias, slope, shift
        self._reset()

    def _reset(self):
        self.kernel, self.tokens, self.forms, self.matrix, self.used = None, {}, {}, None, 0

    def __getstate__(self):
        return {k: getattr(self, k) for k in ("landmarks", "weights", "bias", "slope", "shift")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._reset()

    def likeness(self, token_sets: list[list[str]]) -> None:
        """Fill the cache with the kernel rows of all tokens that it lacks."""
        if self.kernel is None:
            self.kernel = WordKernel(self.landmarks)
            self.matrix = np.zeros((1024, len(self.landmarks)), "float32")
            self.heads = sorted({len(z) for z in self.landmarks if len(z) in HEADS})
        if self.used > CACHED_UNITS or len(self.tokens) > 2 * CACHED_UNITS:
            self.tokens, self.forms, self.used = {}, {}, 0
        new = list(set().union(*token_sets) - self.tokens.keys()) if token_sets else []
        if not new:
            return
        forms = [unit_form(t) for t in new]
        todo = list(set(forms) - self.forms.keys())
        cut = [[*windows(f), *(f[:n] for n in self.heads if n < len(f))] for f in todo]
        counts = [len(c) for c in cut]
        if todo:
            at = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(cut)))}
            rows = self.kernel.rows(list(at))[np.fromiter(map(at.__getitem__, chain.from_iterable(cut)), "int64")]
            best = np.maximum.reduceat(rows, np.r_[0, np.cumsum(counts)[:-1]])
            while self.used + len(todo) > len(self.matrix):
                self.matrix = np.concatenate([self.matrix, np.zeros_like(self.matrix)])
            self.matrix[self.used : self.used + len(todo)] = np.where(best >= FLOOR, best, 0)
            self.forms.update(zip(todo, range(self.used, self.used + len(todo))))
            self.used += len(todo)
        self.tokens.update((t, self.forms[f]) for t, f in zip(new, forms))

    def values(self, texts: list[str]) -> np.ndarray:
        """Per text its best kernels, and the logarithms of the sums: (texts, 2 * landmarks)."""
        cut = [sentence_units(t) for t in texts]
        self.likeness(cut)
        like = self.matrix[: self.used].any(1)
        n = len(self.landmarks)
        out = np.zeros((len(texts), 2 * n))
        for i, units in enumerate(cut):
            at = np.fromiter(map(self.tokens.__getitem__, units), "int64", len(units))
            hits = self.matrix[at[like[at]]] if len(at) else self.matrix[:0]
            if len(hits):
                out[i, :n] = hits.max(0)
                out[i, n:] = np.log1p(np.where(hits >= HIT, hits, 0).sum(0, dtype=float))
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        if not self.landmarks:
            return np.zeros(len(texts))
        value = self.values(texts) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * value + self.shift, -30, 30)))


def _slices(texts: list[str], most: int = 3_000_000) -> Iterator[list[str]]:
    out, size = [], 0
    for t in texts:
        out.append(t)
        size += len(t)
        if size >= most:
            yield out
            out, size = [], 0
    if out:
        yield out


def choose_landmarks(texts: list[str], y: np.ndarray, n_toxic: int = LANDMARKS, n_clean: int = CLEAN_LANDMARKS) -> tuple[list[str], list[str]]:
    """Words, and heads that words share, which toxic documents hold, or hold twice, oftener than clean ones: by their log likelihood gain
    and unlike those chosen already; then common clean words. Beside them those of the toxic ones that clean documents hardly hold."""
    once, twice, seen = [Counter(), Counter()], [Counter(), Counter()], Counter()
    sizes, known = [0, 0], set()
    for t, label in zip(texts, y):
        words = Counter(map(unit_form, sentence_units(t)))
        copy = int(label), min((crc32(w.encode()) for w in words if len(w) >= COPIES), default=t)
        if copy in known:
            continue
        known.add(copy)
        sizes[int(label)] += 1
        held = Counter()
        for w, n in words.items():
            for k in {*(k for k in HEADS if k < len(w)), len(w)}:
                if ORDER <= k <= WINDOW:
                    held[w[:k]] += n
        once[int(label)].update(held.keys())
        twice[int(label)].update(w for w, n in held.items() if n > 1)
        if label == 0 and n_clean:
            seen.update(words.keys())
    n0, n1 = (max(1, n) for n in sizes)
    gain: dict[str, float] = {}
    for count in (once, twice):
        for w, a in count[1].items():
            b = count[0][w]
            if a > 1 and a / n1 >= OFTENER * b / n0:
                g = a * np.log(a / (a + b) * (n0 + n1) / n1) + (b * np.log(b / (a + b) * (n0 + n1) / n0) if b else 0.0)
                gain[w] = max(gain.get(w, 0.0), round(float(g), 6))
    toxic = [w for w in sorted(gain, key=lambda w: (-gain[w], -len(w), w)) if gain[w] >= SURE][: 12 * n_toxic]
    clean = [w for w, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0])) if ORDER <= len(w) <= WINDOW][: 12 * n_clean]
    chosen: list[str] = []
    for words, n in ((toxic, n_toxic), (clean, n_clean)):
        if not words:
            continue
        likeness = WordKernel(words).rows(words)
        best = np.zeros(len(words))
        for _ in range(n):
            free = np.flatnonzero(best < UNLIKE)
            if not len(free):
                break
            chosen.append(z := words[free[0]])
            akin = np.array([w.startswith(z) or z.startswith(w) for w in words])  # of one family
            best = np.maximum(best, np.where(akin, 1.0, likeness[:, free[0]]))
    chosen = list(dict.fromkeys(chosen))
    return chosen, [z for z in chosen if z in gain and once[1][z] / n1 > 20 * once[0][z] / n0]


def disguised(word: str) -> list[str]:
    """The word with a strange letter put in, or a letter doubled, at each inner place."""
    return [v for i in range(1, len(word)) for v in (f"{word[:i]}0{word[i:]}", word[:i] + word[i - 1 :])]


def _linear_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = RIDGE, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Squared hinge loss by Newton steps over the rows inside the margin."""
    x1 = np.c_[x, np.ones(len(x))]
    w = np.zeros(x1.shape[1])
    reg = ridge * np.eye(len(w))
    reg[-1, -1] = 1e-6
    active = np.ones(len(y), bool)
    for _ in range(rounds):
        a, c = x1[active], weight[active][:, None]
        w = np.linalg.solve(reg + (a * c).T @ a, (a * c).T @ y[active])
        now = y * (x1 @ w) < 1
        if (now == active).all():
            break
        active = now
    return w[:-1], float(w[-1])


def _logistic(f: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and shift with a small ridge, and targets off 0 and 1 so that a clean split stays finite."""
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    x, w = np.c_[f, np.ones(len(f))], np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - target) + 1e-3 * w)
        w -= np.clip(step, -2, 2)
    return float(w[0]), float(w[1])


def fit_rows(texts: list[str], y: np.ndarray) -> ToxicityModel:
    landmarks, marked = choose_landmarks(texts, y) if len(set(y)) == 2 else ([], [])
    if not landmarks:
        return ToxicityModel([], np.zeros(0), 0.0, 1.0, 0.0)
    whole = WordKernel(landmarks, shared=0.0)
    kzz = whole.rows(landmarks).astype(float)
    values, vectors = np.linalg.eigh((kzz + kzz.T) / 2)
    keep = values > 1e-6
    root = vectors[:, keep] / np.sqrt(values[keep])
    n = len(landmarks)
    nystroem = lambda v: np.c_[v[:, :n] @ root, v[:, n:] @ root]
    probe = ToxicityModel(landmarks, np.zeros(2 * n), 0.0, 1.0, 0.0)
    documents = np.concatenate([probe.values(part) for part in _slices(texts)])
    sentences = [s for t, label in zip(texts, y) if label == 0 for s in SENTENCE.split(t) if s.strip()]
    if len(sentences) > FIT_SENTENCES:
        sentences = [sentences[i] for i in np.random.default_rng(3).permutation(len(sentences))[:FIT_SENTENCES]]
    clean = np.concatenate([probe.values(part) for part in _slices(sentences)] or [np.zeros((0, 2 * n))])
    clean = clean[clean.any(1)]
    kernels = whole.rows([w for z in marked for w in (z, *disguised(z))]).astype(float).reshape(-1, n)
    gapped = np.c_[np.where(kernels >= FLOOR, kernels, 0), np.log1p(np.where(kernels >= HIT, kernels, 0))]
    x = nystroem(np.r_[documents, clean, gapped])
    target = np.r_[np.where(y == 1, 1.0, -1.0), -np.ones(len(clean)), np.ones(len(gapped))]
    weight = np.r_[np.ones(len(y)), np.full(len(clean), SENTENCE_WEIGHT), np.full(len(gapped), INSULT_WEIGHT)]
    w, b = _linear_svm(x, target, weight)
    slope, shift = _logistic(nystroem(documents) @ w + b, y)
    r = root.shape[1]
    return ToxicityModel(landmarks, np.r_[root @ w[:r], root @ w[r:]], b, slope, shift)


def fit_toxicity(docs: DataFrame, labels: DataFrame, per_class: int = FIT_ROWS, label: str = "toxic") -> ToxicityModel:
    """Fit on the bounded sample of ``training_rows`` (collected: at most 2 * per_class rows)."""
    sample = training_rows(docs, labels, label, per_class).toPandas().sort_values("doc_id")
    return fit_rows(list(sample["text"]), sample["y"].to_numpy(int))


def score_toxicity(docs: DataFrame, model: ToxicityModel, toxic_at: float = TOXIC_AT, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, held_out, score, predicted."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            parts = [model.score(part) for part in _slices([t or "" for t in texts])]
            yield pd.Series(np.concatenate(parts) if parts else [], dtype="float64")

    scored = docs.select(F.col(doc_id).alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), score(F.col(text)).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= toxic_at).cast("int"))
