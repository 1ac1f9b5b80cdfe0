"""Toxic words that come as families of one head and show by repetition, not by one use."""

import random

import numpy as np

from reelgauge.llm import toxicity

SYLLABLES = ["ta", "ne", "lo", "ri", "su", "ga", "mo", "pe", "du", "ki", "vo", "ba"]


def family_texts(n, uses, seed):
    """Texts of 20 sentences; of their words, ``uses()`` begin with one head and end in other syllables each time."""
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice(SYLLABLES) for _ in range(k))
    out = []
    for _ in range(n):
        words = [word(rng.randint(1, 4)) for _ in range(160)]
        for i in rng.sample(range(160), uses(rng)):
            words[i] = "zhreux" + word(rng.randint(1, 3))
        out.append(". ".join(" ".join(words[i : i + 8]) for i in range(0, 160, 8)) + ".")
    return out


def test_a_family_of_rare_words_counts_by_its_repetition():
    often, seldom = (lambda rng: rng.randint(6, 10)), (lambda rng: rng.random() < 0.25)
    model = toxicity.fit_rows(family_texts(60, often, 1) + family_texts(240, seldom, 2), np.repeat([1, 0], [60, 240]))
    assert (model.score(family_texts(40, often, 3)) >= toxicity.TOXIC_AT).mean() > 0.95
    assert (model.score(family_texts(200, seldom, 4)) >= toxicity.TOXIC_AT).mean() < 0.02


def test_kernels_that_count_are_those_of_the_whole_kernel(spark, sf_dir):
    """Words of the given documents and disguised landmarks: the pair filter hides no kernel of FLOOR or more."""
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    landmarks = ["worthless", "idiot", "scum", "moron", "reeux", "achlich", "zhreux"]
    words = sorted({toxicity.unit_form(w) for t in texts for w in t.split()} - {""})[:20_000:2] + [w for z in landmarks for w in toxicity.disguised(z)]
    words = [w for w in words if len(w) <= toxicity.WINDOW]
    cut, whole = toxicity.WordKernel(landmarks).rows(words), toxicity.WordKernel(landmarks, shared=0.0).rows(words)
    counts = whole >= toxicity.FLOOR
    assert counts.sum() > 30 and np.allclose(cut[counts], whole[counts]) and (cut[~counts] < toxicity.FLOOR).all()
    kzz = toxicity.WordKernel(landmarks, shared=0.0).rows(landmarks)
    assert np.linalg.eigvalsh(kzz).min() > -1e-5 and np.allclose(np.diag(kzz), 1, atol=1e-4)


def test_values_of_a_text_by_hand():
    landmarks = ["idiot", "scum"]
    model = toxicity.ToxicityModel(landmarks, np.zeros(4), 0.0, 1.0, 0.0)
    text = "You idiot! Idi0t; s c u m and a scuum of plain words, worthless"
    units = [toxicity.unit_form(u) for u in toxicity.sentence_units(text)]
    k = toxicity.WordKernel(landmarks, shared=0.0).rows([u for u in units if u])
    want = np.r_[np.where(k >= toxicity.FLOOR, k, 0).max(0), np.log1p(np.where(k >= toxicity.HIT, k, 0).sum(0))]
    assert np.allclose(model.values([text, "", "plain words"])[0], want, atol=1e-5) and not model.values(["", "plain words"]).any()


def test_machine_against_descent():
    rng = np.random.default_rng(1)
    x, y, c = rng.normal(size=(60, 3)), np.sign(rng.normal(size=60)), rng.random(60) + 0.1
    w, b = toxicity._linear_svm(x, y, c, ridge=0.5)
    v = np.zeros(4)
    for _ in range(20_000):
        slack = np.maximum(0, 1 - y * (x @ v[:3] + v[3]))
        v -= 0.002 * np.r_[0.5 * v[:3] - (c * slack * y) @ x, 1e-6 * v[3] - (c * slack * y).sum()]
    assert np.allclose(np.r_[w, b], v, atol=1e-3)


def test_gapped_and_inserted_letters_are_caught():
    rng = random.Random(7)
    plain = lambda: " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(60))
    clean = [plain() for _ in range(120)]
    insult = lambda w: (lambda t: t[:100] + f" {w} " + t[100:])(plain())
    model = toxicity.fit_rows(clean + [insult("worthless") for _ in range(40)], np.repeat([0, 1], [120, 40]))
    for form in ("worthless", "WORTHLESS!", "wor0thless", "worthlesss", "wo-rth-less", "w o r t h l e s s", "worth*less", "woorthless"):
        assert (model.score([insult(form) for _ in range(10)]) >= toxicity.TOXIC_AT).all(), form
    assert (model.score([plain() for _ in range(60)]) < toxicity.TOXIC_AT).all()
