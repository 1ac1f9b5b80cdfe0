"""Language identification, embedding whitening and collocations: brute force, held-out accuracy and odd tables."""

import collections
import random
import re
import zlib

import numpy as np
import pytest

from reelgauge.llm import collocations, language_id, whitening

# ---------------------------------------------------------------- whitening

VECTORS = "vec_id long, embedding array<float>, z int, w string"


def brute_whitening(vectors, once=False):
    x = np.floor(np.asarray(vectors, "float64") * 1024) + 100_000
    fit = np.unique(x, axis=0) if once else x
    cov = np.cov(fit.T, bias=True)
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    return len(fit), (x - fit.mean(0)) @ axes / np.sqrt(values), values / values.sum(), ((len(fit) * x - fit.sum(0)) ** 2).sum(1).astype("int64")


@pytest.mark.parametrize("weights", ["counts", "one"])
def test_whitening_against_brute_force(spark, weights):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 12)) * np.linspace(3, 0.2, 12)
    base[100:180] = base[99]  # a hot group of copies
    base[200:210] = base[210:220]
    df = spark.createDataFrame([(i, v.astype("float32").tolist(), 1, "a") for i, v in enumerate(base)], VECTORS).repartition(5)
    got = whitening.whiten(df, 8, weights).toPandas()
    n, white, shares, deviation = brute_whitening(base.astype("float32"), weights == "one")
    assert len(got) == 300 * 8 and set(got["n"]) == {n} and got["identity_error"].max() < 1e-9
    for c, own in got.groupby("component"):
        own = own.set_index("vec_id").sort_index()
        sign = np.sign(own["whitened"].iloc[0] * white[0, c - 1])
        assert np.allclose(own["whitened"] * sign, white[:, c - 1], atol=1e-9) and np.allclose(own["explained"], shares[c - 1])
        assert (own["deviation"].to_numpy() == deviation).all()


def test_whitening_of_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (None, [0.5, 0.25]), (2, None), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [1.0, None]), (6, [1.0]), (7, []), (8, [0.5, 0.25])]
    df = spark.createDataFrame([(*r, 1, "a") for r in rows], VECTORS)
    got = whitening.whiten(df).toPandas()
    assert len(got) == 4 * 2 and set(got["n"]) == {4} and got["vec_id"].isna().sum() == 2
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.filter("vec_id = 7")).count() == 0
    assert whitening.whiten(df.filter("vec_id in (8)")).count() == 0  # equal vectors have no variance
    far = spark.createDataFrame([(1, [1e30, 0.0], 1, "a"), (2, [-1e30, 1.0], 1, "a")], VECTORS)
    assert {r.deviation for r in whitening.whiten(far).collect()} == {None}


def test_exact_numbers_beyond_64_bits():
    x = np.array([[1 << 52, 5], [3, 1 << 50]])
    sums = [int(v) for v in x.sum(0)]
    want = [[2 * int(v) - s for v, s in zip(row, sums)] for row in x]
    assert whitening.offsets(x * 1, 1 << 20, [int(s) << 19 for s in sums]).tolist() == [[(int(v) << 20) - (s << 19) for v, s in zip(row, sums)] for row in x]
    assert whitening.deviations(x, 2, sums) == [None if (d := sum(v * v for v in row)) >= 1 << 63 else d for row in want]


# ---------------------------------------------------------------- collocations

DOCS = "doc_id long, text string, lang string, f long, hash long, a int"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_phrases(rows, support, longest=5, top=2000):
    n, f = collections.Counter(), collections.defaultdict(collections.Counter)
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    f[lang or "und"][tuple(words[i : i + size])] += 1
    out = []
    for lang, counts in f.items():
        kept = {p: c for p, c in counts.items() if c >= support and len(p) > 1}
        covered = {p for q, c in kept.items() for i in range(len(q)) for j in range(i + 2, len(q) + 1) if (p := q[i:j]) != q and 100 * c >= 100 * kept.get(p, 10**9)}
        rows = []
        for p, a in kept.items():
            if p in covered:
                continue
            score, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


@pytest.mark.parametrize(("support", "top", "shard"), [(3, 2000, 100), (5, 7, 400), (2, 50, 10**7)])
def test_collocations_against_brute_force(spark, support, top, shard):
    rng = random.Random(support)
    names = ["a", "b", "C", "dé", "e.f", "g\th", "i\x0bj", "k ,", "l\x1fm", "日本"]
    rows = [(" ".join(rng.choices(names, k=rng.randint(0, 60))), rng.choice(["x", "x", "x", "y", None])) for _ in range(150)]
    rows += [(None, "x"), ("", None), (" \t., ", "z"), ("Same words again and again here. " * 40, "x"), ("w" * 5000 + " tail", "y")] * 2
    df = spark.createDataFrame([(i, t, lang, 1, 1, 1) for i, (t, lang) in enumerate(rows)], DOCS).repartition(3)
    got = sorted(map(tuple, collocations.collocations(df, support, top=top, shard_words=shard).collect()))
    assert got == brute_phrases(rows, support, top=top)
    assert collocations.collocations(df.limit(0), support).count() == 0


def test_long_texts_are_cut_at_pieces_only():
    raw = (b"One two, three" * 40 + b"\tfour. ") * 5
    parts = list(collocations.pieces_of(raw, 100))
    assert len(parts) > 9 and sum(n for _, n in parts) == len(raw) and [w for p, _ in parts for w in p] == [w for p, _ in collocations.pieces_of(raw, 10**9) for w in p]


def test_a_small_filter_changes_nothing(spark):
    rng = random.Random(9)
    rows = [(" ".join(rng.choices("abcdefgh", k=30)), "x") for _ in range(80)]
    df = spark.createDataFrame([(i, t, lang, 1, 1, 1) for i, (t, lang) in enumerate(rows)], DOCS)
    assert sorted(map(tuple, collocations.collocations(df, 4, filter_bits=2048).collect())) == brute_phrases(rows, 4)


def test_shards_of_support_one_hand_back_no_phrases_of_rare_parts(spark, monkeypatch):
    rng, given, made = random.Random(3), [], collocations.candidate_filter
    rows = [(" ".join(["the same words here", *(f"w{rng.randrange(50_000)}" for _ in range(100))]), "x") for _ in range(60)]
    df = spark.createDataFrame([(i, t, lang, 1, 1, 1) for i, (t, lang) in enumerate(rows)], DOCS)
    monkeypatch.setattr(collocations, "candidate_filter", lambda mined, *a: given.append(sum(len(r.gains) for r in mined.collect())) or made(mined, *a))
    assert sorted(map(tuple, collocations.collocations(df, 40, shard_words=100).collect())) == brute_phrases(rows, 40)
    assert sum(given) < 3 * 60 * 104


# ---------------------------------------------------------------- languages


def test_held_out_languages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = language_id.identify_language(docs, language_id.fit_language(docs)).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    assert (got["held_out"] == got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all() and len(got) == docs.count()
    held = got[got["held_out"]]
    assert (held["lang"] == held["lang_pred"]).mean() >= 0.97 and got["score"].between(0, 1).all()


def test_languages_of_odd_tables(spark):
    rows = [(i, f"the quick words of text number {i} and their letters" if i % 2 else f"élève où naïveté çà et là {i}", "en" if i % 2 else "fr") for i in range(60)]
    rows += [(100, None, "en"), (101, "", "en"), (102, "12 34 !?", "fr"), (None, "words without an id", "en"), (103, "nothing told here", None), (104, "the words " * 300_000, None), (3, rows[3][1], "en")]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], DOCS.replace("f long, hash long, a int", "score long, held_out long, p int"))
    model = language_id.fit_language(df)
    got = language_id.identify_language(df, model).toPandas()
    assert len(got) == len(rows) and model.names == ["en", "fr"]
    by_id = got.set_index("doc_id")
    assert by_id.loc[[100, 101, 102], "lang_pred"].tolist() == ["und"] * 3 and by_id.loc[[100, 101, 102], "score"].tolist() == [0.0] * 3
    assert by_id.loc[104, "lang_pred"] == "en" and not got[got["doc_id"].isna()]["held_out"].any() and len(by_id.loc[[3]]) == 2
    nothing = language_id.identify_language(df, language_id.fit_language(df.filter("lang is null")))
    assert {(r.lang_pred, r.score) for r in nothing.collect()} == {("und", 0.0)}
    one = language_id.identify_language(df, language_id.fit_language(df.filter("lang = 'fr'"))).toPandas().set_index("doc_id")
    assert one.loc[104, "lang_pred"] == "fr" and one.loc[104, "score"] == 1.0 and one.loc[100, "lang_pred"] == "und"
    assert language_id.identify_language(df.limit(0), model).count() == 0


def test_leader_steps_against_plain_formula():
    machine = language_id.FollowTheLeader(2, rate=0.3, smooth=0.5, l1=0.01, l2=0.2)
    z, n, w = np.zeros((3, 2)), np.zeros((3, 2)), np.zeros((3, 2))
    rng = np.random.default_rng(1)
    for _ in range(30):
        x, y = rng.random(3), int(rng.integers(2))
        for i in range(3):
            for c in range(2):
                w[i, c] = 0 if abs(z[i, c]) <= 0.01 else -(z[i, c] - np.sign(z[i, c]) * 0.01) / ((0.5 + n[i, c] ** 0.5) / 0.3 + 0.2)
        p = np.exp(x @ w) / np.exp(x @ w).sum()
        for i in range(3):
            for c in range(2):
                g = x[i] * (p[c] - (c == y))
                s = ((n[i, c] + g * g) ** 0.5 - n[i, c] ** 0.5) / 0.3
                z[i, c], n[i, c] = z[i, c] + g - s * w[i, c], n[i, c] + g * g
        machine.learn(np.arange(3), x, y)
    assert np.allclose(machine.z[:3], z) and np.allclose(machine.n[:3], n)


def test_temperature_lowers_the_loss():
    rng = np.random.default_rng(4)
    labels = rng.integers(0, 3, 500)
    margins = 20 * (np.eye(3)[labels] * 0.3 + rng.normal(size=(500, 3)) * 0.3)
    t = language_id.best_temperature(margins, labels)
    loss = lambda m: -np.log(language_id.softmax(m)[np.arange(500), labels]).mean()
    assert loss(margins / t) < loss(margins) and language_id.best_temperature(margins[:0], labels[:0]) == 1.0


def test_buckets_of_a_text_by_hand():
    counts = language_id.gram_counts("A1b")[1]
    assert counts.sum() == len(" a b ") + len(" a b ") - 1 + len(" a b ") - 2 and not len(language_id.gram_counts("1 2")[0])
