"""Queries against brute force on small whole tables."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reelgauge.llm import jaccard_join, queries, source_mix, suffix_dedup, toxicity
from reelgauge.llm.token_counts import MergeCounter
from reelgauge.llm.token_files import LibraryEncoder
from reelgauge.llm.units import text_slices


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()


def run(spark, sf_dir, name):
    return queries.QUERIES[name](spark, sf_dir).toPandas().set_index("doc_id").sort_index()


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_quality_rules(spark, sf_dir, docs):
    got = run(spark, sf_dir, "op9_quality_rules")
    for d in docs.itertuples():
        w = words(d.text)
        spans = collections.defaultdict(list)
        for i in range(len(w) - 7):
            spans[tuple(w[i : i + 8])].append(i)
        twice = {i + k for at in spans.values() if len(at) > 1 for i in at for k in range(8)}
        lines = [x for x in d.text.split("\n") if words(x)]
        row = got.loc[d.doc_id]
        want = (len(w), sum(map(len, w)), sum(d.text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(twice))
        assert tuple(row[["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]]) == want
        assert row.base_failed == (len(w) < 20 or 100 * len(twice) > 30 * len(w)) and not (row.kept and row.base_failed)


def components(ids, links):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize(("k", "num"), [(4, 85), (5, 80), (2, 50)])
def test_jaccard_components(spark, docs, k, num):
    rng = random.Random(k)
    texts = dict(zip(docs.doc_id.tolist(), docs.text.tolist()))
    for n in range(120):  # near copies at all distances, and short texts
        w = words(texts[rng.choice(docs.doc_id.tolist())])[: rng.choice([3, 6, 9, 14, 40, 200])]
        for c in range(3):
            edited = list(w)
            for _ in range(rng.randint(0, 1 + len(w) // 40)):
                edited[rng.randrange(len(edited))] = rng.choice(["Foo", "bar", "baz"])
            texts[10_000 + 3 * n + c] = " ".join(edited)
    sets = {}
    for i, t in texts.items():
        w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in words(t)]
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    order = sorted(sets)
    links = [(a, b) for x, a in enumerate(order) for b in order[x + 1 :] if sets[a] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df, k, num, 100).collect()}
    want = components(order, links)
    assert got == {i: (len(sets[i]), want[i]) for i in order}


def test_divide_skip_equals_counting():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype("uint64")) for _ in range(150)]
    everyone = list(range(150))
    for index, asked in ((everyone, everyone), (everyone[:80], everyone[80:])):
        links = [(a, b) for a in asked for b in index if a != b and 100 * len(np.intersect1d(sets[a], sets[b])) >= 60 * len(np.union1d(sets[a], sets[b]))]
        found = jaccard_join.divide_skip_links(sets, index, asked, 60, 100)
        assert components(everyone, found) == components(everyone, links)


@pytest.mark.parametrize("shard", [2_000_000, 2000])
def test_suffix_dedup(spark, sf_dir, docs, monkeypatch, shard):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard)
    got = run(spark, sf_dir, "op3_suffix_dedup")
    raws = {i: t.encode() for i, t in zip(docs.doc_id, docs.text)}
    seen = collections.Counter(r[i : i + 200] for r in raws.values() for i in range(len(r) - 199))
    for i, r in raws.items():
        gone = np.zeros(len(r), bool)
        for a in range(len(r) - 199):
            if seen[r[a : a + 200]] > 1:
                gone[a : a + 200] = True
        left = np.frombuffer(r, "u1")[~gone].tobytes()
        spans = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        assert tuple(got.loc[i][["n_bytes", "n_removed", "n_spans", "kept_sha256"]]) == (len(r), int(gone.sum()), spans, hashlib.sha256(left).hexdigest())


def test_suffix_arrays_by_sorting():
    rng = random.Random(2)
    for _ in range(60):
        text = bytes(rng.choice(rng.choice([b"\0", b"\0a", b"ab", b"abcdefgh"])) for _ in range(rng.randint(1, 200))) * rng.choice([1, 3])
        order = sorted(range(len(text)), key=lambda i: text[i:])
        a = np.frombuffer(text, "u1")
        assert suffix_dedup.suffix_array(a).tolist() == order

        def shared(x, y):
            n = 0
            while n < 50 and max(x, y) + n < len(text) and text[x + n] == text[y + n]:
                n += 1
            return n

        lcp = suffix_dedup.common_prefixes(a, np.array(order), 50, lane=16)
        assert lcp.tolist() == [0] + [shared(order[i], order[i - 1]) for i in range(1, len(order))]


def test_whole_characters_are_cut():
    raw = "aéb€c".encode()
    assert suffix_dedup.whole_characters(raw, [(2, 6)]) == [(3, 4)]
    assert suffix_dedup.without(raw, [(3, 4)]).decode() == "aé€c"


def test_tokens(spark, sf_dir, docs):
    import sentencepiece
    import tokenizers

    path = queries._vocabulary("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(path)
    ids = {d: e.ids for d, e in zip(docs.doc_id, library.encode_batch(docs.text.tolist(), add_special_tokens=False))}
    counts, files = run(spark, sf_dir, "op7_token_counts"), run(spark, sf_dir, "op4_token_files")
    assert counts.n_tokens.to_dict() == {d: len(x) for d, x in ids.items()}
    start = 0
    for d in sorted(ids):
        own = np.array([*ids[d], 2], "<u4")
        assert tuple(files.loc[d]) == (start, len(own), zlib.crc32(own.tobytes()))
        start += len(own)
    sp = sentencepiece.SentencePieceProcessor(model_file=queries._vocabulary("piece_bpe_32k.model"))
    pieces = run(spark, sf_dir, "op6_sentence_pieces")
    for d, t in zip(docs.doc_id, docs.text):
        own = sp.encode(t, add_bos=True, add_eos=True)
        assert tuple(pieces.loc[d]) == (len(own), hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(own).encode()).hexdigest())


def test_tokens_of_odd_texts():
    import tokenizers

    from reelgauge.llm.sentence_pieces import PieceEncoder

    rng = random.Random(1)
    odd = ["", "<|endoftext|>x<|startoftext|> <|ENDOFTEXT|>", "İstanbul Σας ΣΑΣ", "don't WE'LL 'S's", "▁▁a ▁", "x" * 3000, "it's\x85ok　z", "É. é ́x", "Ünlü, ÀÉ!! ªº"]
    odd += ["".join(rng.choice("ab CHh'\n\t\x0b\x1c.é́\u0331ßΣ<|>endoftxs 12▁日ÀÿÆ,!?×÷ ") for _ in range(rng.randint(1, 80))) for _ in range(1500)]
    path = queries._vocabulary("word_bpe_49k.json")
    lib = tokenizers.Tokenizer.from_file(path).encode_batch(odd, add_special_tokens=False)
    counter, encoder, pieces = MergeCounter(path), LibraryEncoder(path, "<u2", None, True), PieceEncoder(queries._vocabulary("piece_bpe_32k.model"))
    column, counts, ids, encoded = pa.array([*odd, None]), [], [], []
    for texts in text_slices(column, 5000):
        counts += counter.count(texts).tolist()
        flat, ends = encoder.encode(texts)
        ids += [x.tolist() for x in np.split(flat, ends)[:-1]]
        encoded += [x.tolist() for x in pieces.encode(texts)]
    assert counts == [len(e.ids) for e in lib] + [0]
    assert ids == [e.ids for e in lib] + [[]]
    assert encoded == pieces.lib.encode([*odd, ""], add_bos=True, add_eos=True)


def test_vocabularies_that_keep_white_space_are_refused():
    with pytest.raises(ValueError):
        MergeCounter(queries._vocabulary("byte_bpe_50k.json"))
    with pytest.raises(ValueError):
        LibraryEncoder(queries._vocabulary("byte_bpe_50k.json"), "<u2", None, True)


def test_a_difference_from_the_library_stops_the_encoder():
    from reelgauge.llm.sentence_pieces import PieceEncoder

    pieces = PieceEncoder(queries._vocabulary("piece_bpe_32k.model"))
    units = ["▁word", "▁", ",", "\n", "▁▁▁x"]
    pieces.check(units, pieces.agenda(units))
    with pytest.raises(AssertionError):
        pieces.check(units, [*pieces.agenda(units)[:-1], [5]])


def test_targets_by_resharing(spark):
    rng = random.Random(5)
    sizes = {f"s{i:02d}": rng.choice([0, 1, 10, 100, 1000, 5000]) for i in range(23)} | {None: 400}
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in source_mix.source_targets(df).collect()}
    order = [*sorted(s for s in sizes if s is not None), None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while True:
        share = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if share * weight[s] > 3 * sizes[s]}
        if not over:
            target |= {s: share * weight[s] for s in free}
            break
        target |= {s: 3.0 * sizes[s] for s in over}
        left -= sum(3 * sizes[s] for s in over)
        free -= over
    assert got == pytest.approx(target)


def test_mix_is_near_its_targets_and_repeats_itself(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    a = source_mix.mix_sources(docs).toPandas().sort_values("doc_id").reset_index(drop=True)
    b = source_mix.mix_sources(docs.repartition(7)).toPandas().sort_values("doc_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b)
    assert (a.taken <= 3 * a["size"]).all()
    for _, g in a.groupby("source", dropna=False):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= g["size"].max()


def test_rounding_keeps_the_mean(spark):
    rows = [(f"g{g}", 100 * g + i, 1 + i % 7, 0.3, 1) for g in range(200) for i in range(10)]
    out = source_mix.pivotal_rounding(spark.createDataFrame(rows, "grp string, doc_id long, size long, p double, buckets long")).toPandas()
    assert set(out.p) == {0.0, 1.0} and len(out) == 2000
    assert 0.25 < out.p.mean() < 0.35


def test_held_out_accuracy(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir.replace('0.001', '0.1')}/labels.parquet").toPandas().set_index("doc_id")
    large = sf_dir.replace("0.001", "0.1")
    quality = run(spark, large, "op5_quality_classifier").join(labels, how="inner")
    held = quality[quality.held_out]
    assert ((held.predicted == 1) == (held.quality == 1)).mean() > 0.97
    toxic = run(spark, large, "op1_toxicity").join(labels, how="inner")
    held = toxic[toxic.held_out]
    assert ((held.predicted == 1) == (held.toxic == 1)).mean() > 0.93
    assert held[held.toxic == 1].predicted.mean() > 0.85 and held[held.toxic == 0].predicted.mean() < 0.02


def test_kernel_by_enumeration():
    import itertools

    def features(w, p, d):
        out = collections.Counter()
        for at in itertools.combinations(range(len(w)), p):
            out["".join(w[i] for i in at)] += d ** (at[-1] - at[0] + 1)
        return out

    landmarks = ["idiot", "scum", "worthless"]
    kernel = toxicity.WordKernel(landmarks, shared=0.0)  # compare all
    asked = ["idi0t", "scuum", "these", "worth", "th", "idiot"]
    got = kernel.rows(asked)
    for i, w in enumerate(asked):
        for j, z in enumerate(landmarks):
            a, b = features(w, toxicity.ORDER, toxicity.DECAY), features(z, toxicity.ORDER, toxicity.DECAY)
            dot = lambda x, y: sum(v * y[k] for k, v in x.items())
            want = (dot(a, b) / np.sqrt(dot(a, a) * dot(b, b))) ** toxicity.POWER if a else 0.0
            assert got[i, j] == pytest.approx(want, abs=1e-4)


def test_factorisation_identity():
    from reelgauge.llm.quality_classifier import FactorizationMachine

    rng = np.random.default_rng(0)
    fm = FactorizationMachine(9, 3)
    fm.w, fm.v, fm.w0 = rng.normal(size=9), rng.normal(size=(9, 3)), 0.3
    idx, val = np.array([1, 4, 7]), np.array([0.5, -1.0, 2.0])
    pairs = sum(fm.v[idx[i]] @ fm.v[idx[j]] * val[i] * val[j] for i in range(3) for j in range(i))
    assert fm.margins(idx, val, np.zeros(1, int))[0][0] == pytest.approx(0.3 + fm.w[idx] @ val + pairs)


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline

    stages = [name for name, _ in corpus_pipeline.STAGES]
    assert len(stages) == 5 and corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = corpus_pipeline.keep_quality(spark, docs, sf_dir)
    one = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir)
    cut = corpus_pipeline.cut_repeated_passages(spark, docs, sf_dir)
    mix = corpus_pipeline.mix_sources(spark, docs, sf_dir)
    assert good.columns == one.columns == cut.columns == mix.columns == docs.columns
    joined = jaccard_join.jaccard_components(docs).toPandas()
    assert sorted(r.doc_id for r in one.select("doc_id").collect()) == sorted(joined[joined.doc_id == joined.component_id].doc_id)
    spans = suffix_dedup.suffix_dedup(docs).toPandas().set_index("doc_id")
    raws = {r.doc_id: r.text for r in docs.collect()}
    left = {r.doc_id: r for r in cut.collect()}
    for i, text in raws.items():
        if spans.n_removed[i] == 0:
            assert left[i].text == text
        elif i in left:
            assert len(text.encode()) - spans.n_removed[i] <= len(left[i].text.encode()) < len(text.encode()) and left[i].n_chars == len(left[i].text)
    taken = source_mix.mix_sources(docs).toPandas().set_index("doc_id").copies
    assert collections.Counter(r.doc_id for r in mix.select("doc_id").collect()) == collections.Counter({i: c for i, c in taken.items() if c})
    out = corpus_pipeline.run(spark, sf_dir)
    assert set(out.columns) >= {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} and out.count() > 0
    empty = corpus_pipeline.run(spark, _empty(spark, sf_dir))
    assert empty.count() == 0


def _empty(spark, sf_dir):
    import tempfile

    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for t in ("documents", "labels"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(f"{folder}/{t}.parquet")
    return folder


def test_rows_alike_share_their_mass(spark):
    rows = [(None, "s", "a b c")] * 3000 + [(7, "s", "x y")] * 5 + [(i, "t", "w " * (1 + i % 9)) for i in range(2000)] + [(None, "t", None)] * 4
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    mixed = source_mix.mix_sources(docs).toPandas()
    assert len(mixed) == len(rows) and (mixed.taken <= 3 * mixed["size"]).all()
    by_source = mixed.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert ((by_source.taken - by_source.target).abs() <= 9).all()
    assert mixed[mixed.doc_id.isna() & (mixed.source == "s")].copies.max() - mixed[mixed.doc_id.isna() & (mixed.source == "s")].copies.min() <= 1
    kept = source_mix.take_mix(docs).groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), " "))).alias("n")).toPandas().set_index("source").n
    assert all(abs(kept[s] - by_source.target[s]) <= 9 for s in kept.index)


def test_copies_within_a_slice():
    a, d = np.array([5, 7, 5, 5, 5, 7]), np.array([1, 1, 1, 2, 1, 3])
    assert suffix_dedup.copies_within(a, d).tolist() == [-1, 0, 2, 0, 3, 0]
    assert suffix_dedup.copies_within(a[:0], d[:0]).tolist() == []


@pytest.mark.parametrize("batch", [1, 7, 10_000])
def test_one_passage_in_every_document(spark, batch):
    passage = "".join(f"{i * 37 % 1009} " for i in range(90))
    texts = {i: f"{i} start {i * i} {'x' * (i % 5)}" + passage + (passage if i % 4 == 0 else "") + f" end {i}" for i in range(60)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {r.doc_id: r.n_removed for r in suffix_dedup.suffix_dedup(spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    seen = collections.Counter(t[i : i + 200] for t in texts.values() for i in range(len(t) - 199))
    for i, t in texts.items():
        assert got[i] == len({p for a in range(len(t) - 199) if seen[t[a : a + 200]] > 1 for p in range(a, a + 200)})
