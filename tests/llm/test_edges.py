"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and extra columns, for every operator."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from reelgauge.llm import embedding_dedup, jaccard_join, quality_classifier, quality_rules, sentence_pieces, source_mix, suffix_dedup, token_counts, token_files, toxicity

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, leader string, anchor int, blocks int, sig int, copies string, label string"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(20_000))
ROWS = [
    (1, "a plain text of a few words that is here to be counted by all of them", "en", "s1"),
    (1, "a plain text of a few words that is here to be counted by all of them", "en", "s1"),
    (2, "", "en", None), (3, None, None, "s2"), (None, "no id at all but some text", "en", "s1"), (4, " \t\n ", "en", "s2"),
    (5, LONG, None, "s1"), (6, LONG, "en", "s2"), (7, "x" * 5000, "en", "s1"), (8, "é▁ß 日本 \x00 \x1c<|endoftext|>", "fr", ""), (None, None, None, None),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 0, 1, 0.5, "l", 1, 2, 3, "c", "t") for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


LABELS = "doc_id long, quality int, toxic int"


def fitted(spark, module, docs, labels):
    return (quality_classifier.score_quality(docs, quality_classifier.fit_quality(docs, labels))) if module == "quality" else toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels))


OPERATORS = {
    "rules": lambda d: quality_rules.quality_rules(d), "mix": lambda d: source_mix.mix_sources(d), "counts": lambda d: token_counts.token_counts(d, WORDS),
    "files": lambda d: token_files.token_file_digests(d, WORDS, 2, by_word=True), "whole": lambda d: token_files.token_file_digests(d, WORDS, 2, dtype="<u4"), "pieces": lambda d: sentence_pieces.piece_digests(d, PIECES),
    "jaccard": lambda d: jaccard_join.jaccard_components(d, 4, 85, 100), "suffix": lambda d: suffix_dedup.suffix_dedup(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_for_each_row(docs, none, name):
    out = OPERATORS[name](docs)
    ids = sorted((r.doc_id for r in out.select("doc_id").collect()), key=str)
    assert ids == sorted((r[0] for r in ROWS), key=str)
    empty = OPERATORS[name](none)
    assert empty.columns == out.columns and empty.count() == 0


@pytest.mark.parametrize("name", ["quality", "toxic"])
def test_classifiers_on_odd_tables(spark, docs, none, name):
    for labels in ([], [(1, 1, 1)], [(1, None, 1), (None, 1, 0), (5, 0, 0), (5, 0, 0), (6, 1, 1), (7, 0, 1), (4, 1, 0)]):
        rows = fitted(spark, name, docs, spark.createDataFrame(labels, LABELS)).collect()
        assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
        assert {r.held_out for r in rows if r.doc_id is None} == {False}
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    assert fitted(spark, name, none, spark.createDataFrame([], LABELS)).count() == 0


def by_id(df):
    return {r.doc_id: r for r in df.filter("doc_id is not null").collect()}


def test_values_of_odd_rows(docs):
    rules = by_id(OPERATORS["rules"](docs))
    assert (rules[2].n_words, rules[2].base_failed, rules[2].kept) == (0, True, False) and rules[5].n_words == 20_000
    counts = by_id(OPERATORS["counts"](docs))
    assert (counts[3].n_tokens, counts[3].n_bytes, counts[4].n_tokens) == (0, 0, 0) and counts[5].over_limit
    files = by_id(OPERATORS["files"](docs))
    assert files[2].n_tokens == files[3].n_tokens == 1
    pieces = by_id(OPERATORS["pieces"](docs))
    assert pieces[3].n_tokens == 2 and pieces[3].decoded_sha256 == hashlib.sha256(b"").hexdigest()
    joined = by_id(OPERATORS["jaccard"](docs))
    assert joined[6].component_id == 5 and joined[2].n_shingles == 0 and joined[2].component_id == 2
    cut = by_id(OPERATORS["suffix"](docs))
    assert cut[6].n_removed == cut[6].n_bytes == len(LONG) and cut[7].n_removed == 5000 and cut[1].n_removed == 0 and cut[3].n_bytes == 0
    mixed = by_id(OPERATORS["mix"](docs))
    assert mixed[2].size == 0 and mixed[2].taken == 0 and all(r.taken <= 3 * r.size for r in mixed.values())


def test_vectors_that_are_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 1), (3, [1.0, 0.0], 1), (4, [1.0, 0.0], 2), (5, None, 1), (6, [0.0, 0.0], 1), (7, [nan, 1.0], 1),
        (8, [inf, 1.0], 1), (9, [1.0, None], 1), (10, [1.0, 0.0], None), (None, [1.0, 0.0], 1), (11, [1.0], 1), (12, [], 1), (13, [1e200, 0.0], 1),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("grp", F.lit(1)).withColumn("rep", F.lit("x"))
    out = embedding_dedup.near_duplicates(df).collect()
    assert len(out) == len(rows)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out if r.vec_id is not None}
    assert {i: got[i][1] for i in (1, 2, 3, 13)} == {1: 1, 2: 1, 3: 1, 13: 1} and got[1][0] == 4 and got[13][0] == 4
    assert all(got[i] == (0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11, 12))
    assert [(r.n_links, r.component_id, r.kept) for r in out if r.vec_id is None] == [(0, None, True)]
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embedding_recall_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(3000, 24))
    base[1000:1600] = base[0] + rng.normal(size=(600, 24)) * 0.22  # a group around the threshold
    base[2000:2300] = base[1700:2000] + rng.normal(size=(300, 24)) * 0.3
    labels = rng.integers(0, 2, 3000)
    unit = base / np.linalg.norm(base, axis=1)[:, None]
    near = (unit @ unit.T >= 0.93) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    df = spark.createDataFrame([(i, base[i].tolist(), int(labels[i])) for i in range(3000)], "vec_id long, embedding array<double>, label int")
    links = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df).collect()}
    found = np.array([links[i] for i in range(3000)])
    assert (found <= near.sum(1)).all() and found.sum() >= 0.97 * near.sum()


def test_token_files_are_read_by_ranges_off_a_mounted_folder(monkeypatch, tmp_path):
    from pyarrow import fs

    (tmp_path / "x.ids").write_bytes(np.arange(1000, dtype="<u2").tobytes())
    (tmp_path / "none.ids").write_bytes(b"")
    far = fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem())  # not a plain local one
    for files, root in ((far, ""), (fs.LocalFileSystem(), f"{tmp_path}/")):
        numbers = token_files.Numbers(files, f"{root}x.ids", "<u2")
        assert len(numbers) == 1000 and numbers.take(10, 13).tolist() == [10, 11, 12] and not len(numbers.take(5, 5))
        assert len(token_files.Numbers(files, f"{root}none.ids", "<u2")) == 0
    monkeypatch.setattr(token_files, "READ_TOKENS", 10)
    ends = np.array([3, 3, 9, 40, 41, 55])
    assert list(token_files._runs(ends, 0)) == [(0, 3), (3, 4), (4, 5), (5, 6)] and list(token_files._runs(ends[:0], 0)) == []
