"""The corpus pipeline against brute force, with repeated ids and rows, nulls, clashing names and an empty table; many equal rows."""

import collections
import hashlib
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from reelgauge.llm import jaccard_join, quality_classifier, source_mix, suffix_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHING = "score_here double, text_hash long, runs_id int, runs_hash int, runs_here string, its_id int, its_source int, its_size int, taken_in_all int, rows_alike int, n_copies int, nth_copy int, group_node int, repeated_id int, nth_equal int, several_texts int, node int, spans string, Size int"


def shingles(text, k=5):
    words = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in WORD.findall(text or "")]
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def kept_by_brute_force(rows):
    """Of (doc_id, text) the ones that stay: one of equal rows, and of each linked group the smallest id."""
    nodes = sorted({r for r in rows if r[0] is not None}, key=lambda r: (r[0], r[1] or ""))
    sets = [shingles(t) for _, t in nodes]
    up = list(range(len(nodes)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(nodes)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    groups = collections.defaultdict(list)
    for i, n in enumerate(nodes):
        groups[root(i)].append(n)
    return [{n for n in g if n[0] == g[0][0]} for g in groups.values()], [r for r in rows if r[0] is None]


def cut_by_brute_force(texts):
    where = collections.Counter()
    raws = [(t or "").encode() for t in texts]
    for raw in raws:
        where.update(raw[i : i + 200] for i in range(len(raw) - 199))
    out = []
    for raw, text in zip(raws, texts):
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - 199):
            if where[raw[i : i + 200]] > 1:
                gone[i : i + 200] = True
        spans = suffix_dedup.whole_characters(raw, suffix_dedup._runs(gone))
        left = suffix_dedup.without(raw, spans).decode()
        out.append((text if not spans else left) if not spans or left.strip(" \t\n\x0b\x0c\r") else False)
    return out


@pytest.fixture(scope="module")
def odd_docs(spark, sf_dir):
    """Some of the given documents, and rows that share ids, rows that are equal, nulls and an id that an equal text has elsewhere."""
    given = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]
    long = " ".join(f"plain{i} words of the text" for i in range(120))
    more = [
        (5, "another text that shares its id with a document of other words entirely " * 3, "en", "src1", 9), (5, long, "en", "src1", 9), (9000, long + " end", "en", "src2", 9), (7, given[7][1], "en", "src0", 1), (7, given[7][1], "en", "src0", 1),
        (None, long, "en", "src1", 9), (None, "no id and few words in it", None, None, None), (9001, None, "en", "src1", None), (9002, "", None, None, 0), (9003, "é" * 900, "fr", "", 900), (9003, "é" * 900, "fr", "", 900),
    ]
    return spark.createDataFrame(given + more, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)


def test_one_of_each_group_stays(spark, odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    groups, without_id = kept_by_brute_force(rows)
    got = collections.Counter((r.doc_id, r.text) for r in jaccard_join.keep_one_per_group(odd_docs).select("doc_id", "text").collect())
    for group in groups:
        assert sum(got.pop(n, 0) for n in group) == 1
    assert got == collections.Counter(without_id)


def test_stages_keep_columns_whatever_their_names(spark, odd_docs):
    clashing = odd_docs
    for field in CLASHING.split(", "):
        name, kind = field.split(" ")
        clashing = clashing.withColumn(name, F.lit(None).cast(kind))
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(200)], "doc_id long, quality int")
    model = quality_classifier.fit_quality(clashing, labels)
    for plain, stage in ((odd_docs, lambda d: quality_classifier.keep_good(d, model)), (odd_docs, jaccard_join.keep_one_per_group), (odd_docs, suffix_dedup.cut_repeats), (odd_docs, source_mix.take_mix)):
        out = stage(clashing)
        assert out.columns == clashing.columns
        assert out.count() == stage(plain).count()


def test_whole_pipeline_against_brute_force(spark, odd_docs, sf_dir, tmp_path):
    """Each decision that has a right answer is recomputed from what went in before it; scores and random roundings are taken as they are."""
    import sentencepiece

    folder = str(tmp_path)
    odd_docs.write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/{len(kept)}")
        docs = spark.read.parquet(f"{folder}/{len(kept)}")
        kept.append(docs)
    good, single, cut, mixed, pieces = ([r.asDict() for r in k.collect()] for k in kept)
    model = quality_classifier.fit_quality(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    texts = [(r.doc_id, r.text) for r in odd_docs.collect()]
    want = collections.Counter(t for t, s in zip(texts, model.score([t or "" for _, t in texts])) if s >= quality_classifier.KEEP_AT)
    assert collections.Counter((r["doc_id"], r["text"]) for r in good) == want
    groups, without_id = kept_by_brute_force([(r["doc_id"], r["text"]) for r in good])
    left = collections.Counter((r["doc_id"], r["text"]) for r in single)
    assert all(sum(left.pop(n, 0) for n in g) == 1 for g in groups) and left == collections.Counter(without_id)
    texts = cut_by_brute_force([r["text"] for r in single])
    assert collections.Counter((r["doc_id"], r["text"]) for r in cut) == collections.Counter((r["doc_id"], t) for r, t in zip(single, texts) if t is not False)
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in cut)
    size = lambda r: len(WORD.findall(r["text"] or ""))
    total, by_source = sum(map(size, cut)), collections.Counter()
    for r in cut:
        by_source[r["source"]] += size(r)
    taken = collections.Counter()
    for r in mixed:
        taken[r["source"]] += size(r)
    targets = {r.source: r.target for r in source_mix.mix_sources(kept[2]).select("source", "target").distinct().collect()}
    assert set(taken) <= set(by_source) and abs(sum(targets.values()) - min(total, 3 * total)) <= 1e-6 * total
    assert all(abs(taken[s] - targets[s]) <= max(size(r) for r in cut if r["source"] == s) for s in by_source)
    copies, had = collections.Counter((r["doc_id"], r["text"], r["source"]) for r in mixed), collections.Counter((r["doc_id"], r["text"], r["source"]) for r in cut)
    assert all(n <= 3 * had[key] for key, n in copies.items())
    machine = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(corpus_pipeline.PIECES))
    digests = collections.Counter()
    for r in mixed:
        ids = machine.encode(r["text"] or "", add_bos=True, add_eos=True)
        digests[(r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(machine.decode(ids).encode()).hexdigest())] += 1
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in pieces) == digests
    assert collections.Counter(map(lambda r: (r.doc_id, r.n_tokens, r.ids_sha256), corpus_pipeline.run(spark, folder).collect())) == collections.Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in pieces)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("same_id", [7, None])
def test_many_equal_rows_share_their_repeats(spark, same_id):
    text = " ".join(f"w{i * i % 977}x" for i in range(700))
    docs = spark.range(0, 2000, 1, 4).select(F.lit(same_id).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(8, text[:1000] + "other"), (9, "lone text")], "doc_id long, text string"))
    got = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans): r["count"] for r in suffix_dedup.suffix_dedup(docs).groupBy("doc_id", "n_bytes", "n_removed", "n_spans").count().collect()}
    assert got == {(same_id, len(text), len(text), 1): 2000, (8, 1005, 1000, 1): 1, (9, 9, 0, 0): 1}
