"""Phrase collocations by SON partitioning: shards mined completely at lowered support, candidates counted globally.

1. Every input partition is read as shards of at most SHARD_WORDS words of a language. A phrase that occurs support times
   in all occurs in some shard at least in proportion to the shard's share of the language's bytes, so each shard is mined
   completely at that lowered support. It hands back counts by the phrases' bits in a filter.
2. A phrase that a shard leaves out occurs there less often than the shard's support. The counts handed back plus these
   limits bound every phrase from above; what cannot reach the support is no candidate. The filter of the candidates
   is all that travels to the tasks: phrases with equal bits add up, so it lets too much through, never too little.
   On a large corpus the lowered support falls to 1, so lengths are mined in steps (STEPS), and a step takes up only phrases
   whose parts the filter of the steps before lets through: the parts of a frequent phrase are frequent themselves.
3. Every shard counts the phrases that pass the filter by their words, and the sums are exact. Parts of a frequent phrase
   are frequent themselves, so the counts that the cuts need are among them.
4. Scores, covering and ranks are joins of the frequent phrases. Products are decimals of 38 digits.

Texts are lower-cased in A-Z, split into pieces at marks and line ends and into words at blanks and tabs; a word longer
than that is still one word. Null text: no words. Null lang: ``und``. Repeated rows and ids count as often as they stand
there; doc_id and other columns are not read. An empty table gives no rows. Very long texts are taken a few MB at a time,
at the ends of pieces. Ties of score and count go by the phrase's bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import files
from ..sources.scratch import scratch_dir
from .common import materialize, shuffle_partitions

SUPPORT = 100
LONGEST = 5
TOP = 2000
COVERED_PERCENT = 100
SHARD_WORDS = 4_000_000
SHARD_VOCABULARY = 1_000_000
BLOCK_PLACES = 500_000
BUCKETS = 256  # counts travel as arrays, a row for each bucket of phrases of a shard
CHUNK_BYTES = 4_000_000
FILTER_BITS = 1 << 26  # at least; a bit for 32 words
STEPS = ((1, 2), (3, 3), (4, None))  # lengths that are mined at once
GIVEN = 200_000  # phrases or places in a frame that leaves a task
ARRAY_ROWS = 50  # rows in an Arrow batch where a row holds a bucket of a shard
PARTS = 64  # of a language's phrases, each of which is cut to the top first

_BREAK = 0xFF  # no byte of UTF-8
_TABLE = bytes(_BREAK if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_M = np.uint64(0x9E3779B97F4A7C15)


def pieces_of(raw: bytes, chunk: int = CHUNK_BYTES) -> Iterator[tuple[list[bytes], int]]:
    """Words, with a lone 0xFF where a piece ends, and the bytes that they take: some MB at a time, up to the end of a piece."""
    raw = raw.translate(_TABLE)
    at = 0
    while at < len(raw):
        end = len(raw) if len(raw) - at <= chunk else raw.find(b"\xff", at + chunk) + 1 or len(raw)
        yield raw[at:end].replace(b"\xff", b" \xff ").split(), end - at
        at = end


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a * _M + b) * np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> np.uint64(31))


def filter_place(hashes: np.ndarray, n_bits: int) -> np.ndarray:
    """n_bits: a power of two."""
    return (hashes & np.uint64(n_bits - 1)).astype("int32")


class Shard:
    """Words of one language, numbered as they come; number 0 ends a piece."""

    def __init__(self):
        self.number: dict[bytes, int] = {b"\xff": 0}
        self.parts: list[np.ndarray] = []
        self.names: list[bytes] = []
        self.n, self.n_bytes = 0, 0

    def add(self, words: list[bytes], n_bytes: int) -> None:
        """Whole pieces."""
        number = self.number
        self.parts.append(np.fromiter((number.setdefault(w, len(number)) for w in words), "int32", len(words)))
        self.parts.append(np.zeros(1, "int32"))
        self.n += len(words)
        self.n_bytes += n_bytes

    def _numbered(self) -> tuple[np.ndarray, np.ndarray]:
        """The words' numbers in order, and the hash of each distinct word."""
        import xxhash

        self.ids = np.concatenate([*self.parts, np.zeros(1, "int32")])
        self.parts = []
        return self.ids, np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.number), "uint64", len(self.number))

    def mined(self, shortest: int, longest: int, least: int, passes: Callable[[np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Hashes and counts of the phrases of each length from shortest on that occur least times; passes(hashes) says which shorter ones go on.

        A phrase is counted only where its first and its last words but one were kept. Equal hashes are counted as one phrase.
        """
        ids, word_hash = self._numbered()
        at = np.flatnonzero(ids).astype("int32")
        hashes = mixed(np.ones(len(word_hash), "uint64"), word_hash)[ids[at]]
        for length in range(1, longest + 1):
            if length > 1:
                nexts = np.flatnonzero(at[1:] == at[:-1] + 1)
                at = at[nexts]
                hashes = mixed(hashes[nexts], word_hash[ids[at + (length - 1)]])
                del nexts
            if length < shortest:
                stays = passes(hashes)
            else:
                found, counts = np.unique(hashes, return_counts=True)
                found, counts = found[counts >= least], counts[counts >= least].astype("int32")
                yield found, counts
                if length == longest or not len(found):
                    return
                if least == 1:
                    continue
                stays = found[np.minimum(np.searchsorted(found, hashes), len(found) - 1)] == hashes
                del found, counts
            at, hashes = at[stays], hashes[stays]

    def phrases(self, longest: int, keep: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """length, hashes, counts and a place of the kept phrases of each length.

        keep(hashes, counts) says which go on. A phrase is counted only where its first and its last words but one were
        kept. Counting compares words, in blocks of phrases that begin alike; hashes are names for other shards.
        """
        ids, word_hash = self._numbered()
        v = len(self.number)
        counts = np.bincount(ids, minlength=v)
        hashes = mixed(np.ones(v, "uint64"), word_hash)
        kept = keep(hashes, counts) & (counts > 0)
        kept[0] = False
        place = np.zeros(v, "int32")
        place[ids[::-1]] = np.arange(len(ids) - 1, -1, -1, dtype="int32")
        yield 1, hashes[kept], counts[kept], place[kept]
        before = hashes[kept]
        at = np.flatnonzero(kept[ids]).astype("int32")
        rank = (np.cumsum(kept, dtype="int32") - 1)[ids[at]]
        for length in range(2, longest + 1):
            nexts = np.flatnonzero(at[1:] == at[:-1] + 1)
            at, rank = at[nexts], rank[nexts]
            after = ids[at + (length - 1)]  # never 0: the phrase that starts one word on ends there
            blocks = 1 + len(at) // BLOCK_PLACES
            fresh = np.full(len(at), -1, "int32")
            found, n = [], 0
            for b in range(blocks):
                own = np.flatnonzero(rank % blocks == b)
                values, first, which, counts = np.unique(rank[own] * np.int64(v) + after[own], return_index=True, return_inverse=True, return_counts=True)
                hashes = mixed(before[values // v], word_hash[values % v])
                kept = keep(hashes, counts)
                fresh[own] = np.where(kept, n + np.cumsum(kept) - 1, -1)[which]
                found.append((hashes[kept], counts[kept], at[own[first[kept]]]))
                n += int(kept.sum())
            before, counts, place = (np.concatenate(x) for x in zip(*found))
            yield length, before, counts, place
            stays = fresh >= 0
            at, rank = at[stays], fresh[stays]

    def words_at(self, places: np.ndarray, length: int) -> list[str]:
        names = self.names = self.names or list(self.number)
        grid = self.ids[places[:, None] + np.arange(length)]
        return [b" ".join([names[i] for i in row]).decode() for row in grid.tolist()]


def shards(batches: Iterator[pd.DataFrame], give: Callable[[str, Shard], Iterator[pd.DataFrame]], shard_words: int) -> Iterator[pd.DataFrame]:
    """One Shard a language is open at a time; together they stay below a shard's limits."""
    own: dict[str, Shard] = {}
    n_words = n_names = 0
    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            for words, n_bytes in pieces_of(text.encode()):
                shard = own.setdefault(lang, Shard())
                names = len(shard.number)
                shard.add(words, n_bytes)
                n_words, n_names = n_words + len(words), n_names + len(shard.number) - names
                if n_words >= shard_words or n_names >= SHARD_VOCABULARY:
                    largest = max(own, key=lambda x: own[x].n)
                    shard = own.pop(largest)
                    n_words, n_names = n_words - shard.n, n_names - len(shard.number) + 1
                    yield from give(largest, shard)
                    del shard
    for lang in list(own):
        yield from give(lang, own.pop(lang))


def _texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(docs[lang].cast("string"), F.lit("und")).alias("lang"), F.coalesce(docs[text], F.lit("")).alias("text"))


def _by_key(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, Iterator]]:
    """Rows of a partition sorted by keys, as groups."""
    rows = (row for batch in batches for row in batch.itertuples(index=False))
    for key, own in groupby(rows, lambda row: tuple(getattr(row, k) for k in keys)):
        yield key, own


@contextmanager
def batch_rows(spark: SparkSession, n: int):
    """Arrow batches of n rows for what runs within."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, n)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _runs(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Neighbouring rows that hold about GIVEN in all."""
    if len(sizes):
        cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - 1) // GIVEN)) + 1
        yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(sizes)])


def candidate_filter(mined: DataFrame, support: int, n_bits: int) -> bytes:
    """The bits of all phrases that can reach the support; n_bits / 8 bytes come to the driver."""
    spare = {r.lang: r.spare for r in mined.filter("bucket < 0").groupBy("lang").agg(F.sum(F.get("gains", F.lit(0)).cast("long")).alias("spare")).collect()}
    span = max(8, n_bits // BUCKETS)

    def bits(batches):
        for (bucket,), rows in _by_key(batches, ["bucket"]):
            able = np.zeros(span, bool)
            for lang, own in groupby(rows, lambda row: row.lang):
                total = np.zeros(span, "int64")
                for row in own:
                    total[np.cumsum(row.steps)] += np.asarray(row.gains)  # places are distinct within a row
                able |= (total > 0) & (total + spare[lang] >= support)
            yield pd.DataFrame({"bucket": [bucket], "bits": [np.packbits(able, bitorder="little").tobytes()]})

    dealt = mined.filter("bucket >= 0").repartition(min(BUCKETS, shuffle_partitions(mined.sparkSession)), "bucket").sortWithinPartitions("bucket", "lang")
    out = bytearray(max(n_bits, 8) // 8)
    with batch_rows(mined.sparkSession, ARRAY_ROWS):
        for r in dealt.mapInPandas(bits, "bucket int, bits binary").collect():
            out[r.bucket * span // 8 : (r.bucket + 1) * span // 8] = r.bits
    return bytes(out)


def phrase_counts(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, text: str = "text", lang: str = "lang", shard_words: int = SHARD_WORDS, filter_bits: int | None = None) -> DataFrame:
    """lang, phrase, size (words), f: every phrase of 1 to longest words with f >= support; and a row per lang with null phrase, size 0 and f the number of words."""
    spark, texts = docs.sparkSession, _texts(docs, text, lang)
    shares = {r.lang: max(1, r.n) for r in texts.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    n_words = sum(shares.values()) // 5  # words of four letters and a blank
    texts = texts.coalesce(max(1, -(-n_words // shard_words)))  # fewer, larger shards lower the support less
    n_bits = filter_bits or max(FILTER_BITS, 1 << (n_words // 32).bit_length())

    def passing(bits):
        own = np.frombuffer(bits.value, "u1")

        def passes(hashes, _=None):
            place = filter_place(hashes, n_bits)
            return (own[place >> 3] >> (place & 7).astype("u1")) & np.uint8(1) == 1

        return passes

    def mining(first, last, bits):
        def mine(batches):
            passes = bits and passing(bits)

            def give(name, shard):
                least = max(1, -(-support * shard.n_bytes // shares[name]))
                yield pd.DataFrame({"lang": name, "bucket": [-1], "steps": [[0]], "gains": [[least - 1]]})
                found = [(filter_place(h, n_bits), c - np.int32(least - 1)) for h, c in shard.mined(first, last, least, passes)]
                place, gain = (np.concatenate(x) for x in zip(*found))
                del found
                if not len(place):
                    return
                order = np.argsort(place)
                place, gain = place[order], gain[order]
                heads = np.flatnonzero(np.diff(place, prepend=-1))
                place, gain = place[heads], np.add.reduceat(gain, heads)
                span = max(8, n_bits // BUCKETS)
                bucket, starts = np.unique(place // span, return_index=True)
                steps = np.diff(place, prepend=0)
                steps[starts] = place[starts] - bucket * span  # from the bucket's begin, then from place to place
                ends = np.r_[starts[1:], len(place)]
                for a, b in _runs(ends - starts):
                    rows = {c: [x[i:j] for i, j in zip(starts[a:b], ends[a:b])] for c, x in (("steps", steps), ("gains", gain))}
                    yield pd.DataFrame({"lang": name, "bucket": bucket[a:b]} | rows)

            return shards(batches, give, shard_words)

        return mine

    known, bits = bytes(n_bits // 8), None
    for first, last in STEPS:
        last = min(last or longest, longest)
        if first > last:
            break
        place = scratch_dir(spark, "collocation-shards")
        rows = "lang string, bucket int, steps array<int>, gains array<int>"
        texts.mapInPandas(mining(first, last, bits), rows).write.parquet(place)
        fresh = candidate_filter(spark.read.schema(rows).parquet(place), support, n_bits)
        files.delete(spark, place)
        if bits:
            bits.destroy()
        known = (np.frombuffer(known, "u1") | np.frombuffer(fresh, "u1")).tobytes()
        bits = spark.sparkContext.broadcast(known)

    def count(batches):
        passes = passing(bits)

        def give(name, shard):
            for length, hashes, counts, at in shard.phrases(longest, passes):
                bucket = (hashes >> np.uint64(40)).astype("int64") % BUCKETS
                order = np.argsort(bucket, kind="stable")
                own, starts = np.unique(bucket[order], return_index=True)
                ends = np.r_[starts[1:], len(order)]
                for a, b in _runs(ends - starts):
                    part = order[starts[a] : ends[b - 1]]
                    phrases, inner = np.array(shard.words_at(at[part], length), dtype=object), starts[a + 1 : b] - starts[a]
                    yield pd.DataFrame({"lang": name, "bucket": own[a:b], "phrases": np.split(phrases, inner), "counts": np.split(counts[part], inner)})
            yield pd.DataFrame({"lang": name, "bucket": [-1], "phrases": [[""]], "counts": [[int(np.count_nonzero(shard.ids))]]})

        return shards(batches, give, shard_words)

    def add(batches):
        for (name, bucket), rows in _by_key(batches, ["lang", "bucket"]):
            total: dict[str, int] = {}
            for row in rows:
                for phrase, f in zip(row.phrases, row.counts):
                    total[phrase] = total.get(phrase, 0) + int(f)
            found = [(name, None, 0, total[""])] if bucket < 0 else [(name, p, p.count(" ") + 1, f) for p, f in total.items() if f >= support]
            yield pd.DataFrame(found, columns=["lang", "phrase", "size", "f"])

    counted = texts.mapInPandas(count, "lang string, bucket int, phrases array<string>, counts array<long>")
    dealt = counted.repartition(shuffle_partitions(spark), "lang", "bucket").sortWithinPartitions("lang", "bucket")
    with batch_rows(spark, ARRAY_ROWS):
        counted = materialize(dealt.mapInPandas(add, "lang string, phrase string, size int, f long"), "collocation-counts")
    bits.destroy()
    return counted


def collocations(
    docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, top: int = TOP, covered_percent: int = COVERED_PERCENT, text: str = "text", lang: str = "lang", **sizes: int
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 to longest words. sizes: shard_words and filter_bits of phrase_counts.

    score = floor(1000 * a * n / (l * r)) at the cut where that is least (the first of equal ones). A phrase that lies
    within a longer one with covered_percent of its occurrences is left out.
    """
    known = phrase_counts(docs, support, longest, text, lang, **sizes)
    totals = known.filter("size = 0").select("lang", F.col("f").alias("n"))
    parts = known.filter("size > 0").select("lang", F.col("phrase").alias("part"), F.col("f").alias("part_f"))
    found = known.filter("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    # f falls with every word that is added, so a phrase that is covered at all is covered by one that is one word longer
    inner = F.explode(F.array(F.slice("w", F.lit(1), F.col("size") - 1), F.slice("w", F.lit(2), F.col("size") - 1)))
    longer = found.filter("size > 2").select("lang", "a", inner.alias("p")).groupBy("lang", F.concat_ws(" ", "p").alias("phrase")).agg(F.max("a").alias("longer"))
    left = found.join(longer, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("longer") < covered_percent * F.col("a"), F.lit(True)))
    cuts = left.select("lang", "phrase", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.concat_ws(" ", F.slice("w", F.lit(1), F.col("k"))).alias("head"), F.concat_ws(" ", F.slice("w", F.col("k") + 1, F.col("size") - F.col("k"))).alias("tail"))
    heads = parts.select("lang", F.col("part").alias("head"), F.col("part_f").alias("l"))
    tails = parts.select("lang", F.col("part").alias("tail"), F.col("part_f").alias("r"))
    met = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(totals, "lang")
    exact = F.expr("(cast(a as decimal(19,0)) * cast(n as decimal(15,0)) * 1000BD) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = met.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(exact.alias("score"), "k", "l", "r")).alias("cut"))
    best = best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    first = best.withColumn("part", part).withColumn("nth", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("nth") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
