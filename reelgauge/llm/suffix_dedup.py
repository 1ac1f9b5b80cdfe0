"""Suffix-array dedup: remove every byte covered by a 200-byte string that starts anywhere else too.

Finding equal strings needs them in one place. Each 200-byte window is dealt out by its anchor, the
least 64-byte hash in it: equal windows have equal anchors at equal places, and the windows of a text that
share an anchor are one segment (the windows' starts, and LENGTH - 1 bytes more). So

1. every document gives its segments' anchors and digests, without their bytes;
2. an anchor that occurs once holds no repeat; one whose segments are all equal is all repeat, and so is
   any segment that has an equal one. Only where different segments share an anchor are bytes
   fetched, one copy of each;
3. these segments go by anchor into shards of a bounded size. A shard is sorted into a suffix array by
   Larsson-Sadakane refinement (ranks of doubled length, only unsorted groups again), with common
   prefixes by Kasai's walk. An anchor with too many segments for a shard is dealt into several; each
   pair of these is merged by binary search of the windows of one in the suffix array of the other;
4. the repeated windows of a document are joined into maximal runs and cut out.

Windows never cross documents. Null text: empty. Rows that share a doc_id are kept apart by text:
each is cut by its own matches, and equal rows repeat each other. A null doc_id works like any other. One
row for each row in, none for an empty table; extra columns are ignored. A very long text is anchored whole, at about fifty times its bytes
in memory; its segments go to shards of a bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, free_names, materialize, shuffle_partitions

LENGTH = 200
GRAM = 64
SHARD_BYTES = 500_000  # a suffix array of this size takes about a hundred times as much memory
_M = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(raw: bytes, k: int = GRAM) -> np.ndarray:
    """A hash of the k bytes (a power of two, 8 or more) from each position, by doubling."""
    a = np.frombuffer(raw, "u1")
    h = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(a, 8)).view("<u8").ravel() * _M
    h ^= h >> np.uint64(29)
    size = 8
    while size < k:
        h = (h[:-size] * _M + h[size:]) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(32)
        size *= 2
    return h


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """Least of each w consecutive values: from running minima of blocks, forwards and backwards."""
    blocks = -(-len(h) // w)
    padded = np.full(blocks * w, np.iinfo("uint64").max, "uint64")
    padded[: len(h)] = h
    grid = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    n = len(h) - w + 1
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def anchored_segments(raw: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """anchor, first window and number of windows of each segment.

    Hashes compare by their upper half and then by position: the leftmost of the least. So a segment holds one
    place of its anchor, and two equal windows of a text lie in different segments.
    """
    n = len(raw) - length + 1
    if n <= 0:
        return np.empty(0, "uint64"), np.empty(0, "int64"), np.empty(0, "int64")
    h = gram_hashes(raw)
    half = np.uint64(0xFFFFFFFF)
    place = window_minima((h & ~half) | np.arange(len(h), dtype="uint64"), length - GRAM + 1) & half
    starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    return h[place[starts].astype("int64")], starts, np.diff(np.r_[starts, n])


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of text (uint8) sorted by the suffix.

    Larsson-Sadakane: after sorting by 8 bytes every suffix has the number of its group; groups
    that are still mixed are sorted by the group number 8, 16, 32 ... bytes on.
    """
    n = len(text)
    padded = np.zeros(n + 8, "u1")
    padded[:n] = text
    if not n:
        return np.empty(0, "int64")
    key = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[:n]).view(">u8").ravel().astype("<u8")
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    size = 8
    while True:
        first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank = np.empty(n, "int64")
        rank[order] = first
        mixed = np.flatnonzero(~(new & np.r_[new[1:], True]))
        if not len(mixed):
            return order
        at = order[mixed]
        later = np.where(at + size < n, n + 1 + rank[np.minimum(at + size, n - 1)], n - at)  # what has ended comes first, the shortest before
        inner = np.argsort(first[mixed] * (2 * n + 2) + later, kind="stable")  # below 2^63 for shards under 2 GB
        order[mixed] = at[inner]
        group, after = first[mixed][inner], later[inner]
        new[mixed] = np.r_[True, (group[1:] != group[:-1]) | (after[1:] != after[:-1])]
        size *= 2


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int, lane: int = 256) -> np.ndarray:
    """lcp[i]: bytes (up to most) that suffix order[i] shares with order[i - 1]; lcp[0] = 0.

    Kasai's walk in text order: the prefix at position p + 1 is at least that at p less one. The
    text is cut into lanes that are walked side by side.
    """
    n = len(text)
    if not n:
        return np.empty(0, "int64")
    before = np.full(n, -1, "int64")
    before[order[1:]] = order[:-1]
    padded = np.zeros(n + 8, "u1")
    padded[:n] = text
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)).view("<u8").ravel()
    lanes = np.arange(0, n, lane)
    shared = np.zeros(len(lanes), "int64")
    out = np.zeros(n, "int64")
    for step in range(min(lane, n)):
        p = lanes + step
        p = p[p < n]  # only the last lane can be short
        q = before[p]
        length = np.where(q >= 0, np.maximum(shared[: len(p)] - 1, 0), 0)
        going = np.flatnonzero((q >= 0) & (length < most))
        while len(going):  # eight bytes at a time; the lowest set bit shows the first byte that differs
            differ = words[np.minimum(p[going] + length[going], n)] ^ words[np.minimum(q[going] + length[going], n)]
            low = differ & (~differ + np.uint64(1))
            same = np.where(differ == 0, 8, np.log2(np.maximum(low, np.uint64(1)).astype("float64")).astype("int64") // 8)
            length[going] += same
            going = going[(same == 8) & (length[going] < most)]
        shared = np.minimum(np.minimum(length, most), n - np.maximum(p, q))
        shared[q < 0] = 0
        out[p] = shared
    return out[order]


class Shard:
    """Segments laid end to end, with the windows' starts in suffix order.

    Only starts of whole windows are asked for, so a window never runs past its segment.
    """

    def __init__(self, segments: list[bytes], length: int = LENGTH):
        self.length = length
        self.text = np.frombuffer(b"".join(segments), "u1")
        sizes = np.array([len(s) for s in segments], "int64")
        ends = np.cumsum(sizes)
        self.first = ends - sizes
        self.windows = sizes - length + 1
        is_start = np.zeros(len(self.text) + 1, "int64")
        np.add.at(is_start, self.first, 1)
        np.add.at(is_start, self.first + np.maximum(self.windows, 0), -1)
        self.is_start = np.cumsum(is_start[:-1]) > 0
        self.order = suffix_array(self.text)
        self.lcp = common_prefixes(self.text, self.order, length)

    def repeated(self) -> np.ndarray:
        """Per text position: a window starts here that starts at another position too."""
        run = np.cumsum(self.lcp < self.length) - 1  # suffixes that share a whole window have one number
        starts = self.is_start[self.order]
        many = np.bincount(run[starts], minlength=int(run[-1]) + 1 if len(run) else 0) > 1
        out = np.zeros(len(self.text), bool)
        out[self.order[starts & many[run]]] = True
        return out

    def sorted_starts(self) -> np.ndarray:
        return self.order[self.is_start[self.order]]

    def found_in(self, other: "Shard") -> np.ndarray:
        """Per text position: a window starts here that starts in the other shard too, by binary search there."""
        out = np.zeros(len(self.text), bool)
        mine, theirs = self.sorted_starts(), other.sorted_starts()
        if not len(mine) or not len(theirs):
            return out
        lo, hi = np.zeros(len(mine), "int64"), np.full(len(mine), len(theirs), "int64")
        while (open_ := np.flatnonzero(lo < hi)).size:
            middle = (lo[open_] + hi[open_]) // 2
            less = other.less(theirs[middle], self, mine[open_])
            lo[open_[less]] = middle[less] + 1
            hi[open_[~less]] = middle[~less]
        inside = np.flatnonzero(lo < len(theirs))
        equal = ~other.less(theirs[lo[inside]], self, mine[inside]) & ~self.less(mine[inside], other, theirs[lo[inside]])
        out[mine[inside[equal]]] = True
        return out

    def less(self, at: np.ndarray, other: "Shard", there: np.ndarray) -> np.ndarray:
        """window(at) < other's window(there), element by element, 4096 at a time."""
        out = np.zeros(len(at), bool)
        for a in range(0, len(at), 4096):
            x = np.lib.stride_tricks.sliding_window_view(self.text, self.length)[at[a : a + 4096]]
            y = np.lib.stride_tricks.sliding_window_view(other.text, self.length)[there[a : a + 4096]]
            differ = x != y
            place = differ.argmax(1)
            rows = np.arange(len(x))
            out[a : a + 4096] = differ[rows, place] & (x[rows, place] < y[rows, place])
        return out


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.r_[0, flags.view("i1"), 0]))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


ROW_KEY = ["doc_id", "text_hash"]  # rows that share an id are told apart by their texts


SPREAD = 1024  # parts that the further copies of a segment are dealt to


def copies_within(anchors: np.ndarray, digests: np.ndarray) -> np.ndarray:
    """0 for a segment that is alone in its slice, -1 for the first of several equal ones, 1 to SPREAD for the others."""
    order = np.lexsort((digests, anchors))
    a, d = anchors[order], digests[order]
    starts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (d[1:] != d[:-1])]) if len(order) else np.empty(0, "int64")
    sizes = np.diff(np.r_[starts, len(order)])
    nth = np.arange(len(order)) - np.repeat(starts, sizes)
    out = np.empty(len(order), "int32")
    out[order] = np.where(np.repeat(sizes, sizes) == 1, 0, np.where(nth == 0, -1, 1 + nth % SPREAD))
    return out


def _anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each document's segments as arrays; flushed so that a batch of long texts stays small."""
    import xxhash

    def frame(rows):
        out = pd.DataFrame(rows, columns=[*ROW_KEY, "anchor", "digest", "start", "count"])
        parts = copies_within(np.concatenate(out["anchor"].tolist()), np.concatenate(out["digest"].tolist()))
        return out.assign(part=np.split(parts, np.cumsum([len(x) for x in out["anchor"]])[:-1]))

    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        rows, held = [], 0
        for i, h, t in zip(batch["doc_id"], batch["text_hash"], batch["text"]):
            raw = t.encode()
            anchors, starts, counts = anchored_segments(raw)
            if not len(starts):
                continue
            digests = np.fromiter((digest(raw[s : s + c + LENGTH - 1]) for s, c in zip(starts.tolist(), counts.tolist())), "uint64", len(starts))
            rows.append((i, h, anchors.view("int64"), digests.view("int64"), starts.astype("int32"), counts.astype("int32")))
            held += len(starts)
            if held > 200_000:
                yield frame(rows)
                rows, held = [], 0
        if rows:
            yield frame(rows)


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The wanted segments' bytes; of equal rows in a task the first gives them."""
    columns = ["anchor", "digest", "blocks", "segment"]
    given: set[tuple[int, int]] = set()
    for batch in batches:
        rows, size = [], 0
        for t, wanted in zip(batch["text"], batch["wanted"]):
            raw = t.encode()
            if len(given) > 200_000:
                given.clear()
            for w in wanted:
                if (w["anchor"], w["digest"]) in given:
                    continue
                given.add((w["anchor"], w["digest"]))
                segment = raw[w["start"] : w["start"] + w["count"] + LENGTH - 1]
                rows.append((w["anchor"], w["digest"], w["blocks"], segment))
                size += len(segment)
            if size > 8_000_000:
                yield pd.DataFrame(rows, columns=columns)
                rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=columns)


_REPEATS = "anchor long, digest long, offset int, count int"


def _found(shard: Shard, names: list[tuple], marked: np.ndarray) -> list[tuple]:
    """Marked windows as runs within each segment; names: anchor and digest of each segment."""
    return [(a, d, x, y - x) for (a, d), f, w in zip(names, shard.first.tolist(), shard.windows.tolist()) for x, y in _runs(marked[f : f + w])]


def _one_shard(rows: list[tuple]) -> list[tuple]:
    shard = Shard([r[-1] for r in rows])
    return _found(shard, [r[:2] for r in rows], shard.repeated())


def _two_shards(rows: list[tuple], x: int, y: int) -> list[tuple]:
    """What either block of an anchor has of the other."""
    sides = [[r for r in rows if r[2] == b] for b in (x, y)]
    if not all(sides):
        return []
    shards = [Shard([r[-1] for r in side]) for side in sides]
    return [f for i in (0, 1) for f in _found(shards[i], [r[:2] for r in sides[i]], shards[i].found_in(shards[1 - i]))]


def _shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Segments sorted by anchor, pair of blocks and digest, equal ones once: anchors of one block fill shards of about SHARD_BYTES, each pair of blocks of a larger anchor is solved by itself."""

    def solve(key, rows):
        found = _two_shards(rows, *key[1:]) if key is not None and key[1] != key[2] else _one_shard(rows)
        return pd.DataFrame(found, columns=["anchor", "digest", "offset", "count"])

    key, rows, size, last, before = None, [], 0, None, None
    for batch in batches:
        for anchor, digest, blocks, block, x, y, segment in zip(*(batch[c] for c in ("anchor", "digest", "blocks", "block", "x", "y", "segment"))):
            own = (anchor, x, y) if blocks > 1 else None
            if before == (before := (anchor, x, y, block, digest)):
                continue
            if rows and (own != key or (own is None and size > SHARD_BYTES and anchor != last)):
                yield solve(key, rows)
                rows, size = [], 0
            key, last = own, anchor
            rows.append((anchor, digest, block, segment))
            size += len(segment)
    if rows:
        yield solve(key, rows)


def _by_row(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_hash"] == b["text_hash"])


def repeated_runs(texts: DataFrame) -> DataFrame:
    """doc_id, text_hash, runs: array of (start, count) of repeated windows, for rows that have any. texts: doc_id, text_hash, text (not null)."""
    kind = texts.schema["doc_id"].dataType.simpleString()
    given = texts.mapInPandas(_anchors, f"doc_id {kind}, text_hash long, anchor array<long>, digest array<long>, start array<int>, count array<int>, part array<int>")
    cut = given.select(*ROW_KEY, F.explode(F.arrays_zip("anchor", "digest", "start", "count", "part")).alias("s")).select(*ROW_KEY, "s.*")
    order = ["doc_id", "text_hash", "start"]
    same_anchor = Window.partitionBy("anchor", "deal").orderBy("digest", *order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    same_segment = Window.partitionBy("anchor", "deal", "digest").orderBy(*order)
    first = (F.col("nth") == 1) & (F.col("deal") == 0)
    seen = (  # a segment with a copy in its slice is repeated whatever else there is: one of them stands for it, the others are dealt out
        cut.withColumn("deal", F.greatest("part", F.lit(0)))
        .withColumn("n", F.count(F.lit(1)).over(same_anchor))
        .withColumn("mixed", F.min("digest").over(same_anchor) != F.max("digest").over(same_anchor))
        .filter("n > 1 or part <> 0")
        .withColumn("nth", F.row_number().over(same_segment))
        .withColumn("twice", (F.col("part") != 0) | ~first | F.lead(F.lit(True), 1, False).over(same_segment))
        .select(*ROW_KEY, "anchor", "digest", "start", "count", "mixed", first.alias("first"), "twice")
    )
    seen = materialize(seen, "suffix-anchors")
    sure = seen.filter("twice").select(*ROW_KEY, "start", "count")
    shown = seen.filter("mixed and first")
    sizes = shown.groupBy("anchor").agg(F.ceil(F.sum(F.col("count") + LENGTH - 1) / SHARD_BYTES).cast("int").alias("blocks"))
    wanted = shown.join(sizes, "anchor").groupBy(*ROW_KEY).agg(F.collect_list(F.struct("anchor", "digest", "start", "count", "blocks")).alias("wanted"))
    segments = texts.join(wanted, _by_row(texts, wanted)).select("text", "wanted").mapInPandas(_extract, "anchor long, digest long, blocks int, segment binary")
    block = F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda o: F.struct(F.least(o, F.col("block")).cast("int").alias("x"), F.greatest(o, F.col("block")).cast("int").alias("y")),
    )
    dealt = segments.withColumn("block", block).select("*", F.explode(pairs).alias("p")).select("anchor", "digest", "blocks", "block", "p.x", "p.y", "segment")
    dealt = dealt.repartition(shuffle_partitions(texts.sparkSession), "anchor", "x", "y").sortWithinPartitions("anchor", "x", "y", "block", "digest")
    repeats = dealt.mapInPandas(_shards, _REPEATS)
    single = seen.filter("mixed and not twice").select(*ROW_KEY, "anchor", "digest", "start")
    partly = single.join(repeats, ["anchor", "digest"]).select(*ROW_KEY, (F.col("start") + F.col("offset")).alias("start"), repeats["count"].alias("count"))
    runs = sure.unionByName(partly).groupBy(*ROW_KEY, "start").agg(F.max("count").alias("count"))  # equal rows share theirs, so a list is no longer than a text
    return runs.groupBy(*ROW_KEY).agg(F.collect_list(F.struct("start", "count")).alias("runs"))


def removed_spans(n_bytes: int, runs) -> list[tuple[int, int]]:
    """Maximal byte ranges (start, end) that repeated windows cover."""
    edge = np.zeros(n_bytes + 1, "int64")
    for r in runs:
        edge[r["start"]] += 1
        edge[r["start"] + r["count"] + LENGTH - 1] -= 1
    return _runs(np.cumsum(edge[:-1]) > 0)


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    at = [0, *(p for span in spans for p in span), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(at[::2], at[1::2]))


def whole_characters(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans made smaller so that no UTF-8 character is cut in two."""
    out = []
    for a, b in spans:
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(raw) and raw[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def _with_runs(docs: DataFrame, text: str, doc_id: str) -> tuple[DataFrame, DataFrame]:
    """The texts with their row key, and the runs of repeats by that key."""
    texts = docs.select(docs[doc_id].alias("doc_id"), F.xxhash64(docs[text]).alias("text_hash"), F.coalesce(docs[text], F.lit("")).alias("text"))
    return texts, repeated_runs(texts)


def suffix_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (array of start and end in bytes)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, t, runs in zip(batch["doc_id"], batch["text"], batch["runs"]):
                raw = t.encode()
                spans = removed_spans(len(raw), runs) if runs is not None else []
                left = without(raw, spans)
                rows.append((i, len(raw), len(raw) - len(left), len(spans), hashlib.sha256(left).hexdigest(), [{"start": a, "end": b} for a, b in spans]))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    texts, runs = _with_runs(docs, text, doc_id)
    marked = texts.join(runs, _by_row(texts, runs), "left").select(texts["doc_id"], texts["text"], "runs")
    kind = texts.schema["doc_id"].dataType.simpleString()
    return marked.mapInPandas(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>")


def cut_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with the repeats cut out of their texts (whole characters only); rows of which nothing is left go."""

    @F.pandas_udf("string")
    def left(texts: pd.Series, runs: pd.Series) -> pd.Series:
        out = []
        for t, r in zip(texts, runs):
            if r is None:
                out.append(t)
                continue
            raw = t.encode()
            out.append(without(raw, whole_characters(raw, removed_spans(len(raw), r))).decode())
        return pd.Series(out, dtype=object)

    own_id, own_hash, own_runs, text_hash = free_names(docs, "runs_id", "runs_hash", "runs_here", "text_hash")
    _, runs = _with_runs(docs, text, doc_id)
    keyed = docs.withColumn(text_hash, F.xxhash64(docs[text]))
    runs = runs.select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_hash), F.col("runs").alias(own_runs))
    met = keyed.join(runs, keyed[doc_id].eqNullSafe(runs[own_id]) & (keyed[text_hash] == runs[own_hash]), "left")
    met = met.withColumn(text, F.when(F.col(own_runs).isNull(), F.col(text)).otherwise(left(F.coalesce(F.col(text), F.lit("")), F.col(own_runs))))
    kept = met.filter(F.col(own_runs).isNull() | (F.btrim(F.col(text), F.lit(BLANKS)) != ""))
    return kept.select(*docs.columns)
