"""N-gram Jaccard join: exact components of documents whose shingle sets overlap enough.

Local search is T-occurrence by DivideSkip: of a query's inverted lists the longest ones are set
aside, the short ones are heap-merged, and the documents that occur often enough in those are looked up in
the long lists by binary probes until the required overlap is reached or missed.

To search locally, linked documents must meet in a task. Two sets that link differ in at most
(1 - t) / (1 + t) * (|x| + |y|) shingles, so cut by hash into m segments they agree in all but so many at least. Every set
emits 64-bit signatures of its segments (for its size class, and the next one where a larger partner could lie
there): of one more than it can differ in from any partner, those that hold the most shingles. That order follows from what
the segments hold, so of those in which two sets agree both emit the last one, and no link is lost. Sets that share a
signature are searched together, in a group with the smallest id among them. Segments of no or one shingle, which texts
that merely share a passage often have in common, are mostly left out so. Some such texts still share a signature, so before any text is fetched
the groups are sifted by sketches: counts of a set's hashes in a few cells, which show how many
shingles two sets differ in at least. What could link under that bound stays together; the rest goes.

Groups are dealt into blocks of about BLOCK documents (SIFT_BLOCK sketches), and each pair of blocks is one task: a
large group spreads over many tasks. A task returns a spanning forest of its links, never all
pairs: documents that it has already connected are not compared again. Equal sets are edges to
their smallest id, which alone stands for them in the groups. Sets are held as sorted 64-bit hashes of shingles. Connected components join the parts.

Null, empty and blank texts: empty set, linked with nothing. Rows that share a doc_id are one
node (their links add up), each with its own n_shingles. A null doc_id links with nothing and its
component_id is null. One row for each row in, none for an empty table; extra columns are ignored. A text of any length
is taken whole, at about twenty times its bytes in memory.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, if_small, materialize, shuffle_partitions
from .components import connected_components
from .units import BLANK, CAPITAL, CLASSES, Texts, cut_units, text_slices

BLOCK = 1000  # texts
SIFT_BLOCK = 16_000  # sketches, of a few hundred bytes each
RATIO = 1.6  # of the size classes, at least
MERGE_BY_HEAP = 4096  # list entries; beyond, the same merge is done by one sort
MU = 0.0085  # DivideSkip's cost ratio of a probe to a merge step

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: Texts, k: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its k-word shingles; of the whole sequence if that is shorter.

    Each distinct word of the slice is hashed once. Only A-Z are made small.
    """
    import xxhash

    data, offsets = texts
    flags = CLASSES[data]
    blank = (flags & BLANK) != 0
    begins = blank.copy()
    begins[1:] &= ~blank[:-1]
    units = cut_units(data + ((flags & CAPITAL) != 0).astype("u1") * np.uint8(32), offsets, begins)
    words = [u.lstrip() for u in units.distinct]
    digest = xxhash.xxh3_64_intdigest
    full = np.fromiter(map(len, words), "int64", len(words))[units.codes] > 0
    h = np.fromiter(map(digest, words), "uint64", len(words))[units.codes[full]]
    first = np.r_[0, np.cumsum(full)][units.first].tolist()
    rolled = np.full(max(0, len(h) - k + 1), k, "uint64")
    for i in range(k):
        rolled = mix(rolled + h[i : i + len(rolled)])
    out = []
    for a, b in zip(first[:-1], first[1:]):
        n = b - a
        if n >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
            continue
        whole = np.full(min(n, 1), n, "uint64")
        for i in range(a, b):
            whole = mix(whole + h[i])
        out.append(whole)
    return out


class SizeClasses:
    """Size classes for links at num / den, with as many segments as sets of the class can differ in, and two."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.ratio = max(RATIO, 1.01 * den / num)  # partners lie in the same or the next class
        self.bounds = [1, 2]

    def reach(self, size: int) -> None:
        while self.bounds[-1] <= size:
            self.bounds.append(max(self.bounds[-1] + 1, -int(-self.bounds[-1] * self.ratio // 1)))

    def differ(self, a: int, b: int) -> int:
        """Shingles that linked sets of these sizes can differ in."""
        return (a + b) * (self.den - self.num) // (self.den + self.num)

    def of(self, size: int) -> list[int]:
        self.reach(2 * size + 2)
        c = int(np.searchsorted(self.bounds, size, "right")) - 1
        return [c, c + 1] if size * self.den >= self.bounds[c + 1] * self.num else [c]

    def signatures(self, hashes: np.ndarray) -> np.ndarray:
        out = []
        n = len(hashes)
        for c in self.of(n):
            largest = self.bounds[c + 1] - 1
            most = self.differ(n, min(n * self.den // self.num, largest))
            if not most:
                continue  # only equal sets can link in this class
            m = self.differ(largest, largest) + 2
            segment = ((hashes >> np.uint64(20)) % np.uint64(m)).astype("int64")
            order = np.argsort(segment, kind="stable")
            own, starts = np.unique(segment[order], return_index=True)
            sums = np.zeros(m, "uint64")
            sums[own] = np.add.reduceat(mix(hashes[order] + _M2), starts)
            signed = mix(sums + mix(np.arange(m, dtype="uint64") + np.uint64(c << 40)))
            out.append(signed[np.lexsort((signed, np.bincount(segment, minlength=m)))[-most - 1 :]])
        return np.concatenate(out) if out else np.empty(0, "uint64")

    def sketches(self, hashes: np.ndarray) -> list[dict]:
        """Per class of the set: how many of its hashes fall into each of the class's cells (255 at most)."""
        out = []
        for c in self.of(len(hashes)):
            cells = 16 if self.bounds[c + 1] <= 64 else 1 << (int(self.bounds[c + 1] - 1).bit_length() - 2)
            counts = np.bincount((hashes >> np.uint64(44)).astype("int64") & (cells - 1), minlength=cells)
            out.append({"cls": c, "cells": np.minimum(counts, 255).astype("u1").tobytes()})
        return out


def _linked(both: int, a: int, b: int, num: int, den: int) -> bool:
    return den * both >= num * (a + b - both)


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i


def occurrences(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Documents in the sorted lists and how many lists each is in."""
    total = sum(map(len, lists))
    if not total:
        return np.empty(0, "int64"), np.empty(0, "int64")
    if total <= MERGE_BY_HEAP:
        merged = [(d, sum(1 for _ in run)) for d, run in groupby(heapq.merge(*(x.tolist() for x in lists)))]
        return np.array([d for d, _ in merged]), np.array([c for _, c in merged])
    return np.unique(np.concatenate(lists), return_counts=True)


def divide_skip_links(sets: list[np.ndarray], index: list[int], queries: list[int], num: int, den: int, forest: Forest | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links between queries and indexed documents (positions in sets).

    Where index and queries are the same documents, each pair is looked at once.
    """
    forest = forest or Forest(len(sets))
    same = index is queries or index == queries
    place = np.array(index, "int64")
    sizes = np.array([len(s) for s in sets], "int64")
    tokens = np.concatenate([sets[i] for i in index]) if index else np.empty(0, "uint64")
    owners = np.repeat(np.arange(len(index)), sizes[place]) if len(place) else np.empty(0, "int64")
    order = np.lexsort((owners, tokens))
    tokens, owners = tokens[order], owners[order]
    heads, starts = np.unique(tokens, return_index=True)
    ends = np.r_[starts[1:], len(tokens)]
    keys = np.repeat(np.arange(len(heads)), ends - starts) * max(1, len(index)) + owners  # ascending: by list, then document
    found = []
    for at, q in enumerate(queries):
        s = sets[q]
        if not len(s) or not len(heads):
            continue
        hit = np.minimum(np.searchsorted(heads, s), len(heads) - 1)
        hit = hit[heads[hit] == s]
        lengths = ends[hit] - starts[hit]
        if same:
            hit, lengths = hit[lengths > 1], lengths[lengths > 1]
        need = -(-num * len(s) // den)  # of any partner, as the union holds the query
        if len(hit) < need:
            continue
        by_length = hit[np.argsort(lengths, kind="stable")]
        n_long = min(need - 1, int(need / (MU * np.log2(max(2, lengths.max())) + 1)))
        short, long = by_length[: len(by_length) - n_long], by_length[len(by_length) - n_long :]
        docs, counts = occurrences([owners[starts[x] : ends[x]] for x in short])
        partner = place[docs]
        overlap_needed = -(-num * (len(s) + sizes[partner]) // (num + den))
        keep = (counts + n_long >= overlap_needed) & (partner != q)
        if same:
            keep &= docs < at
        for d, c, t in sorted(zip(docs[keep], counts[keep], overlap_needed[keep]), key=lambda x: -x[1]):
            p = int(place[d])
            a, b = forest.root(q), forest.root(p)
            if a == b:
                continue
            probe = long * len(index) + d
            where = np.minimum(np.searchsorted(keys, probe), len(keys) - 1)
            both = int(c + (keys[where] == probe).sum())
            if both >= t and _linked(both, len(s), int(sizes[p]), num, den):
                forest.up[max(a, b)] = min(a, b)
                found.append((q, p))
    return found


STEP_FLOATS = 4_000_000
STEPS = 4  # counts of a cell up to this are compared one by one, the rest in sum


def _steps(cells: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ones where a cell's count reaches 1, 2 ... STEPS, and each row's counts beyond; the product of two rows sums the smaller counts."""
    counts = np.frombuffer(b"".join(cells), "u1").reshape(len(cells), -1)
    rows = np.concatenate([counts >= t for t in range(1, STEPS + 1)], axis=1).astype("float32")
    return rows, np.maximum(counts.astype("int64") - STEPS, 0).sum(1)


def sifted(held: dict[int, bytes], sizes: np.ndarray, index: list[int], queries: list[int], num: int, den: int, label: np.ndarray, chunk: int = 64) -> None:
    """Give one label to documents that could link, judged by sketches of one class: two sets share at most the sum of the smaller counts of their cells.

    A cell that counts 255 may hold more; its set is then compared with every other. Blocks of the index keep the memory bounded.
    """
    asked = np.array(sorted(queries, key=lambda i: sizes[i]))
    ordered = np.array(sorted(index, key=lambda i: sizes[i]))
    block = max(64, STEP_FLOATS // (STEPS * len(held[index[0]])))
    for b in range(0, len(ordered), block):
        place = ordered[b : b + block]
        n = sizes[place]
        rows, beyond = _steps([held[i] for i in place])
        full = np.array([255 in held[i] for i in place])
        for a in range(0, len(asked), chunk):
            own = asked[a : a + chunk]
            lo, hi = np.searchsorted(n * den, sizes[own[0]] * num), np.searchsorted(n * num, sizes[own[-1]] * den, "right")
            if hi <= lo:
                continue
            mine, over = _steps([held[i] for i in own])
            most = mine @ rows[lo:hi].T + np.minimum(over[:, None], beyond[None, lo:hi])
            could = den * most >= num * (sizes[own][:, None] + n[None, lo:hi] - most)
            could |= full[None, lo:hi] | np.array([255 in held[i] for i in own])[:, None]
            for q, hits in zip(own, could):
                labels = np.unique(np.r_[label[q], label[place[lo:hi][hits]]])
                if len(labels) > 1:
                    label[np.isin(label, labels)] = labels[0]


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups of a partition sorted by keys, whatever the batches."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        change = (batch[keys] != batch[keys].shift()).any(axis=1).to_numpy().nonzero()[0]
        if held and (held[-1][keys].iloc[-1] == batch[keys].iloc[0]).all():
            change = change[1:]
        cuts = [0, *(c for c in change if c), len(batch)]
        if held and len(change) and change[0] == 0:
            yield pd.concat(held)
            held = []
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a and held:
                yield pd.concat(held)
                held = []
            held.append(batch.iloc[a:b])
    if held:
        yield pd.concat(held)


SEEN = 100_000  # sets that a task remembers to have signed


def shingle_rows(docs: DataFrame, k: int, num: int, den: int, signatures: bool, text: str, doc_id: str) -> DataFrame:
    """doc_id, and n_shingles with the set's digest and sketches, or the set's signatures (mostly once for equal sets of a task)."""
    kind = pa.struct([("cls", pa.int32()), ("cells", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        classes, seen = SizeClasses(num, den), set()
        for batch in batches:
            at = 0
            for texts in text_slices(batch.column("text")):
                sets = shingle_sets(texts, k)
                ids = batch.column("doc_id").slice(at, len(sets))
                at += len(sets)
                digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                if not signatures:
                    sketches = pa.array([classes.sketches(s) if len(s) else [] for s in sets], pa.list_(kind))
                    columns = [ids, pa.array(map(len, sets), pa.int64()), pa.array(digests, pa.binary()), sketches]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "digest", "sketches"])
                    continue
                if len(seen) > SEEN:
                    seen.clear()
                own, found = [], []
                for i, (s, d) in enumerate(zip(sets, digests)):
                    if d is not None and d not in seen:
                        seen.add(d)
                        signed = classes.signatures(s)
                        own.append(np.full(len(signed), i))
                        found.append(signed)
                if own:
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.concatenate(own), pa.int64())), pa.array(np.concatenate(found).view("int64"))], ["doc_id", "sig"])

    given = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    if signatures:
        return given.filter("doc_id is not null and text is not null").mapInArrow(run, "doc_id long, sig long")
    return given.mapInArrow(run, "doc_id long, n_shingles long, digest binary, sketches array<struct<cls: int, cells: binary>>")


def _search(k: int, num: int, den: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, b = [], []
        for group in _groups(batches, ["leader", "x", "y"]):
            ids = group["doc_id"].to_numpy()
            sets = [s for texts in text_slices(pa.array(group["text"], pa.large_string())) for s in shingle_sets(texts, k)]
            side = group["block"].to_numpy()
            x, y = int(group["x"].iloc[0]), int(group["y"].iloc[0])
            index = np.flatnonzero(side == x).tolist()
            queries = index if x == y else np.flatnonzero(side == y).tolist()
            for q, p in divide_skip_links(sets, index, queries, num, den):
                a.append(ids[q])
                b.append(ids[p])
            if len(a) > 10_000:
                yield pd.DataFrame({"a": a, "b": b})
                a, b = [], []
        yield pd.DataFrame({"a": pd.Series(a, dtype="int64"), "b": pd.Series(b, dtype="int64")})

    return run


def _sift(num: int, den: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _groups(batches, ["leader", "x", "y"]):
            ids, sizes, side = group["doc_id"].to_numpy(), group["n_shingles"].to_numpy("int64"), group["block"].to_numpy()
            x, y = int(group["x"].iloc[0]), int(group["y"].iloc[0])
            label = np.arange(len(ids))
            by_class: dict[int, dict[int, bytes]] = {}
            for i, sketches in enumerate(group["sketches"]):
                for sketch in sketches:
                    by_class.setdefault(sketch["cls"], {})[i] = sketch["cells"]
            for held in by_class.values():
                index = [i for i in held if side[i] == x]
                queries = index if x == y else [i for i in held if side[i] == y]
                if index and queries:
                    sifted(held, sizes, index, queries, num, den, label)
            least = pd.Series(ids).groupby(label).transform("min").to_numpy()
            other = least != ids
            yield pd.DataFrame({"leader": least[other], "doc_id": ids[other]})

    return run


def _dealt(members: DataFrame, rows: DataFrame, size: int, tag: str) -> DataFrame:
    """(doc_id, leader) with each leader's own row, joined with rows by doc_id and dealt to all pairs of its group's blocks.

    Returns doc_id, leader, block, x, y and what rows have. The members are numbers only: up to BROADCAST_BYTES of them, as
    counted, go to the rows instead of the rows to them.
    """
    members = members.unionByName(members.select(F.col("leader").alias("doc_id"), "leader").distinct())
    blocks = members.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("blocks"))
    members = materialize(members.join(blocks, "leader").withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit("block")), F.col("blocks")).cast("int")), tag)
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda o: F.struct(F.least(o, F.col("block")).cast("int").alias("x"), F.greatest(o, F.col("block")).cast("int").alias("y")),
    )
    met = rows.join(if_small(members, 24), "doc_id")
    return met.select("*", F.explode(pairs).alias("p")).select("*", "p.x", "p.y").drop("p", "blocks")


def _stand_ins(held: DataFrame, copies: DataFrame) -> DataFrame:
    """doc_id, rep: the smallest id with an equal set, for documents that share their set; not for ids whose rows hold several sets."""
    single = held.groupBy("doc_id").agg((F.min("digest") == F.max("digest")).alias("single")).filter("single").select("doc_id")
    return copies.join(single, "doc_id", "left_semi")


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id of links with Jaccard similarity >= num / den."""
    parts = shuffle_partitions(docs.sparkSession)
    together = lambda df: df.repartition(parts, "leader", "x", "y").sortWithinPartitions("leader", "x", "y", "doc_id")
    sets = materialize(shingle_rows(docs, k, num, den, False, text, doc_id), "shingle-sets")
    held = sets.filter("digest is not null and doc_id is not null")
    first = held.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    copies = materialize(held.join(first, "digest").select("doc_id", "rep").filter("doc_id <> rep").distinct(), "jaccard-copies")
    signed = shingle_rows(docs, k, num, den, True, text, doc_id)
    leaders = signed.select("doc_id", F.min("doc_id").over(Window.partitionBy("sig")).alias("leader")).filter("doc_id <> leader").distinct()
    stand_in = _stand_ins(held, copies)
    for column in ("doc_id", "leader"):
        leaders = leaders.join(stand_in.withColumnRenamed("doc_id", column), column, "left").withColumn(column, F.coalesce("rep", column)).drop("rep")
    leaders = materialize(leaders.filter("doc_id <> leader").distinct(), "jaccard-groups")
    sketched = held.select("doc_id", "n_shingles", "sketches")
    near = together(_dealt(leaders, sketched, SIFT_BLOCK, "jaccard-sifting")).mapInPandas(_sift(num, den), "leader long, doc_id long")
    near = materialize(near.distinct(), "jaccard-near")
    texts = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).filter("doc_id is not null and text is not null")
    met = together(_dealt(near, texts, BLOCK, "jaccard-members"))
    links = met.select("leader", "x", "y", "doc_id", "block", "text").mapInPandas(_search(k, num, den), "a long, b long")
    joined = connected_components(links.unionByName(copies.toDF("a", "b")), "jaccard-components")
    counted = sets.select("doc_id", "n_shingles")
    out = counted.join(joined, counted["doc_id"] == joined["node"], "left")
    return out.select(counted["doc_id"], "n_shingles", F.coalesce("component", counted["doc_id"]).alias("component_id"))


def _nodes_of_repeated(again: DataFrame, named: DataFrame, doc_id: str, text: str, node: str, several: str) -> DataFrame:
    """again with a node for each row: its id, or for ids with several texts a hash of both that is neither shared nor anybody's id."""
    salt = 0
    while True:
        own = F.xxhash64(doc_id, text, F.lit(salt))
        hashed = again.filter(several).select(own.alias("hash"), F.col(text).alias("its"))
        shared = hashed.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash")
        taken = hashed.select("hash").join(named.select(F.col(doc_id).cast("long").alias("hash")), "hash", "left_semi")
        if shared.unionByName(taken).isEmpty():
            return again.withColumn(node, F.when(F.col(several), own).otherwise(F.col(doc_id).cast("long")))
        salt += 1


def keep_one_per_group(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs without those that reach, by links, another one of a smaller id (of one id, of a smaller hash of the text).

    Rows that share an id stand for themselves, by id and text; of rows equal in both one stays. A null id stays, and links with nothing.
    """
    node, again_id, nth, several = free_names(docs, "group_node", "repeated_id", "nth_equal", "several_texts")
    named = docs.filter(F.col(doc_id).isNotNull())
    many = named.groupBy(F.col(doc_id).alias(again_id)).agg(F.count(F.lit(1)).alias(nth), (F.min(F.xxhash64(text)) < F.max(F.xxhash64(text))).alias(several)).filter(F.col(nth) > 1)
    many = if_small(materialize(many.select(again_id, several), "jaccard-repeated-ids"), 16)
    once = named.join(many, named[doc_id] == many[again_id], "left_anti").withColumn(node, F.col(doc_id).cast("long"))
    order = F.xxhash64(*[F.to_json(F.struct(*docs.columns))])
    again = named.join(many, named[doc_id] == many[again_id]).withColumn(nth, F.row_number().over(Window.partitionBy(doc_id, text).orderBy(order))).filter(F.col(nth) == 1)
    again = materialize(_nodes_of_repeated(again, named, doc_id, text, node, several).select(*docs.columns, node), "jaccard-repeated")
    base = once.unionByName(again)
    joined = jaccard_components(base.select(F.col(node).alias("doc_id"), F.col(text).alias("text")), k, num, den)
    linked = joined.filter("doc_id <> component_id").select(F.col("doc_id").alias("node"), "component_id")
    linked = materialize(linked.unionByName(linked.select(F.col("component_id").alias("node"), "component_id")).distinct(), "jaccard-linked")
    ids = linked.join(base.select(F.col(node).alias("node"), F.col(doc_id).alias("id")), "node")
    stays = ids.groupBy("component_id").agg(F.min(F.struct("id", "node"))["node"].alias("stays"))
    gone = linked.join(stays, "component_id").filter("node <> stays").select("node")
    left = base.join(gone, base[node] == gone["node"], "left_anti").select(*docs.columns)
    return left.unionByName(docs.filter(F.col(doc_id).isNull()))
