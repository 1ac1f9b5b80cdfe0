"""Embedding near-dedup: spherical k-means cells, blocked cosines within cells, one kept per group.

1. Vectors equal in label and components are one class with a member count, so copies cost nothing
   later. Vectors that are null, zero or hold null or non-finite components, or have a null label,
   link with nothing: each is a group of its own.
2. Centres are fitted by spherical k-means on a sample bounded by SAMPLE_ROWS and SAMPLE_FLOATS,
   picked by hash; the number of cells follows the largest label's number of classes up to MAX_CELLS, beyond which
   cells grow. Every class is indexed in its nearest cell, and visits other cells whose side a partner may lie on. Vectors
   within the angle acos(t) of x can lie beyond the plane between x's centre and another only if x is at most sin(acos(t)) from it.
   ``exact`` visits all of those: no pair is lost, but in many dimensions that is nearly every cell. Else a share of that distance
   is taken. It is measured on true links: QUERIES classes, picked by hash, are compared with every class of their label, and
   the share is a tenth more than the least at which LINKS_KEPT of their links are found, both of all links and as a mean over the
   queries. It is never below MARGIN / sqrt(dimensions), which differences need that spread over as many dimensions as the
   points of a cell do; and at 1 the search is exact.
3. A cell's residents and its guests (residents and visitors) are dealt into blocks of about
   BLOCK_ROWS; each pair of blocks is one task with one matrix product in double precision. It hands back per guest
   the number of links and the smallest id of its local component, never the pairs.
4. Local components are joined by distributed connected components.

Rows with the same vec_id count as vectors of their own, each with its own links (kept says no more than that the row's id
is its component's); the result has one row for each row in, none for an empty table. A row with a null vec_id links
with nothing, and is kept with a null component_id. Extra columns are ignored; a vector of any width is compared whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components

THRESHOLD = 0.93
SAMPLE_ROWS = 8192
SAMPLE_FLOATS = 4_000_000
CELL_ROWS = 256
MAX_CELLS = 1024
MARGIN = 2.5  # standard deviations of a link's difference along the line between two centres
QUERIES = 512  # classes whose links are all found, to measure how far visits must reach
LINKS_KEPT = 0.998
SHARES = 200
BLOCK_ROWS = 1024


def spherical_kmeans(unit: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = unit[rng.permutation(len(unit))[:k]].copy()
    for _ in range(rounds):
        nearest = (unit @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, unit)
        norms = np.linalg.norm(sums, axis=1)
        lost = norms < 1e-12
        centres[~lost] = sums[~lost] / norms[~lost, None]
        if lost.any():
            centres[lost] = unit[rng.integers(0, len(unit), int(lost.sum()))]
    return centres


def spread_dimensions(unit: np.ndarray, centres: np.ndarray) -> float:
    """In how many dimensions the points of a cell spread about its centre: (trace C)^2 / trace C^2 of their covariance, 1 at least."""
    off = unit - centres[(unit @ centres.T).argmax(1)]
    spread = np.linalg.eigvalsh(off.T @ off) if len(off) else np.zeros(1)
    return max(1.0, float(spread.sum() ** 2 / max((spread**2).sum(), 1e-300)))


def _unit(vector) -> np.ndarray | None:
    if vector is None:
        return None
    try:
        x = np.array(vector, dtype="float64")
    except (TypeError, ValueError):
        return None
    if not len(x) or not np.isfinite(x).all():
        return None
    top = np.abs(x).max()
    if top == 0:
        return None
    x = x / top  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum())


def _classes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        units = [_unit(v) if isinstance(l, str) else None for v, l in zip(batch["embedding"], batch["label"])]
        raw = [None if u is None else np.asarray(v, "float64").tobytes() for u, v in zip(units, batch["embedding"])]
        keys = [None if r is None else hashlib.blake2b(r + l.encode(), digest_size=16).digest() for r, l in zip(raw, batch["label"])]
        yield pd.DataFrame({"vec_id": batch["vec_id"].array, "grp": [None if k is None else l for k, l in zip(keys, batch["label"])], "key": keys, "unit": [None if u is None else u.tobytes() for u in units]})


def block_links(group: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Residents (home) of one block against the guests of one block: links of each guest, and local components."""
    home, guest = group[group["home"]], group[~group["home"]]
    ids_h, ids_g = home["cid"].to_numpy("int64"), guest["cid"].to_numpy("int64")
    none = pd.DataFrame({"cid": np.empty(0, "int64"), "links": np.empty(0, "int64"), "local": np.empty(0, "int64")})
    if not len(ids_h) or not len(ids_g):
        return none
    by_size: dict[int, tuple[list[int], list[int]]] = {}
    for which, frame in ((0, home), (1, guest)):
        for i, u in enumerate(frame["unit"]):
            by_size.setdefault(len(u), ([], []))[which].append(i)
    label_h, label_g, links = ids_h.copy(), ids_g.copy(), np.zeros(len(ids_g), "int64")
    weight, top = home["n"].to_numpy("int64"), np.iinfo("int64").max
    for at_h, at_g in by_size.values():  # vectors of another width have no cosine
        if not at_h or not at_g:
            continue
        h, g = np.array(at_h), np.array(at_g)
        x = np.frombuffer(b"".join(home["unit"].iloc[h]), "float64").reshape(len(h), -1)
        y = np.frombuffer(b"".join(guest["unit"].iloc[g]), "float64").reshape(len(g), -1)
        hit = (y @ x.T >= threshold) & (ids_g[g][:, None] != ids_h[h][None, :])
        links[g] += hit @ weight[h]
        hit |= ids_g[g][:, None] == ids_h[h][None, :]
        while True:
            now_g = np.minimum(label_g[g], np.where(hit, label_h[h][None, :], top).min(1))
            now_h = np.minimum(label_h[h], np.where(hit, now_g[:, None], top).min(0))
            if (now_g == label_g[g]).all() and (now_h == label_h[h]).all():
                break
            label_g[g], label_h[h] = now_g, now_h
    out = pd.DataFrame({"cid": np.r_[ids_g, ids_h], "links": np.r_[links, np.zeros(len(ids_h), "int64")], "local": np.r_[label_g, label_h]})
    return out[(out["links"] > 0) | (out["local"] != out["cid"])]


def needed_shares(near: np.ndarray, centres: np.ndarray, home: np.ndarray, cells: np.ndarray, reach: float) -> np.ndarray:
    """Share of the full reach at which vectors with these products with all centres visit the given cells from their homes; 0 at home."""
    gap = np.linalg.norm(centres[cells] - centres[home], axis=1) * reach
    i = np.arange(len(near))
    return np.where(cells == home, 0.0, (near[i, home] - near[i, cells]) / np.maximum(gap, 1e-300))


def measured_share(classes: DataFrame, centres: np.ndarray, threshold: float, reach: float) -> float:
    """The share of the full reach at which LINKS_KEPT of the links of QUERIES classes are found; 0 where they have none."""
    fits = F.octet_length("unit") == 8 * centres.shape[1]
    asked = classes.filter(fits).orderBy(F.xxhash64("key", F.lit("query")), "key").select("grp", "cid", "unit").limit(QUERIES).collect()
    if not asked or len(centres) < 2:
        return 0.0
    q = np.array([np.frombuffer(r.unit, "float64") for r in asked])
    q_near = q @ centres.T
    q_home, q_cid, q_grp = q_near.argmax(1), np.array([r.cid for r in asked]), np.array([r.grp for r in asked], dtype=object)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros((len(q), SHARES + 1), "int64")
        for batch in batches:
            for at in range(0, len(batch), BLOCK_ROWS):
                own = batch.iloc[at : at + BLOCK_ROWS]
                y = np.frombuffer(b"".join(own["unit"]), "float64").reshape(len(own), -1)
                hit = (y @ q.T >= threshold) & (own["grp"].to_numpy(dtype=object)[:, None] == q_grp[None, :]) & (own["cid"].to_numpy("int64")[:, None] != q_cid[None, :])
                i, j = np.nonzero(hit)
                if not len(i):
                    continue
                near = y @ centres.T
                home = near.argmax(1)
                for need in (needed_shares(near[i], centres, home[i], q_home[j], reach), needed_shares(q_near[j], centres, q_home[j], home[i], reach)):
                    np.add.at(seen, (j, np.clip(np.ceil(need * SHARES), 0, SHARES).astype("int64")), 1)
        query, level = np.nonzero(seen)
        yield pd.DataFrame({"query": query, "level": level, "n": seen[query, level]})

    levels = classes.filter(fits).select("grp", "cid", "unit").mapInPandas(count, "query long, level long, n long").groupBy("query", "level").agg(F.sum("n").alias("n")).toPandas()
    if not len(levels):
        return 0.0
    seen = np.zeros((len(q), SHARES + 1))
    seen[levels["query"].to_numpy("int64"), levels["level"].to_numpy("int64")] = levels["n"].to_numpy(float)
    seen = seen[seen.sum(1) > 0]
    kept = np.minimum(seen.sum(0).cumsum() / seen.sum(), (seen.cumsum(1) / seen.sum(1, keepdims=True)).mean(0))
    return float(np.argmax(kept >= LINKS_KEPT - 1e-12)) / SHARES


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, exact: bool = False) -> DataFrame:
    """vec_id, n_links, component_id, kept; vectors: vec_id, embedding, label. exact: visit every cell that a partner can lie in."""
    given = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].alias("embedding"), vectors["label"].cast("string").alias("label"))  # a string in every batch, null or not
    keyed = materialize(given.mapInPandas(_classes, "vec_id long, grp string, key binary, unit binary"), "vectors")
    valid = keyed.filter("key is not null and vec_id is not null")
    classes = valid.groupBy("grp", "key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("unit").alias("unit"))
    classes = materialize(classes.withColumn("cid", F.monotonically_increasing_id()), "vector-classes")  # numbered once, where they are written
    largest, width = classes.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("unit")).alias("w")).agg(F.max("n"), F.max("w")).first()
    k = int(min(MAX_CELLS, max(1, -(-(largest or 0) // CELL_ROWS))))
    rows = int(min(SAMPLE_ROWS, SAMPLE_FLOATS * 8 // max(8, width or 8)))
    sample = classes.filter(F.octet_length("unit") == (width or 0)).orderBy(F.xxhash64("key"), "key").select("unit").limit(max(1, rows)).collect()
    points = np.array([np.frombuffer(r[0], "float64") for r in sample]) if sample else np.ones((1, 1))
    centres = spherical_kmeans(points, min(k, len(points)))
    full = np.sqrt(max(0.0, 1 - threshold * threshold)) if threshold > 0 else 1.0
    share = 1.0 if exact else min(1.0, max(MARGIN / np.sqrt(spread_dimensions(points, centres)), 1.1 * measured_share(classes, centres, threshold, full)))
    reach = share * full + 1e-9  # with room for rounding
    apart = np.linalg.norm(centres[:, None, :] - centres[None, :, :], axis=2) if len(centres) <= 256 else None

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cells = []
            for u in batch["unit"]:
                x = np.frombuffer(u, "float64")
                if len(x) != centres.shape[1]:
                    cells.append([0])
                    continue
                near = centres @ x
                home = int(near.argmax())
                gap = apart[home] if apart is not None else np.linalg.norm(centres - centres[home], axis=1)
                visits = np.flatnonzero(near[home] - near <= reach * gap)
                cells.append([home, *(int(c) for c in visits if c != home)])
            yield pd.DataFrame({"grp": batch["grp"], "cid": batch["cid"], "n": batch["n"], "unit": batch["unit"], "cells": cells})

    placed = classes.select("grp", "cid", "n", "unit").mapInPandas(assign, "grp string, cid long, n long, unit binary, cells array<int>")
    placed = placed.select("grp", "cid", "n", "unit", F.posexplode("cells").alias("pos", "cell"))
    sizes = placed.groupBy("grp", "cell").agg(F.count_if(F.col("pos") == 0).alias("n_home"), F.count(F.lit(1)).alias("n_guest"))
    blocks = sizes.select("grp", "cell", F.ceil(F.col("n_home") / BLOCK_ROWS).cast("int").alias("bh"), F.ceil(F.col("n_guest") / BLOCK_ROWS).cast("int").alias("bg")).filter("bh > 0")
    dealt = placed.join(blocks, ["grp", "cell"])
    mine = F.xxhash64("cid", F.lit("block"))
    columns = ["grp", "cell", "cid", "n", "unit"]
    residents = dealt.filter("pos = 0").select(*columns, F.lit(True).alias("home"), F.pmod(mine, F.col("bh")).cast("int").alias("x"), F.explode(F.sequence(F.lit(0), F.col("bg") - 1)).alias("y"))
    guests = dealt.select(*columns, F.lit(False).alias("home"), F.explode(F.sequence(F.lit(0), F.col("bh") - 1)).alias("x"), F.pmod(mine, F.col("bg")).cast("int").alias("y"))
    found = (
        residents.unionByName(guests)
        .groupBy("grp", "cell", "x", "y")
        .applyInPandas(lambda group: block_links(group, threshold), "cid long, links long, local long")
    )
    found = materialize(found, "vector-links")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    joined = connected_components(found.select(F.col("cid").alias("a"), F.col("local").alias("b")), "vector-components")
    joined = materialize(joined.join(classes.select(F.col("cid").alias("node"), "rep"), "node"), "vector-reached")
    joined = joined.join(joined.groupBy("component").agg(F.min("rep").alias("least")), "component").select("node", "least")
    answer = (
        classes.select("grp", "key", "cid", "rep", "n")
        .join(links, "cid", "left")
        .join(joined, F.col("cid") == F.col("node"), "left")
        .select("grp", "key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("least", "rep").alias("component_id"))
    )
    out = keyed.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("grp")).alias("grp"), "key").join(answer, ["grp", "key"], "left")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"),
    )
