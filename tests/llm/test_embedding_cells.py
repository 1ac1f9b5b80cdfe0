"""Pairs whose difference lies along the line between centres are found, with many cells."""

import numpy as np

from reelgauge.llm import embedding_dedup


def test_low_rank_vectors_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(1200, 3)) @ rng.normal(size=(3, 96)) + rng.normal(size=(1200, 96)) * 0.01  # rank 3 of 96
    unit = base / np.linalg.norm(base, axis=1)[:, None]
    near = unit @ unit.T >= embedding_dedup.THRESHOLD
    np.fill_diagonal(near, False)
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", 20)  # 60 cells
    df = spark.createDataFrame([(i, base[i].tolist(), 0) for i in range(1200)], "vec_id long, embedding array<double>, label int")
    links = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df).collect()}
    assert [links[i] for i in range(1200)] == near.sum(1).tolist()


def brute(rows):
    """(n_links, component_id, kept) of each row, by all pairs."""
    n = len(rows)
    unit = [np.array(v) / np.linalg.norm(v) for _, v, _ in rows]
    near = [[i != j and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= embedding_dedup.THRESHOLD for j in range(n)] for i in range(n)]
    least = [r[0] for r in rows]
    for _ in range(n):
        least = [min([least[i], *(least[j] for j in range(n) if near[i][j])]) for i in range(n)]
    return sorted((rows[i][0], sum(near[i]), least[i], rows[i][0] == least[i]) for i in range(n))


def rows_of(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    return sorted(tuple(r) for r in embedding_dedup.near_duplicates(df, **options).select("vec_id", "n_links", "component_id", "kept").collect())


def test_repeated_ids_hold_other_vectors_and_labels(spark):
    rows = [
        (1, [1.0, 0.0], "a"), (1, [0.0, 1.0], "a"), (2, [1.0, 0.01], "a"), (3, [1.0, 0.0], "b"), (3, [1.0, 0.01], "b"), (3, [1.0, 0.0], "a"),
        (7, [0.0, 1.0], "b"), (7, [0.0, 1.0], "b"), (6, [0.01, 1.0], "b"), (9, [-1.0, 0.0], "a"),
    ]
    assert rows_of(spark, rows) == brute(rows)


def test_whole_result_against_brute_force_with_many_cells(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(240, 32))
    base[80:160] = base[:80] + rng.normal(size=(80, 32)) * 0.36  # about the threshold
    base[160:200] = base[160] + rng.normal(size=(40, 32)) * 0.2
    base[200:210] = base[0]
    rows = [(int(i), base[i].tolist(), "xy"[i % 2 if i < 80 else 0]) for i in rng.permutation(240)]
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", 12)
    monkeypatch.setattr(embedding_dedup, "BLOCK_ROWS", 16)
    want = brute(rows)
    assert rows_of(spark, rows, exact=True) == want and sum(w[1] for w in want) > 800
    found = rows_of(spark, rows)
    assert sum(f[1] for f in found) >= 0.97 * sum(w[1] for w in want) and all(f[1] <= w[1] for f, w in zip(found, want))


def test_recall_with_noise_of_low_rank(spark, monkeypatch):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(1000, 48))
    base[500:] = base[:500] + rng.normal(size=(500, 4)) @ rng.normal(size=(4, 48)) * 0.12  # copies differ in 4 of 48 dimensions
    unit = base / np.linalg.norm(base, axis=1)[:, None]
    near = unit @ unit.T >= embedding_dedup.THRESHOLD
    np.fill_diagonal(near, False)
    monkeypatch.setattr(embedding_dedup, "CELL_ROWS", 20)  # 50 cells
    got = rows_of(spark, [(i, base[i].tolist(), "a") for i in range(1000)])
    assert sum(g[1] for g in got) >= 0.9 * near.sum() > 0
