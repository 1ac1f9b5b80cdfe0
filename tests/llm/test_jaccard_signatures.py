"""Signatures of segments: linked sets share one, texts that merely share a passage hardly ever do."""

import numpy as np
import pytest

from reelgauge.llm.jaccard_join import SizeClasses


def draw(rng, n):
    return rng.integers(0, 1 << 63, n, dtype="int64").astype("uint64")


@pytest.mark.parametrize("num", [60, 80, 85, 95])
def test_linked_sets_share_a_signature(num):
    rng, classes, linked = np.random.default_rng(num), SizeClasses(num, 100), 0
    for _ in range(1500):
        both, a, b = draw(rng, int(2 ** rng.uniform(0, 9))), draw(rng, rng.integers(0, 60)), draw(rng, rng.integers(0, 60))
        share = (100 - num) / 100 * len(both)
        x, y = (np.unique(np.concatenate([both, own[: int(rng.uniform(0, share))]])) for own in (a, b))
        if 100 * len(both) < num * (len(x) + len(y) - len(both)) or np.array_equal(x, y):
            continue
        linked += 1
        assert np.intersect1d(classes.signatures(x), classes.signatures(y)).size
    assert linked > 300


@pytest.mark.parametrize("size", [100, 161, 250])
def test_a_shared_passage_brings_few_sets_together(size):
    rng, classes = np.random.default_rng(size), SizeClasses(80, 100)
    passage = draw(rng, size // 4)
    signed = [classes.signatures(np.unique(np.concatenate([passage, draw(rng, size)]))) for _ in range(300)]
    _, n = np.unique(np.concatenate([np.unique(s) for s in signed]), return_counts=True)
    assert (n * (n - 1) // 2).sum() < 10_000  # meetings of 44,850 pairs
