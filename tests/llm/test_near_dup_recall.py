"""The number of trees follows from the target recall."""

import numpy as np
import pytest

from pagelake.llm import near_dups as ND


@pytest.mark.parametrize("percent", [80, 85])
def test_trees_reach_the_target(percent):
    n = ND.trees_for(percent / 100, ND.RECALL)
    assert ND.missed(percent / 100, n, ND.DEPTH) <= 1 - ND.RECALL < ND.missed(percent / 100, n - 1, ND.DEPTH)
    assert ND.trees_for(0.80, ND.RECALL) > ND.trees_for(0.85, ND.RECALL)
    with pytest.raises(ValueError):
        ND.trees_for(0.5, 0.999999)


@pytest.mark.parametrize("threshold", [0.80, 0.85])
def test_pairs_at_the_threshold_share_leaves(threshold):
    trees, pairs, lost = ND.trees_for(threshold, ND.RECALL), 1500, 0
    rng = np.random.default_rng(1)
    for _ in range(pairs):
        a = rng.integers(0, 65536, ND.COORDINATES).astype(np.uint16)
        b = np.where(rng.random(ND.COORDINATES) < threshold, a, a + np.uint16(1))
        tokens = np.stack([a, b])
        path = np.repeat(rng.integers(0, ND.ONE_TREE, dtype=np.uint64) + np.arange(trees, dtype=np.uint64) * np.uint64(ND.ONE_TREE), 2)
        index = np.tile(np.arange(2), trees)
        for _ in range(ND.DEPTH):
            path, index = ND.descend(path, index, tokens, threshold)
        lost += not np.intersect1d(path[index == 0], path[index == 1]).size
    assert lost <= 2 * (1 - ND.RECALL) * pairs
