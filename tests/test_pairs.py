"""Pairs of nearest points: against sorting all pairs, and within bounded memory over a full block."""

import tracemalloc
from itertools import combinations

import numpy as np
import pytest

from keelson.operators import clusterings


def by_sorting(x, order):
    dist = {1: lambda d: np.abs(d).sum(), 2: lambda d: (d * d).sum(), np.inf: lambda d: np.abs(d).max()}[order]
    used, out = set(), []
    for _, i, j in sorted((dist(x[i] - x[j]), i, j) for i, j in combinations(range(len(x)), 2)):
        if not {i, j} & used:
            used |= {i, j}
            out.append((i, j))
    return out, sorted(set(range(len(x))) - used)


@pytest.mark.parametrize("order", [1, 2, np.inf])
@pytest.mark.parametrize("n", [1, 2, 7, 60])
def test_as_all_pairs_sorted(order, n):
    x = np.random.default_rng(n).integers(0, 6, (n, 3)).astype(float)  # ties
    pairs, left = clusterings.nearest_pairs(x, order)
    assert (pairs, left.tolist()) == by_sorting(x, order)


def test_a_full_block_in_bounded_memory():
    x = np.random.default_rng(0).standard_normal((clusterings.BLOCK, 4))
    tracemalloc.start()
    label = clusterings.pair_up(x, 2, 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20 and (np.bincount(label) == 2).all()
