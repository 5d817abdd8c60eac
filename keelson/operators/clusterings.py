"""Clustering registry: ``(keys, bf, seed) -> keys with cluster``, K = ceil(n / bf) per head.

Distributed methods are DataFrame plans.  Sequential ones (farthest point,
matching, capacity-balanced assignment) run on NumPy.  ``local_balls``, which compares them, runs each over
whole heads, a task a method and head: a task holds the head's points and CHUNK distances at a time, and works in a
time that grows with the square of the head.  As the levels of a tree, which loses no hit by its clusters, they run per
head and block: there a head of more than ``BLOCK`` keys is cut by position first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.functions import vec
from keelson.operators import index
from keelson.operators.blocks import measured
from keelson.operators.index import by_position
from keelson.operators.lineage import cut
from keelson.operators.ranks import running
from keelson.operators.search import heads

#: Positions of a block, centres that the distributed k-means compares with all keys, and distances that a NumPy method holds at once.
BLOCK, MOST_FLAT, CHUNK = 8192, 512, 1 << 23


def _k(n: int, bf: int) -> int:
    return max(1, -(-n // bf))


def _d2(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = 2 * a @ b.T
    np.subtract((a * a).sum(1)[:, None], d, out=d)
    d += (b * b).sum(1)[None]
    return np.maximum(d, 0, out=d)


def _slices(n: int, k: int) -> Iterator[slice]:
    """Runs of n points whose distances to k centres are CHUNK or fewer."""
    for at in range(0, n, step := max(1, CHUNK // max(1, k))):
        yield slice(at, min(n, at + step))


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of the centres ``c`` to each point, the first of equal ones, and its squared distance."""
    label, far = np.empty(len(x), np.int64), np.empty(len(x))
    for own in _slices(len(x), len(c)):
        d = _d2(x[own], c)
        label[own] = d.argmin(1)
        far[own] = d[np.arange(len(d)), label[own]]
    return label, far


def _distances(x: np.ndarray, c: np.ndarray, order: float, room: np.ndarray) -> np.ndarray:
    """How far the rows of ``x`` are from ``c``; ``room`` holds two arrays like ``x``, so that none is made a call."""
    d = np.subtract(x, c, out=room[0])
    if order == 2:
        return np.sqrt(np.multiply(d, d, out=d).sum(1))
    np.abs(d, out=d)
    if order != 3:
        return d.max(1) if order == np.inf else d.sum(1)
    np.multiply(d, d, out=room[1])  # a general power takes ten times as long
    return np.multiply(room[1], d, out=d).sum(1) ** (1 / 3)


def lloyd(x: np.ndarray, k: int, rng, rounds: int = 10, centers: np.ndarray | None = None, mid: bool = False) -> np.ndarray:
    """Labels of k-means; empty clusters take the farthest points; ``mid`` centres boxes instead of means."""
    c = x[rng.choice(len(x), k, replace=False)] if centers is None else centers.copy()
    label = np.zeros(len(x), int)
    for _ in range(rounds):
        label, far = _nearest(x, c)
        own = x[np.argsort(label, kind="stable")]
        n = np.bincount(label, minlength=len(c))
        some, none = np.flatnonzero(n), np.flatnonzero(n == 0)
        at = (np.cumsum(n) - n)[some]
        if mid:
            c[some] = (np.minimum.reduceat(own, at) + np.maximum.reduceat(own, at)) / 2
        else:
            c[some] = np.add.reduceat(own, at) / n[some, None]
        if len(none):
            c[none] = x[np.argsort(-far)[: len(none)]]
    return _nearest(x, c)[0]


def spread_seeds(x: np.ndarray, k: int, rng) -> np.ndarray:
    """Seeds drawn with chance proportional to the squared distance from those before."""
    out = [int(rng.integers(len(x)))]
    d = _d2(x, x[out])[:, 0]
    while len(out) < k:
        p = d / d.sum() if d.sum() > 0 else np.full(len(x), 1 / len(x))
        out.append(int(rng.choice(len(x), p=p)))
        d = np.minimum(d, _d2(x, x[out[-1:]])[:, 0])
    return x[out]


def farthest(x: np.ndarray, k: int, rng, order: float = 2) -> np.ndarray:
    """Labels by the k-center sweep: each new centre is the point farthest from those before."""
    room = np.empty((2, *x.shape))
    dist = lambda c: _distances(x, c, order, room)
    best, label = dist(x[0]), np.zeros(len(x), int)
    for j in range(1, k):
        d = dist(x[best.argmax()])
        nearer = d < best
        best, label = np.where(nearer, d, best), np.where(nearer, j, label)
    return label


def fill(x: np.ndarray, centers: np.ndarray, bf: int) -> np.ndarray:
    """Capacity-bound assignment: pairs by distance, each point to the nearest centre that has room."""
    label, room = np.full(len(x), -1), np.full(len(centers), bf)
    order = np.argsort(_nearest(x, centers)[1], kind="stable")
    whole = _d2(x, centers) if len(x) * len(centers) <= CHUNK else None
    for part in _slices(len(x), len(centers)):
        own = order[part]
        for p, d in zip(own, whole[own] if whole is not None else _d2(x[own], centers), strict=True):
            d[room == 0] = np.inf
            c = int(d.argmin())
            if room[c]:
                label[p], room[c] = c, room[c] - 1
    return label


def means(x: np.ndarray, label: np.ndarray) -> np.ndarray:
    ids, inverse = np.unique(label, return_inverse=True)
    out = np.zeros((len(ids), x.shape[1]))
    np.add.at(out, inverse, x)
    return out / np.bincount(inverse)[:, None]


def greedy_groups(x: np.ndarray, bf: int, order: float = 2, start: str = "first") -> np.ndarray:
    """Repeatedly take a free point (the first, or the farthest from the mean) and its bf - 1 nearest free ones."""
    free = np.ones(len(x), bool)
    label, j, room = np.full(len(x), -1), 0, np.empty((2, *x.shape))
    reach = np.linalg.norm(x - x.mean(0), axis=1)
    while free.any():
        p = int(np.flatnonzero(free)[0]) if start == "first" else int(np.where(free, reach, -1).argmax())
        d = np.where(free, _distances(x, x[p], order, room), np.inf)
        d[p] = -1
        own = np.argsort(d, kind="stable")[: min(bf, int(free.sum()))]
        label[own], free[own] = j, False
        j += 1
    return label


#: Distances that are made at once: few, so that they stay in the processor's cache.
CELLS = 1 << 16


def _rough(a: np.ndarray, b: np.ndarray, order: float) -> np.ndarray:
    """Distances (squared ones, if ``order`` is 2) of the rows of ``a`` and of columns of ``b``, in 32 bits."""
    if order == 2:
        return (a * a).sum(1)[:, None] - 2 * a @ b + (b * b).sum(0)
    out, one = np.zeros((len(a), b.shape[1]), np.float32), np.empty((len(a), b.shape[1]), np.float32)
    for j in range(a.shape[1]):
        if order == 1:  # |a - b| is twice the larger less both
            out += np.maximum(a[:, j, None], b[j], out=one)
        else:
            np.abs(np.subtract(a[:, j, None], b[j], out=one), out=one)
            np.maximum(out, one, out=out)
    return 2 * out - a.sum(1)[:, None] - b.sum(0) if order == 1 else out


def _nearest_other(x: np.ndarray, rows: np.ndarray, free: np.ndarray, order: float) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of ``free`` to each of ``rows`` but itself, the first of equal ones, and its distance.

    Distances in 32 bits say which may be nearest, CELLS at a time; those are computed again in 64 bits.
    """
    best, far = np.empty(len(rows), np.int64), np.empty(len(rows))
    middle = x.mean(0)
    y = (x - middle).astype(np.float32)
    columns = np.ascontiguousarray(y[free].T)
    size = np.abs(y).sum(1, dtype=float).max() if order != 2 else (y * y).sum(1, dtype=float).max()
    apart = 16 * (x.shape[1] + 4) * np.finfo(np.float32).eps * size + 1e-30
    for at in range(0, len(rows), step := max(1, CELLS // len(free))):
        part = rows[at : at + step]
        d = _rough(y[part], columns, order)
        itself = part[:, None] == free[None]
        d[itself] = np.inf
        row, col = np.nonzero(~(d > d.min(1)[:, None] + np.float32(apart)) & ~itself)  # what overflowed is computed again too
        exact = np.zeros(len(row))
        for j in range(x.shape[1]):
            gap = np.abs(x[part[row], j] - x[free[col], j])
            exact = np.maximum(exact, gap) if order == np.inf else exact + (gap if order == 1 else gap * gap)
        by = np.lexsort((col, exact, row))
        first = by[np.searchsorted(row[by], np.arange(len(part)))]
        best[at : at + step], far[at : at + step] = free[col[first]], exact[first]
    return best, far


def nearest_pairs(x: np.ndarray, order: float) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Pairs by ascending distance of points that are both free, and who is left over.

    Points that are each other's nearest free ones are paired at once: no later pair could come
    between them.  Only those whose nearest one was taken look again.
    """
    free, look = np.arange(len(x)), np.arange(len(x))
    near, far, made = np.full(len(x), -1), np.zeros(len(x)), []
    while len(free) > 1:
        near[look], far[look] = _nearest_other(x, look, free, order)
        both = free[(near[near[free]] == free) & (free < near[free])]
        made += [(far[i], int(i), int(near[i])) for i in both]
        taken = np.zeros(len(x), bool)
        taken[both] = taken[near[both]] = True
        free = free[~taken[free]]
        look = free[taken[near[free]]]
    return [(i, j) for _, i, j in sorted(made)], free


def pair_up(x: np.ndarray, bf: int, order: float = 2) -> np.ndarray:
    """Pairs by ascending distance, then pairs of pairs, until groups reach bf (a power of two)."""
    groups = [[i] for i in range(len(x))]
    while len(groups[0]) * 2 <= bf and len(groups) > 1:
        pairs, left = nearest_pairs(np.array([x[g].mean(0) for g in groups]), order)
        groups = [groups[i] + groups[j] for i, j in pairs] + [groups[i] for i in left]
    label = np.empty(len(x), int)
    for j, g in enumerate(groups):
        label[g] = j
    return label


def axes(x: np.ndarray, k: int | None = None) -> np.ndarray:
    """x in its principal axes, the widest first."""
    y = x - x.mean(0)
    _, _, v = np.linalg.svd(y, full_matrices=False)
    return y @ v[: k or len(v)].T


def chunks(values: np.ndarray, bf: int) -> np.ndarray:
    label = np.empty(len(values), int)
    label[np.argsort(values, kind="stable")] = np.arange(len(values)) // bf
    return label


def halves(x: np.ndarray, bf: int, axis: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Halve at the median of a projection until parts hold bf or fewer."""
    label, todo, j = np.empty(len(x), int), [np.arange(len(x))], 0
    while todo:
        own = todo.pop()
        if len(own) <= bf:
            label[own], j = j, j + 1
            continue
        by = own[np.argsort(axis(x[own]), kind="stable")]
        todo += [by[len(by) // 2 :], by[: len(by) // 2]]
    return label


def morton(x: np.ndarray, dims: int = 4, bits: int = 8) -> np.ndarray:
    """Interleaved bits of the ranks along the first axes."""
    y = axes(x, dims)
    r = (np.argsort(np.argsort(y, axis=0), axis=0) * ((1 << bits) - 1) // max(1, len(x) - 1)).astype(np.int64)
    return sum(((r[:, d] >> b) & 1) << (b * y.shape[1] + d) for b in range(bits) for d in range(y.shape[1]))


def codes(x: np.ndarray, k: int, rng, parts: int = 2, mid: bool = False, norm: float = 2, seeds: str = "random") -> np.ndarray:
    """Product codes: k-means in each slice; equal code tuples are one cluster."""
    per = max(1, int(np.ceil(k ** (1 / parts))))
    tuples = []
    for part in np.array_split(x, parts, axis=1):
        c = spread_seeds(part, min(per, len(part)), rng) if seeds == "spread" else None
        tuples.append(lloyd(part, min(per, len(part)), rng, centers=c, mid=mid) if norm == 2 else farthest(part, min(per, len(part)), rng, norm))
    return np.unique(np.stack(tuples, 1), axis=0, return_inverse=True)[1].reshape(-1)


def rays(x: np.ndarray, weight: float = 0.5) -> np.ndarray:
    """Direction, with the weighted log norm beside it."""
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.hstack([x / np.maximum(n, 1e-12), weight * np.log(np.maximum(n, 1e-12))])


def direction(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def shells(x: np.ndarray, k: int, rng, count: int = 4) -> np.ndarray:
    """Quantiles of the norm, then k-means by direction in each."""
    shell = chunks(np.linalg.norm(x, axis=1), -(-len(x) // count))
    out = np.zeros(len(x), int)
    for s in range(shell.max() + 1):
        own = np.flatnonzero(shell == s)
        out[own] = s * k + lloyd(direction(x[own]), min(len(own), max(1, k // count)), rng)
    return out


def white(x: np.ndarray) -> np.ndarray:
    y = axes(x)
    return y / np.maximum(y.std(0), 1e-9)


def refined(x: np.ndarray, label: np.ndarray, rounds: int = 3, mid: bool = False) -> np.ndarray:
    """A few Lloyd rounds from given clusters."""
    return lloyd(x, label.max() + 1, np.random.default_rng(0), rounds, means(x, label), mid)


def ratio_balls(x: np.ndarray, label: np.ndarray, rounds: int = 3) -> np.ndarray:
    """Reassign by distance relative to the cluster's radius, so that tight balls stay tight."""
    for _ in range(rounds):
        c = means(x, label)
        ids, r = np.unique(label, return_inverse=True)[1].reshape(-1), np.zeros(len(c))
        for own in _slices(len(x), len(c)):
            np.maximum.at(r, ids[own], np.sqrt(_d2(x[own], c)[np.arange(own.stop - own.start), ids[own]]))
        size, label = np.maximum(r, np.median(r) + 1e-9), np.empty(len(x), np.int64)
        for own in _slices(len(x), len(c)):
            label[own] = (np.sqrt(_d2(x[own], c)) / size).argmin(1)
    return label


#: NumPy methods: (x, bf, rng) -> labels.
LOCAL: dict[str, Callable[[np.ndarray, int, np.random.Generator], np.ndarray]] = {
    "kmeans": lambda x, bf, r: lloyd(x, _k(len(x), bf), r),
    "kmeans_pp": lambda x, bf, r: lloyd(x, _k(len(x), bf), r, centers=spread_seeds(x, _k(len(x), bf), r)),
    "spherical_kmeans": lambda x, bf, r: lloyd(direction(x), _k(len(x), bf), r),
    "direction_kmeans": lambda x, bf, r: lloyd(direction(x), _k(len(x), bf), r, centers=spread_seeds(direction(x), _k(len(x), bf), r)),
    "pca_kmeans": lambda x, bf, r: lloyd(axes(x, 16), _k(len(x), bf), r),
    "gmm_diag": lambda x, bf, r: hard_mixture(x, _k(len(x), bf), r),
    "kcenter": lambda x, bf, r: refined(x, farthest(x, _k(len(x), bf), r), 5),
    "kcenter_lp": lambda x, bf, r: farthest(x, _k(len(x), bf), r, 3),
    "kcenter_meb": lambda x, bf, r: refined(x, farthest(x, _k(len(x), bf), r), mid=True),
    "kcenter_minimax": lambda x, bf, r: farthest(x, _k(len(x), bf), r, np.inf),
    "ball_ratio_kmeans": lambda x, bf, r: ratio_balls(x, lloyd(x, _k(len(x), bf), r)),
    "ball_ratio_kcenter": lambda x, bf, r: ratio_balls(x, farthest(x, _k(len(x), bf), r)),
    "ray_kmeans": lambda x, bf, r: lloyd(rays(x), _k(len(x), bf), r),
    "ray_kcenter": lambda x, bf, r: farthest(rays(x), _k(len(x), bf), r),
    "ray_kcenter_meb": lambda x, bf, r: refined(rays(x), farthest(rays(x), _k(len(x), bf), r), mid=True),
    "balanced_ray_kmeans": lambda x, bf, r: fill(rays(x), means(rays(x), chunks(lloyd(rays(x), _k(len(x), bf), r), bf)), bf),
    "balanced_ray_kcenter": lambda x, bf, r: fill(rays(x), means(rays(x), chunks(farthest(rays(x), _k(len(x), bf), r), bf)), bf),
    "shell_kmeans": lambda x, bf, r: shells(x, _k(len(x), bf), r),
    "dirnorm_pq": lambda x, bf, r: codes(rays(x), _k(len(x), bf), r),
    "linf_kmeans": lambda x, bf, r: refined(x, farthest(x, _k(len(x), bf), r, np.inf), mid=True),
    "span_kmeans": lambda x, bf, r: lloyd(x, _k(len(x), bf), r, mid=True),
    "pq_subspace": lambda x, bf, r: codes(x, _k(len(x), bf), r),
    "pca_pq": lambda x, bf, r: codes(axes(x), _k(len(x), bf), r),
    "whitened_pq": lambda x, bf, r: codes(white(x), _k(len(x), bf), r),
    "whitened_pq_kpp": lambda x, bf, r: codes(white(x), _k(len(x), bf), r, seeds="spread"),
    "whitened_pq_span": lambda x, bf, r: codes(white(x), _k(len(x), bf), r, mid=True),
    "pq_l2": lambda x, bf, r: codes(x, _k(len(x), bf), r, seeds="spread"),
    "pq_linf": lambda x, bf, r: codes(x, _k(len(x), bf), r, norm=np.inf),
    "pq_span": lambda x, bf, r: codes(x, _k(len(x), bf), r, mid=True),
    "pq_span_refine": lambda x, bf, r: refined(x, codes(x, _k(len(x), bf), r, mid=True), mid=True),
    "pq_balanced_span": lambda x, bf, r: fill(x, means(x, chunks(codes(x, _k(len(x), bf), r, mid=True), bf)), bf),
    "pca_axis_chunk": lambda x, bf, r: chunks(axes(x, 1)[:, 0], bf),
    "pca_morton_chunk": lambda x, bf, r: chunks(morton(x), bf),
    "pca_morton_span": lambda x, bf, r: refined(x, chunks(morton(x), bf), mid=True),
    "balanced_kmeans": lambda x, bf, r: fill(x, means(x, chunks(lloyd(x, _k(len(x), bf), r), bf)), bf),
    "balanced_kcenter": lambda x, bf, r: fill(x, means(x, chunks(farthest(x, _k(len(x), bf), r), bf)), bf),
    "balanced_pca_tree": lambda x, bf, r: halves(x, bf, lambda y: axes(y, 1)[:, 0]),
    "pca_tree": lambda x, bf, r: halves(axes(x, 8), bf, lambda y: y[:, y.var(0).argmax()]),
    "pca_bisect": lambda x, bf, r: halves(axes(x, 1), bf, lambda y: y[:, 0]),
    "batch_nn": lambda x, bf, r: greedy_groups(x, bf),
    "batch_nn_lp": lambda x, bf, r: greedy_groups(x, bf, 3),
    "l1_batch_nn": lambda x, bf, r: greedy_groups(x, bf, 1),
    "nn_greedy": lambda x, bf, r: greedy_groups(x, bf, start="far"),
    "l1_nn": lambda x, bf, r: pair_up(x, bf, 1),
    "linf_nn": lambda x, bf, r: pair_up(x, bf, np.inf),
    "weighted_l1_nn": lambda x, bf, r: pair_up(x / np.maximum(x.std(0), 1e-9), bf, 1),
    "fast_balanced_nn": lambda x, bf, r: greedy_groups(x[np.argsort(axes(x, 1)[:, 0])], bf)[np.argsort(np.argsort(axes(x, 1)[:, 0]))],
    "fast_nn_pairing": lambda x, bf, r: pair_up(x, bf),
    "min_weight_matching": lambda x, bf, r: matched(x, bf),
    "proj_nn": lambda x, bf, r: chunks(x @ r.standard_normal(x.shape[1]), bf),
    "recursive_proj": lambda x, bf, r: halves(x, bf, lambda y: y @ r.standard_normal(y.shape[1])),
}


def hard_mixture(x: np.ndarray, k: int, rng, rounds: int = 20, least: float = 1e-8) -> np.ndarray:
    """Labels of a mixture of Gaussians with diagonal variances, by hard assignment from a few rounds of k-means."""
    label = lloyd(x, k, rng, rounds=5)
    for _ in range(rounds):
        ids, label = np.unique(label, return_inverse=True)
        n = np.bincount(label)[:, None]
        m = means(x, label)
        square = np.zeros_like(m)
        np.add.at(square, label, (x - m[label]) ** 2)
        v = np.maximum(square / n, least)
        # expanded, so that no array is larger than points by clusters
        now, rest = np.empty(len(x), np.int64), (m * m / v + np.log(v)).sum(1)
        for own in _slices(len(x), len(m)):
            now[own] = ((x[own] * x[own]) @ (1 / v).T - 2 * x[own] @ (m / v).T + rest - 2 * np.log(n[:, 0] / len(x))).argmin(1)
        if (now == label).all():
            break
        label = now
    return label


def assignment(cost: np.ndarray) -> np.ndarray:
    """The column of each row in a square assignment of least total cost, by shortest augmenting paths."""
    n = len(cost)
    row_price, col_price = np.zeros(n), np.zeros(n)
    row_of = np.full(n, -1)
    for start in range(n):
        reach, through, done = np.full(n, np.inf), np.full(n, -1), np.zeros(n, bool)
        row, length = start, 0.0
        rows = [start]
        while True:
            step = length + cost[row] - row_price[row] - col_price
            better = ~done & (step < reach)
            reach[better], through[better] = step[better], row
            col = int(np.where(done, np.inf, reach).argmin())
            length, done[col] = reach[col], True
            if row_of[col] < 0:
                break
            row = int(row_of[col])
            rows.append(row)
        taken = [c for c in np.flatnonzero(done) if row_of[c] >= 0]
        row_price[start] += length
        for c in taken:
            row_price[row_of[c]] += length - reach[c]
            col_price[c] -= length - reach[c]
        while col >= 0:  # turn the path around
            row = int(through[col])
            free = np.flatnonzero(row_of == row)
            row_of[col] = row
            col = -1 if row == start else int(free[free != col][0])
    out = np.empty(n, int)
    out[row_of] = np.arange(n)
    return out


def matched(x: np.ndarray, bf: int, block: int = 256) -> np.ndarray:
    """Pairs along a least-cost assignment of every point to another, then pairs of pairs, until groups reach bf.

    Solved in blocks of ``block`` points that lie together along the widest axis.
    """
    groups = [[i] for i in range(len(x))]
    while len(groups) > 1 and len(groups[0]) * 2 <= bf:
        c = np.array([x[g].mean(0) for g in groups])
        made = []
        order = np.argsort(axes(c, 1)[:, 0], kind="stable")
        for at in range(0, len(order), block):
            own = order[at : at + block]
            if len(own) == 1:
                made.append(groups[own[0]])
                continue
            d = np.sqrt(_d2(c[own], c[own]))
            np.fill_diagonal(d, 1e9 * (1 + d.max()))
            to, free = assignment(d), set(range(len(own)))
            for i in range(len(own)):
                if i in free:
                    free.discard(i)
                    pair = [int(to[i])] if int(to[i]) in free else []
                    free -= set(pair)
                    made.append(sum((groups[own[j]] for j in pair), list(groups[own[i]])))
        groups = sorted(made, key=len, reverse=True)
    label = np.empty(len(x), int)
    for j, g in enumerate(groups):
        label[g] = j
    return label


def _labels(name: str, x: np.ndarray, bf: int, seed: int, head: int) -> np.ndarray:
    """The clusters of points, numbered from 0."""
    return np.unique(LOCAL[name](x, bf, np.random.default_rng(seed + 9973 * head)), return_inverse=True)[1].reshape(-1)


def _clusters(name: str, x: np.ndarray, bf: int, seed: int, head: int, block: int) -> np.ndarray:
    """The clusters of a block's points, numbered through all blocks of the head."""
    label = _labels(name, x, bf, seed, head)
    # blocks' numbers lie densely, so that a block of the next level of a tree holds several of these
    stride = BLOCK if bf < 3 else BLOCK // 2
    if label.max() >= stride:
        raise ValueError(f"{name} made more than {stride} clusters of a block")
    return block * stride + label


def _blocks(keys: DataFrame) -> DataFrame:
    return keys.select("head", "pos", "key", F.floor(F.col("pos") / BLOCK).cast("long").alias("block"))


def _points(group: pd.DataFrame) -> np.ndarray:
    return np.array(group["key"].tolist(), float).reshape(len(group), -1)


def _local(name: str) -> Callable[[DataFrame, int, int], DataFrame]:
    def assign(keys: DataFrame, bf: int, seed: int = 12345) -> DataFrame:
        def run(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("pos")
            cluster = _clusters(name, _points(group), bf, seed, int(group["head"].iloc[0]), int(group["block"].iloc[0]))
            return pd.DataFrame({"head": group["head"], "pos": group["pos"], "cluster": cluster})

        made = _blocks(keys).groupBy("head", "block").applyInPandas(run, "head int, pos bigint, cluster bigint")
        return keys.join(made, ["head", "pos"])

    return assign


def local_balls(keys: DataFrame, bf: int, names: list[str], seed: int = 12345) -> DataFrame:
    """clustering, cluster, size, center, radius of the NumPy methods ``names`` over whole heads: a task a method and head, which sends its balls and no member.

    Points are written once, a row a block, the blocks of a head one after another, and read by every method; keys are shuffled once.
    """

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        x = _points(group.sort_values("pos"))
        return pd.DataFrame({"head": [group["head"].iloc[0]], "block": [group["block"].iloc[0]], "n": [len(x)], "points": [x.tobytes()]})

    packed = cut(_blocks(keys).groupBy("head", "block").applyInPandas(pack, "head int, block bigint, n int, points binary"))
    count = max(1, packed.select("head").distinct().count())
    packed = cut(packed.repartitionByRange(count, "head").sortWithinPartitions("head", "block"))

    def balls(name: str) -> DataFrame:
        def of(head: int, held: list[np.ndarray]) -> pd.DataFrame:
            x = np.concatenate(held)
            held.clear()
            ids, label, size = np.unique(_labels(name, x, bf, seed, head), return_inverse=True, return_counts=True)
            label, c, radius = label.reshape(-1), means(x, label), np.zeros(len(ids))
            for own in _slices(len(x), x.shape[1]):
                np.maximum.at(radius, label[own], np.sqrt(((x[own] - c[label[own]]) ** 2).sum(1)))
            return pd.DataFrame({"clustering": name, "cluster": ids, "size": size, "center": list(c), "radius": radius})

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            last, held = None, []
            for frame in frames:
                for head, _, n, points in frame.itertuples(index=False):
                    if held and head != last:
                        yield of(last, held)
                    last = head
                    held.append(np.frombuffer(points).reshape(n, -1))
            if held:
                yield of(last, held)

        return packed.mapInPandas(run, "clustering string, cluster bigint, size bigint, center array<double>, radius double")

    return reduce(DataFrame.unionByName, map(balls, names))


def ml_kmeans(keys: DataFrame, bf: int, seed: int = 12345, cosine: bool = False) -> DataFrame:
    """Distributed k-means over all keys of all heads.

    Beyond MOST_FLAT centres all keys would be compared with an eighth (``bf``) as many centres, in a time that
    grows with their square.  There a k-means of few centres makes cells of about half a BLOCK, and another one
    in each of them, by a task, the clusters.  Cells of more than a BLOCK (copies, say) are dealt to several tasks by a hash.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = keys.count()
    k = max(2, _k(n, bf))
    cells = k if k <= MOST_FLAT else max(2, min(MOST_FLAT, 2 * n // BLOCK))
    rows = keys.withColumn("features", array_to_vector(vec.doubles("key")))
    model = KMeans(k=cells, seed=seed, maxIter=10, distanceMeasure="cosine" if cosine else "euclidean").fit(rows)
    found = model.transform(rows).withColumn("cluster", F.col("prediction").cast("long")).drop("features", "prediction")
    if k <= MOST_FLAT:
        return found
    own = heads(keys)
    sizes = sorted(found.groupBy("cluster").count().collect())  # at most MOST_FLAT rows
    parts = [-(-size // BLOCK) for _, size in sizes]
    first = np.cumsum([0, *parts[:-1]]).tolist()
    deal = keys.sparkSession.createDataFrame([(c, a, p) for (c, _), a, p in zip(sizes, first, parts, strict=True)], "cluster long, first_ long, parts_ long")
    dealt = found.select(*own, "pos", "key", "cluster").join(F.broadcast(deal), "cluster").withColumn("group_", F.col("first_") + F.pmod(F.xxhash64(*own, "pos"), "parts_"))
    stride = 2 * BLOCK

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([*own, "pos"])
        x, number = _points(group), int(group["group_"].iloc[0])
        label = lloyd(direction(x) if cosine else x, _k(len(x), bf), np.random.default_rng(seed + number))
        return group[[*own, "pos"]].assign(cluster=number * stride + label)

    kinds = "".join(f"{c} {keys.schema[c].dataType.simpleString()}, " for c in [*own, "pos"])
    made = dealt.repartition(sum(parts), "group_").groupBy("group_").applyInPandas(run, kinds + "cluster bigint")
    return keys.join(made, [*own, "pos"])


def random_partition(keys: DataFrame, bf: int, seed: int = 12345) -> DataFrame:
    """Hash of the position, as many buckets as a head's keys fill."""
    n = keys.groupBy("head").agg(F.ceil(F.count("*") / bf).alias("buckets"))
    return keys.join(F.broadcast(n), "head").withColumn("cluster", F.pmod(F.xxhash64("pos", F.lit(seed)), "buckets")).drop("buckets")


def _planes(dim: int, count: int, seed: int) -> list[list[float]]:
    g = np.random.default_rng(seed).standard_normal((count, dim))
    return (g / np.linalg.norm(g, axis=1, keepdims=True)).tolist()


def random_proj(keys: DataFrame, bf: int, seed: int = 12345, planes: int = 8) -> DataFrame:
    """Sides of the medians along random directions make buckets, as many as a head's keys fill; then each key goes to the nearest bucket's mean."""
    own = heads(keys)
    n = keys.groupBy(*own).agg(F.ceil(F.count("*") / bf).alias("k_"))
    most = n.agg(F.max("k_")).first()[0] or 1
    dim = len((keys.select("key").first() or [[0.0]])[0])
    directions = _planes(dim, min(planes, int(np.log2(most)) + 1), seed)
    sides = [vec.dot("key", F.array(*map(F.lit, g))) for g in directions]
    middle = keys.groupBy(*own).agg(F.ceil(F.count("*") / bf).alias("k_"), *[F.percentile_approx(x, 0.5, 10_000).alias(f"m{i}_") for i, x in enumerate(sides)])
    joined = keys.join(measured(middle), own) if own else keys.crossJoin(F.broadcast(middle))  # one row
    bucket = sum(((x > F.col(f"m{i}_")).cast("long") * (1 << i) for i, x in enumerate(sides)), F.lit(0).cast("long"))
    first = joined.withColumn("cluster", F.pmod(bucket, F.col("k_"))).select(*keys.columns, "cluster")
    return index.nearest_center(keys, index.centers(first, dim)).select(*keys.columns, "cluster")


def sort_partition(keys: DataFrame, bf: int, seed: int = 12345) -> DataFrame:
    """Rank along one random direction, cut into runs of bf."""
    dim = len((keys.select("key").first() or [[0.0]])[0])
    along = keys.withColumn("along_", vec.dot("key", F.array(*map(F.lit, _planes(dim, 1, seed)[0]))))
    ranked = running(along, heads(keys), [F.col("along_"), F.col("pos")], rank="r_")
    return ranked.withColumn("cluster", F.floor((F.col("r_") - 1) / bf).cast("long")).drop("along_", "r_")


#: Every clustering by name.
CLUSTERINGS: dict[str, Callable[..., DataFrame]] = {name: _local(name) for name in LOCAL} | {
    "ml_kmeans": ml_kmeans,
    "ml_spherical_kmeans": lambda keys, bf, seed=12345: ml_kmeans(keys, bf, seed, cosine=True),
    "random_partition": random_partition,
    "random_proj": random_proj,
    "sort_partition": sort_partition,
    "by_position": lambda keys, bf, seed=0: by_position(keys, bf),
}
