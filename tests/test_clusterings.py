"""Clusterings at sizes where a row a pair, or all keys against all centres, would not end."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.sql import functions as F

from keelson.operators import clusterings, index, search
from keelson.sources.tables import keys_of, queries_of

D, DIM = "/root/testdata/sf0.001", 64


def test_distributed_k_means_compares_keys_with_few_centres(spark, monkeypatch):
    monkeypatch.setattr(clusterings, "MOST_FLAT", 5)
    monkeypatch.setattr(clusterings, "BLOCK", 128)
    asked, plain = [], KMeans.fit
    monkeypatch.setattr(KMeans, "fit", lambda self, rows: asked.append(self.getK()) or plain(self, rows))
    keys = keys_of(spark, D).select("head", "pos", "key")
    for name in ("ml_kmeans", "ml_spherical_kmeans"):
        got = clusterings.CLUSTERINGS[name](keys, 4).cache()
        assert sorted(r["pos"] for r in got.select("pos").collect()) == sorted(r["pos"] for r in keys.select("pos").collect())
        found = got.select("cluster").distinct().count()
        assert keys.count() / 4 * 0.8 <= found <= keys.count() / 4 + 20
        near, runs = (index.balls(m, DIM).agg(F.avg("radius")).first()[0] for m in (got, index.by_position(keys, 4)))
        assert near < runs
    assert max(asked) <= 5


def test_copies_of_one_key_leave_no_cell_that_a_task_takes_whole(spark, monkeypatch):
    monkeypatch.setattr(clusterings, "MOST_FLAT", 5)
    monkeypatch.setattr(clusterings, "BLOCK", 64)
    rows = [(0, i, [1.0, 2.0] if i % 4 else [float(i), -float(i)]) for i in range(400)]
    keys = spark.createDataFrame(rows, "head int, pos long, key array<float>")
    got = clusterings.ml_kmeans(keys, 4)
    assert got.count() == 400 and got.select("pos").distinct().count() == 400
    groups = got.where("pos % 4 > 0").select((F.col("cluster") / 128).cast("long")).distinct().count()
    assert groups >= 4  # 300 copies, 64 a task or so


@pytest.mark.parametrize("name", ["kmeans", "kcenter_lp", "linf_nn", "balanced_kmeans", "pq_span"])
def test_balls_of_blocks_are_those_of_their_members(spark, name):
    keys = keys_of(spark, D).select("head", "pos", "key")
    got = {r["cluster"]: r for r in clusterings.local_balls(keys, 8, [name]).collect()}
    want = {r["cluster"]: r for r in index.balls(clusterings.CLUSTERINGS[name](keys, 8), DIM).collect()}
    assert got.keys() == want.keys()
    for c, r in want.items():
        assert got[c]["clustering"] == name and got[c]["size"] == r["size"]
        assert np.allclose(got[c]["center"], r["center"], atol=1e-12) and abs(got[c]["radius"] - r["radius"]) < 1e-12


def test_totals_of_a_gate_are_those_of_its_lists(spark, monkeypatch):
    from keelson.operators import blocks

    monkeypatch.setattr(blocks, "BLOCK", 4)  # several blocks of queries
    keys = keys_of(spark, D).select("head", "pos", "key")
    nodes = None
    for name, bf in (("a", 4), ("b", 16)):
        made = index.balls(index.by_position(keys, bf), DIM).select(F.lit(name).alias("clustering"), "size", "center", "radius")
        nodes = made if nodes is None else nodes.unionByName(made)
    asked = queries_of(spark, D).select("query_id", "query").withColumn("t", F.lit(0.2) + F.col("query_id") % 7 * 0.1)
    want = {r[0]: r[1] for r in search.gate(asked, nodes).groupBy("clustering").agg(F.sum(F.col("size") * F.size("ids"))).collect()}
    got = {r["clustering"]: r for r in search.gate_totals(asked, nodes, "clustering").collect()}
    n = keys.count()
    assert {c: r["seen"] for c, r in got.items()} == want and all(r["keys"] == n for r in got.values())
    assert got["a"]["clusters"] == -(-n // 4) and got["b"]["clusters"] == -(-n // 16)


@pytest.mark.parametrize("order", [1, 2, np.inf])
@pytest.mark.parametrize("shift", [0.0, 1e4])
def test_nearest_other_is_exact_among_copies_and_near_ties(order, shift):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((150, 6)).round(1) + shift
    x[100:] = x[:50]
    x[:20] += 1e-9
    free = np.flatnonzero(rng.random(150) < 0.8)
    best, far = clusterings._nearest_other(x, free, free, order)
    for i, b, f in zip(free, best, far, strict=True):
        d = []
        for k in free:
            gap = np.abs(x[i] - x[k])
            d.append(np.inf if k == i else gap.max() if order == np.inf else np.cumsum(gap if order == 1 else gap * gap)[-1])
        assert free[int(np.argmin(d))] == b and min(d) == f


@pytest.mark.parametrize("name", ["kmeans", "batch_nn", "linf_nn", "balanced_kcenter", "ball_ratio_kmeans"])
def test_a_comparison_looks_at_whole_heads(spark, monkeypatch, name):
    """Pairs of keys lie a block apart: a method that saw one block at a time would have no ball of radius 0.01."""
    monkeypatch.setattr(clusterings, "BLOCK", 64)
    x = np.random.default_rng(1).standard_normal((64, 5)) * 10
    rows = [(h, i, (x[i % 64] + (0.01 if i >= 64 else 0) + 100 * h).tolist()) for h in (0, 1) for i in range(128)]
    keys = spark.createDataFrame(rows, "head int, pos long, key array<double>")
    got = clusterings.local_balls(keys, 2, [name]).collect()
    assert sum(r["size"] for r in got) == 256
    want = np.concatenate([np.bincount(clusterings.LOCAL[name](np.array([r[2] for r in rows if r[0] == h]), 2, np.random.default_rng(12345 + 9973 * h))) for h in (0, 1)])
    assert sorted(r["size"] for r in got) == sorted(n for n in want.tolist() if n)
    assert sum(r["size"] == 2 and r["radius"] < 0.02 for r in got) >= 50


@pytest.mark.parametrize("name", ["kmeans", "kcenter_meb", "ball_ratio_kcenter", "balanced_kmeans", "gmm_diag", "pq_balanced_span"])
def test_few_distances_at_a_time_give_the_same(monkeypatch, name):
    x = np.random.default_rng(4).standard_normal((300, 8))
    want = clusterings.LOCAL[name](x, 8, np.random.default_rng(0))
    monkeypatch.setattr(clusterings, "CHUNK", 1000)
    assert (clusterings.LOCAL[name](x, 8, np.random.default_rng(0)) == want).all()
