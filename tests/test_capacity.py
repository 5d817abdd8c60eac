"""Clusters of a bounded size: the stable outcome by plain deferred acceptance, heads, blocks of centres, empty centres."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.operators import capacity

DIM = 5


def rows(spark, n, heads=1, seed=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.standard_normal((n, DIM)) + 5 * (rng.random((n, 1)) < 0.3), 1)  # a third of the keys in one place, and ties
    return spark.createDataFrame([(i % heads, i, v.tolist()) for i, v in enumerate(x)], "head int, pos long, key array<double>")


def accepted(keys, centers, bf):
    """Deferred acceptance, one proposal at a time: {pos: cluster}."""
    out = {}
    for h in {k["head"] for k in keys}:
        own = {k["pos"]: np.array(k["key"]) for k in keys if k["head"] == h}
        c = sorted(((r["cluster"], np.array(r["center"])) for r in centers if r["head"] == h), key=lambda x: x[0])
        far = {p: [(_distance(v, w), j) for j, w in c] for p, v in own.items()}
        lists, held, todo = {p: sorted(d) for p, d in far.items()}, {}, list(own)
        while todo:
            p = todo.pop()
            d, j = lists[p].pop(0)
            held.setdefault(j, []).append((d, p))
            if len(held[j]) > bf:
                worst = max(held[j])
                held[j].remove(worst)
                todo.append(worst[1])
        out |= {p: j for j, group in held.items() for _, p in group}
    return out


def _distance(a, b):
    total = 0.0
    for x, y in zip(a, b, strict=True):
        total += (x - y) ** 2
    return total**0.5


@pytest.mark.parametrize(("heads", "block"), [(1, 1 << 14), (2, 7)])
def test_stable_outcome(spark, monkeypatch, heads, block):
    monkeypatch.setattr(capacity, "BLOCK_CENTERS", block)
    keys = rows(spark, 60, heads)
    centers = keys.where("pos % 3 = 0").select("head", F.col("pos").alias("cluster"), F.col("key").alias("center")).checkpoint()
    got = {r["pos"]: r["cluster"] for r in capacity.matched(keys, centers, 3).collect()}
    assert got == accepted(keys.collect(), centers.collect(), 3)
    assert max(np.unique(list(got.values()), return_counts=True)[1]) <= 3


def test_a_head_larger_than_a_block(spark):
    """9,000 keys, no room to spare: no cluster above its size, and no pair that would rather swap (checked on every key)."""
    rng = np.random.default_rng(2)
    x = rng.standard_normal((9_000, 2))
    keys = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "pos long, key array<double>").checkpoint()
    centers = capacity.trained_centers(keys, 1500, 2, 1).checkpoint()
    got = capacity.matched(keys, centers, 1500).toPandas().sort_values("pos")
    c = np.array([r["center"] for r in centers.orderBy("cluster").collect()])
    assert len(got) == 9_000 and got["cluster"].value_counts().max() == 1500 and len(c) == 6
    d = np.linalg.norm(x[:, None] - c[None], axis=2)
    mine, worst = got["distance"].to_numpy(), got.groupby("cluster")["distance"].max().reindex(range(6), fill_value=np.inf).to_numpy()
    assert not ((d < mine[:, None] - 1e-12) & (d < worst[None] - 1e-12)).any()


def test_empty_centres_become_the_farthest_keys(spark):
    same = [(i, [0.0, 0.0]) for i in range(30)] + [(30, [9.0, 0.0]), (31, [0.0, 7.0])]
    keys = spark.createDataFrame(same, "pos long, key array<double>")
    centers = capacity.trained_centers(keys, 4, 2, 3)
    got = [r["center"] for r in centers.collect()]
    assert len(got) == 8 and [9.0, 0.0] in got and [0.0, 7.0] in got
    placed = capacity.bounded(keys, 4, 2, 3)
    assert placed.columns == ["pos", "key", "cluster"] and placed.count() == 32 and placed.groupBy("cluster").count().agg(F.max("count")).first()[0] == 4
    assert capacity.matched(keys.limit(0), centers, 4).collect() == []


def test_keys_without_room_are_left_out(spark):
    keys = spark.createDataFrame([(i, [float(i)]) for i in range(7)], "pos long, key array<double>")
    centers = spark.createDataFrame([(0, [0.0]), (1, [6.0])], "cluster long, center array<double>")
    got = {r["pos"]: r["cluster"] for r in capacity.matched(keys, centers, 2).collect()}
    assert got == {0: 0, 1: 0, 6: 1, 5: 1}


@pytest.mark.parametrize("heads", [1, 2])
def test_what_is_left_is_settled_at_once(spark, monkeypatch, heads):
    """The last keys in one task, or round by round: the same outcome; and no broadcast outlives its pass."""
    from pyspark import Broadcast

    keys, ended, destroy = rows(spark, 40, heads, 4).checkpoint(), [], Broadcast.destroy
    monkeypatch.setattr(Broadcast, "destroy", lambda self, *a: (ended.append(1), destroy(self, *a)))
    centers = keys.where("pos % 8 < 2").select("head", F.col("pos").alias("cluster"), F.col("key").alias("center")).checkpoint()
    same = lambda df: sorted((r["pos"], r["cluster"], round(r["distance"], 12)) for r in df.collect())
    at_once = same(capacity.matched(keys, centers, 4))
    assert not ended
    monkeypatch.setattr(capacity, "FINISH", 0)
    assert same(capacity.matched(keys, centers, 4)) == at_once and len(at_once) == 40 and len(ended) > 2


def test_positions_that_come_twice(spark):
    """Rows of a position are settled together, round by round, also when no centre has room for the last ones."""
    keys = spark.createDataFrame([(i // 2, [float(i // 2)]) for i in range(12)], "pos long, key array<double>")
    centers = spark.createDataFrame([(0, [0.0]), (1, [5.0])], "cluster long, center array<double>")
    got = capacity.matched(keys, centers, 4).collect()
    assert {(r["pos"], r["cluster"]) for r in got} == {(0, 0), (5, 1)}
