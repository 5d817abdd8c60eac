"""The hierarchical neighbour graph: levels, links, recall on several numbers of shards."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.operators import metrics, search
from keelson.operators.graph import LINKS, Graph, GraphIndex, level_of
from keelson.sources.tables import clustered_keys, keys_of, queries_of


def test_levels_thin_out():
    levels = np.array([level_of(p) for p in range(50_000)])
    for lv in (1, 2, 3):
        assert abs((levels >= lv).mean() * LINKS**lv - 1) < (0.2 if lv < 3 else 0.6)


def test_links_of_one_shard():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((1500, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = Graph.build(x, [level_of(p) for p in range(1500)])
    for i, levels in enumerate(g.links):
        for lv, near in enumerate(levels):
            assert len(near) <= LINKS * (2 if lv == 0 else 1) and len(set(near)) == len(near) and i not in near
            assert all(len(g.links[j]) > lv for j in near)  # links stay on a level
    q = rng.standard_normal((40, 24))
    hits = 0
    for v in q:
        best = set(np.argsort(-(x @ v))[:10].tolist())
        hits += len(best & set(g.search(v / np.linalg.norm(v), 10, 100)))
    assert hits >= 0.9 * 400


def test_small_shards():
    assert Graph.build(np.zeros((0, 3)), []).search(np.ones(3), 5, 10) == []
    one = Graph.build(np.array([[1.0, 0.0]]), [2])
    assert one.search(np.array([0.0, 1.0]), 5, 10) == [0]
    same = Graph.build(np.tile([[1.0, 0.0]], (40, 1)), [level_of(p) for p in range(40)])
    assert len(same.search(np.array([1.0, 0.0]), 40, 64)) == 40


@pytest.mark.parametrize("shard", [150, 600, 4000])
def test_recall_by_number_of_shards(spark, shard):
    keys = clustered_keys(spark, 1800, dim=16, centers=12, spread=0.6, heads=2).drop("blob").checkpoint()
    q = keys.where("pos % 60 = 0").select(F.col("pos").alias("query_id"), "head", F.col("key").alias("query"))
    graph = GraphIndex.build(keys, shard)
    found = graph.search(q, 10)
    best = search.best(q, keys, 10)
    assert metrics.recall_at(found.select("query_id", "pos"), best.select("query_id", "pos")).agg(F.avg("recall")).first()[0] >= 0.9
    assert graph.rows.count() == 1800 and graph.shards() == 2 * -(-1800 // shard)
    assert found.join(keys, "pos").join(q.select("query_id", F.col("head").alias("h")), "query_id").where("head <> h").isEmpty()


def test_given_keys(spark):
    keys, q = keys_of(spark, "/root/testdata/sf0.001"), queries_of(spark, "/root/testdata/sf0.001")
    found = GraphIndex.build(keys).search(q, 20).select("query_id", "pos")
    assert metrics.recall_at(found, search.best(q, keys, 20).select("query_id", "pos")).agg(F.avg("recall")).first()[0] >= 0.9


def test_beams_grow_until_enough_is_found(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1200, 96))
    keys = spark.createDataFrame([(p, v.tolist()) for p, v in enumerate(x)], "pos long, key array<double>")
    q = keys.where("pos % 40 = 0").select(F.col("pos").alias("query_id"), F.col("key").alias("query"))
    graph, best = GraphIndex.build(keys), search.best(q, keys, 60).select("query_id", "pos")
    share = lambda found: metrics.recall_at(found.select("query_id", "pos"), best).agg(F.avg("recall")).first()[0]
    assert share(graph.search(q, 60, 64)) < 0.9 <= share(graph.search(q, 60))  # 64 was every search's width


def test_small_shards_are_compared_whole(spark):
    """Beams that hold a quarter of a shard's keys: the best keys are those of a full scan, over several shards a task, copies of a query included."""
    rng = np.random.default_rng(8)
    keys = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((600, 32)))], "pos long, key array<double>").checkpoint()
    q = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((30, 32)))]
    q = spark.createDataFrame([*q, q[3]], "query_id long, query array<double>").checkpoint()
    index = GraphIndex.build(keys, 150)
    assert 2 < index.shards() < 9
    found = lambda df: sorted((r["query_id"], r["pos"], r["score"]) for r in df.collect())
    assert found(index.search(q, 20)) == found(search.best(q, keys, 20))
