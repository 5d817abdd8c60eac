"""Boxes that pass without a hit: matrix passes give what the expressions give."""

import numpy as np
from pyspark.sql import functions as F

from keelson.functions import vec
from keelson.operators import enclosures, index, search
from keelson.operators.blocks import against
from keelson.sources.tables import clustered_keys


def test_useless_boxes(spark):
    keys = clustered_keys(spark, 300, dim=5, centers=6, spread=0.7, length=2.0).withColumn("cluster", F.floor(F.col("pos") / 7)).checkpoint()
    q = keys.where("pos % 6 = 0").select(F.col("pos").alias("query_id"), F.col("key").alias("query"), (F.col("pos") % 11 - 3.0).alias("t"))
    passed = against(index.centers(keys, 5), q).where(enclosures.box() + vec.SLACK > F.col("t")).select("query_id", "cluster")
    want = {r[0] for r in passed.join(enclosures.hull_passes(keys, q), ["query_id", "cluster"], "left_anti").select("cluster").distinct().collect()}
    assert {r[0] for r in enclosures.useless_boxes(keys, q).collect()} == want and want


def test_clusters_over_several_steps():
    rng = np.random.default_rng(1)
    x, cluster = np.round(rng.standard_normal((40, 3)), 1), np.repeat([3, 5, 6, 9], [1, 17, 2, 20])
    q = rng.standard_normal((6, 3))
    asked = search.Asked(np.arange(6), q, np.array([0.5, 1.0, 1.5, 2.0, 2.5, 3.0]), None)
    for step in (1, 3, 16, 40):
        state, got = {}, []
        for at in range(0, 40, step):
            got += [c for cols in enclosures._judged(asked, x[at : at + step], cluster[at : at + step], state) for c in cols["cluster"]]
        got += [c for cols in enclosures._complete(asked, state["cluster"], *(state[c][None] for c in ("best", "lo", "hi"))) for c in cols["cluster"]]
        want = []
        for c in (3, 5, 6, 9):
            own = x[cluster == c]
            bound, best = np.maximum(q * own.min(0), q * own.max(0)).sum(1), (own @ q.T).max(0)
            want += [c] * bool(((bound > asked.limits) & (best < asked.limits)).any())
        assert got == want
