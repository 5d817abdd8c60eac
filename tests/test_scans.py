"""Bounds as matrix products: the same passes as the expressions, for every bound."""

from pyspark.sql import functions as F

from keelson.operators import enclosures, scans
from keelson.operators.lineage import cut
from keelson.sources.tables import clustered_keys


def test_same_passes_as_the_expressions(spark):
    dim, names = 6, list(enclosures.BOUNDS)
    assert list(scans.BOUNDS) == names
    keys = cut(clustered_keys(spark, 90, dim=dim, centers=5, spread=0.8, length=2.0).withColumn("cluster", F.when(F.col("pos") < 4, F.col("pos")).otherwise(4 + F.floor(F.col("pos") / 40))))
    q = keys.where("pos % 9 = 0").select(F.col("pos").alias("query_id"), F.transform("key", lambda x: x - 0.3).alias("query"), (F.col("pos") % 7 - 2.0).alias("t"))
    q = cut(q.union(spark.createDataFrame([(1000, [0.0] * dim, 0.0), (1001, [0.0] * dim, -1.0)], "query_id long, query array<float>, t double")))
    shared = {}
    apart = cut(enclosures.summaries(keys, dim, shared=shared))
    assert "axes" not in apart.schema["pca_obb"].dataType.names and "pca_obb" in shared
    got = {(r["query_id"], r["enclosing"]): r["scanned"] for r in scans.scanned(apart, q, dim, names, shared).collect()}
    whole = cut(enclosures.summaries(keys, dim))
    want = {(r["query_id"], r["enclosing"]): r["scanned"] for r in enclosures.scanned(enclosures.passes(whole, q, dim, names), names).collect()}
    assert not {k: (got[k], want[k]) for k in want if got[k] != want[k]}
    assert len(got) == len(want) == 12 * 36 and len(set(want.values())) >= 5
    assert {(r["query_id"], r["enclosing"]): r["scanned"] for r in scans.scanned(whole, q, dim, names).collect()} == want
