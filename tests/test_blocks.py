"""Query sets beyond one block, and small sides beyond the bound of a broadcast, give the same rows."""

import pytest

from keelson.operators import attention, blocks, search, subspace
from keelson.plans import catalog
from keelson.sources.tables import keys_of, queries_of

SMALL = "/root/testdata/sf0.01"


def rows(df):
    return sorted(repr(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("name", ["halfspace_topk", "top_k_causal", "ball_gate", "gated_search", "cluster_gate", "ta_upper", "policy_pages_box", "policy_codes", "nearest_center"])
def test_many_blocks(spark, monkeypatch, name):
    whole = rows(catalog.queries()[name](spark, SMALL))
    monkeypatch.setattr(blocks, "BLOCK", 4)
    monkeypatch.setattr(blocks, "FEW", 0)
    assert rows(catalog.queries()[name](spark, SMALL)) == whole
    spark.catalog.clearCache()


def test_each_query_lies_in_one_part(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 3)
    parts = blocks.split(queries_of(spark, SMALL))
    ids = [r["query_id"] for p in parts for r in p.select("query_id").collect()]
    assert len(parts) > 1 and sorted(ids) == sorted(r["query_id"] for r in queries_of(spark, SMALL).collect())


def test_no_queries(spark):
    none = queries_of(spark, SMALL).where("query_id < 0")
    assert search.scores(none, keys_of(spark, SMALL)).isEmpty()
    assert attention.weights(search.scores(none, keys_of(spark, SMALL)).select("query_id", "pos", "score"), 1.0).isEmpty()
    assert subspace.slices_of(none, "query", 64, 4, ("query_id",)).isEmpty()


def test_plan_broadcasts_only_what_was_counted(spark, monkeypatch):
    few = queries_of(spark, SMALL).select("query_id")
    assert "Hint broadcast" in blocks.measured(few)._jdf.queryExecution().logical().toString()
    monkeypatch.setattr(blocks, "FEW", 0)
    assert "Hint broadcast" not in blocks.measured(few)._jdf.queryExecution().logical().toString()
    spark.catalog.clearCache()
