"""Gathers from a bucketed store, and snapshots under updates."""

import uuid

import pytest
from pyspark.sql import functions as F

from keelson.sources import tables
from keelson.streaming.state import VersionedIndex


def exchanges_above(plan, marker):
    """Exchanges between the scan that holds ``marker`` and the join."""
    lines = plan.split("\n")
    at = next(i for i, x in enumerate(lines) if "FileScan" in x and marker in x)
    depth, found = lines[at].index("FileScan"), 0
    for x in reversed(lines[:at]):
        here = len(x) - len(x.lstrip(" :+-*()0123456789"))
        if here < depth:
            depth = here
            if "Join" in x:
                return found
            found += "Exchange" in x
    raise AssertionError("no join above the scan")


def test_stored_keys_are_not_shuffled(spark):
    keys = spark.range(2000).select(F.col("id").alias("pos"), F.array(F.col("id").cast("double")).alias("value"))
    name = f"far_{uuid.uuid4().hex}"
    stored = tables.store_by_position(keys, name, 8)
    selected = spark.range(300).select(F.col("id").alias("query_id"), (F.col("id") * 7 % 2500).alias("pos"))
    got = tables.gather(selected, stored)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and exchanges_above(plan, "value") == 0 and plan.count("Exchange hashpartitioning") == 1
    assert sorted((r["query_id"], r["value"][0]) for r in got.collect()) == [(i, float(i * 7 % 2500)) for i in range(300) if i * 7 % 2500 < 2000]
    with pytest.raises(ValueError, match="value"):
        tables.gather(selected.withColumn("value", F.lit(1)), stored)
    spark.sql(f"DROP TABLE {name}")


def test_heads_are_part_of_the_gather(spark):
    keys = spark.createDataFrame([(h, p, float(10 * h + p)) for h in range(2) for p in range(5)], "head int, pos long, v double")
    name = f"far_{uuid.uuid4().hex}"
    got = tables.gather(spark.createDataFrame([(7, 1, 3), (7, 0, 4)], "query_id long, head int, pos long"), tables.store_by_position(keys, name, 2))
    assert sorted(r["v"] for r in got.collect()) == [4.0, 13.0]
    spark.sql(f"DROP TABLE {name}")


def test_snapshots_under_updates(spark, tmp_path):
    index = VersionedIndex(spark, str(tmp_path / "ix"))
    assert index.read() is None and index.versions() == [] and index.vacuum() == []
    rows = lambda v: spark.createDataFrame([(v * 10 + i,) for i in range(3)], "pos long")
    opened = {}
    for v in range(4):
        index.publish(rows(v), v)
        opened[v] = index.read()
    rows(9).withColumn("version", F.lit(9)).write.parquet(str(tmp_path / "ix/rows/9"))  # written, never published
    index.compact()
    index.compact()  # nothing more to do
    assert index.folders() == ["compact/3"] and index.versions() == [0, 1, 2, 3]
    index.publish(rows(4), 4)
    index.publish(rows(7), 4)  # a replay
    assert index.folders() == ["compact/3", "rows/4"] and index.folders(upto=2) == ["rows/0", "rows/1", "rows/2"]
    for v, o in opened.items():
        assert o.count() == 3 * (v + 1)  # what it saw when it was opened
    assert sorted(r["pos"] for r in index.read().collect()) == [v * 10 + i for v in range(5) for i in range(3)]
    assert sorted(index.vacuum()) == [f"rows/{v}" for v in range(4)] and index.read().count() == 15
    assert index.search_view(spark.createDataFrame([(99,)], "pos long")).count() == 16
