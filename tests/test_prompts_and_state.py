"""Prompts made by the tasks that read them; heavy hitters with a state entry a position."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from keelson.sources import prompts, tables
from keelson.streaming import state


@pytest.mark.parametrize("kind", prompts.KINDS)
def test_same_prompts_in_any_partitions(spark, kind):
    few, many = (tables.retrieval_prompts(spark, 5000, kind, filler=20, rows=r) for r in (5000, 130))
    assert few.rdd.getNumPartitions() == 1 and many.rdd.getNumPartitions() == 39
    digest = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.countDistinct("prompt_id")).first()
    assert digest(few) == digest(many) and digest(few)[0] == digest(few)[2] == 5000
    assert all(a in r["context"] for r in few.limit(20).collect() for a in r["answers"])
    assert tables.retrieval_prompts(spark, 20, kind, filler=20, seed=1).where("prompt_id = 3").first() != few.where("prompt_id = 3").first()


def test_many_prompts_stay_on_executors(spark):
    df = tables.retrieval_prompts(spark, 300_000, "single", filler=2)
    assert df.rdd.getNumPartitions() == 30 and df.agg(F.max("prompt_id"), F.count("*")).first() == (299_999, 300_000)
    assert tables.retrieval_prompts(spark, 0).collect() == []
    with pytest.raises(ValueError, match="kind"):
        tables.retrieval_prompts(spark, 1, "other")


def kept_by_hand(rows, heavy, recent):
    out = {}
    for head in {r[0] for r in rows}:
        cache, last = {}, -1
        for step in sorted({r[1] for r in rows if r[0] == head}):
            add = {}
            for h, s, p, w in rows:
                if (h, s) == (head, step):
                    add[p] = add.get(p, 0) + w
            add = {p: w for p, w in add.items() if p in cache or p > last}
            cache = {p: cache.get(p, 0) + add.get(p, 0) for p in cache.keys() | add.keys()}
            last = max([last, *cache])
            old = sorted((p for p in cache if p <= last - recent), key=lambda p: (-cache[p], p))
            cache = {p: w for p, w in cache.items() if p not in old[heavy:]}
            out[head, step] = (sorted(cache), sum(cache.values()))
    return out


def test_heavy_hitters_over_several_triggers(spark, tmp_path):
    """State goes on from trigger to trigger; positions that were dropped never come back."""
    rows = [(h, s, p, float((s * 31 + p * 17 + h) % 23)) for h in range(2) for s in range(24) for p in range(max(0, s - 9), s + 1)]
    for i in range(4):
        batch = [r for r in rows if r[1] // 6 == i]
        spark.createDataFrame(pd.DataFrame(batch, columns=["head", "step", "pos", "p"]).sample(frac=1, random_state=i), "head int, step long, pos long, p double").coalesce(1).write.parquet(str(tmp_path / f"in/b={i}"))
    src = spark.readStream.schema("head int, step long, pos long, p double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    before = spark.conf.get(state.STORE[0])
    spark.conf.set(*state.STORE)
    try:
        state.heavy_hitters(src, 3, 4).writeStream.format("memory").queryName("heavy").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(state.STORE[0], before)
    got = {(r["head"], r["step"]): (r["kept"], r["mass"]) for r in spark.table("heavy").collect()}
    assert got == kept_by_hand(rows, 3, 4)
