import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.llm import importance, queries

SMALL = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def drawn(docs, target):
    """The contract by plain reading: sorted(doc_id, n_features, weight, score, rank)."""
    found = [(i, *features(t)) for i, t in docs]
    raw, aim = Counter(b for _, _, f in found for b in f), Counter(b for t in target for b in features(t)[1])
    s_all, t_all = sum(raw.values()), sum(aim.values())
    gain = lambda b: math.floor(1000 * math.log((aim[b] + 1) * (s_all + 10000) / ((raw[b] + 1) * (t_all + 10000))))
    rows = []
    for i, words, f in found:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        rows.append((i, words, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0]))
    ranks = {r[0]: k + 1 for k, r in enumerate(able[: 5 * len(able) // 100])}
    return sorted((i, n, w, s, ranks.get(i)) for i, _, n, w, s in rows)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_against_plain_reading(spark, sf):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '/root/testdata/{sf}/documents.parquet'").fetchall()
    target = [r[0] for r in duckdb.sql(f"SELECT text FROM '/root/testdata/{sf}/benchmark.parquet'").fetchall()]
    got = queries.op12_importance(spark, f"/root/testdata/{sf}")
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in got.dtypes} == {"bigint"}
    assert sorted(map(tuple, got.collect())) == drawn(docs, target)


def test_ranks_of_equal_scores(spark):
    """Few scores with many documents each, over several ranges of scores: ties go to smaller ids."""
    rng = np.random.default_rng(5)
    rows = [(i, 25, int(s)) for i, s in enumerate(rng.integers(0, 12, 3000))] + [(9000 + i, 3, 50) for i in range(10)]
    scored = spark.createDataFrame(rows, "doc_id long, n_words long, score long").repartition(7)
    for share in (0, 1, 5, 37, 100):
        got = {r["doc_id"]: r["rank"] for r in importance.draw_highest(scored, share).collect()}
        order = [i for i, w, s in sorted(rows, key=lambda r: (-r[2], r[0])) if w >= 20][: share * 3000 // 100]
        assert len(got) == len(rows) and {i: r for i, r in got.items() if r} == {i: k + 1 for k, i in enumerate(order)}


def test_blocks_of_a_text(monkeypatch):
    text = "One two,three FOUR  five sïx \x00 seven 8 nine " * 50
    whole = sorted(features(text)[1])
    for step in (1, 7, 64, 1 << 20):
        monkeypatch.setattr(importance, "STEP", step)
        blocks = list(importance.bucket_blocks(text))
        assert sorted(b for _, found in blocks for b in found.tolist()) == whole and sum(n for n, _ in blocks) == features(text)[0]
    assert list(importance.bucket_blocks(None)) == list(importance.bucket_blocks("")) == []


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "  ...  "), (4, "word " * 30_000), (5, "a b c " * 10), (5, "a b c " * 10), (6, "x" * 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "score", "weight", "rank", "n_words", "bucket")})
    target = spark.createDataFrame([(1, None), (2, ""), (3, "a b c d")], "item_id long, text string")
    got = sorted(tuple(r) for r in importance.importance_report(docs, target).select("doc_id", "n_features", "weight", "score").collect())
    assert got == [r[:4] for r in drawn(rows, [None, "", "a b c d"])]
    assert importance.importance_report(docs.limit(0), target).collect() == []
    assert importance.importance_report(docs, target.limit(0)).count() == len(rows)
    odd = docs.unionByName(docs.withColumn("doc_id", F.lit(None).cast("long")))
    ranks = sorted(r["rank"] for r in importance.importance_draw(odd, target, share=100).collect() if r["rank"])
    assert ranks == list(range(1, 7))


def test_the_draw_leans_to_the_target(spark):
    docs = spark.createDataFrame([(i, " ".join(f"{'near' if i % 10 == 0 else 'far'}{(i * 7 + k) % 40}" for k in range(30))) for i in range(400)], "doc_id long, text string")
    target = spark.createDataFrame([(i, " ".join(f"near{(i * 5 + k) % 40}" for k in range(30))) for i in range(20)], "item_id long, text string")
    picked = [r["doc_id"] for r in importance.importance_draw(docs, target).where("rank is not null").collect()]
    assert len(picked) == 20 and all(i % 10 == 0 for i in picked)
