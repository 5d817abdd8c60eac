"""Queries that made a row of every query and key: what replaced the rows gives what the rows gave, and makes none."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from keelson.attend import Config, SparseIndex
from keelson.functions import vec
from keelson.operators import attention, enclosures, index, metrics, search, thresholds
from keelson.operators.blocks import against
from keelson.plans import catalog

DIM = 6


@pytest.fixture
def data(spark, tmp_path):
    """Embeddings with copies of rows, and some that are null."""
    rng = np.random.default_rng(5)

    def write(name, odd):
        x = rng.standard_normal((210, catalog.DIM))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        rows = [(i, None if odd == "null" and i % 9 == 5 else v.tolist(), 0) for i, v in enumerate(x)]
        rows += [r for r in rows if odd == "twice" and r[0] % 10 == 0]
        spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        return f"{tmp_path}/{name}"

    return write


def rows(spark, n, heads=1, seed=0):
    x = np.random.default_rng(seed).standard_normal((n, DIM))
    return spark.createDataFrame([(i % heads, i, v.tolist()) for i, v in enumerate(x)], "head int, pos long, key array<double>")


def asked(spark, n, seed=1, t=0.5):
    x = np.random.default_rng(seed).standard_normal((n, DIM))
    return spark.createDataFrame([(i, v.tolist(), t * i / n) for i, v in enumerate(x)], "query_id long, query array<double>, t double")


def got(df):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())


def no_pairs(monkeypatch):
    def never(*_, **__):
        raise AssertionError("a row a pair")

    for module in (search, enclosures, attention, catalog):
        monkeypatch.setattr(module, "against", never, raising=False)


@pytest.mark.parametrize("name", ["rotated_box", "hull_gate", "attention_nothing", "heads_attend", "query_mean_gate", "halfspace_scaled", "halfspace_grouped_heads"])
def test_no_row_a_pair(spark, data, monkeypatch, name):
    no_pairs(monkeypatch)
    assert catalog.queries()[name](spark, data("plain", None)).count() > 0


@pytest.mark.parametrize("odd", ["null", "twice"])
def test_scans_of_odd_rows(spark, data, odd):
    d = data(odd, odd)
    q, k = catalog.queries_of(spark, d), catalog.keys_of(spark, d)
    want = search.exact(search.scores(q, k), F.lit(0.2), catalog.SCALE).select("query_id", "pos", F.round("score", 6))
    assert got(catalog.halfspace_scaled(spark, d)) == got(want)
    two = catalog.queries_of(spark, d, heads=4).withColumn("kv_head", search.kv_head(F.col("q_head"), 4, 2))
    want = search.exact(search.scores(two, catalog.keys_of(spark, d, 2), F.col("head") == F.col("kv_head")), F.lit(0.1)).select("query_id", "pos", F.round("score", 6))
    assert got(catalog.halfspace_grouped_heads(spark, d)) == got(want)
    assert {r["x"] for r in catalog.attention_nothing(spark, d).collect()} == {0.0}


def test_hull(spark):
    m, q = index.by_position(rows(spark, 90), 4), asked(spark, 7)
    best = against(m, q).groupBy("query_id", "cluster", "t").agg(F.max(vec.dot("query", "key")).alias("best"))
    assert got(enclosures.hull_passes(m, q).select("query_id", "cluster")) == got(best.where(F.col("best") + vec.SLACK >= F.col("t")).select("query_id", "cluster"))


def test_ball_gate_makes_no_list_of_queries(spark, data):
    d = data("plain", None)
    assert "ids" not in catalog.ball_gate(spark, d)._jdf.queryExecution().toString()
    nodes, q = index.balls(index.by_position(rows(spark, 90), 4), DIM), asked(spark, 9, t=4)
    want = search.gate(q, nodes).select("size", F.explode("ids").alias("query_id")).groupBy("query_id").agg(F.count("*"), F.sum("size"))
    assert got(search.gate_counts(q, nodes)) == got(want)


def test_query_mean(spark):
    m, q = index.by_position(rows(spark, 90, 2), 4), asked(spark, 9, t=4)
    mean = np.mean([r["query"] for r in q.collect()], axis=0)
    mean /= np.linalg.norm(mean)
    balls = {(r["head"], r["cluster"]): r for r in index.balls(m, DIM).collect()}
    held = {}
    for r in m.collect():
        held.setdefault((r["head"], r["cluster"]), []).append(r["key"])
    want = []
    for r in q.collect():
        v, n = np.array(r["query"]), 0
        for c, x in held.items():
            along, far = np.array(x) @ mean, np.sqrt(np.maximum(0, (np.array(x) ** 2).sum(1) - (np.array(x) @ mean) ** 2)).max()
            line = max(v @ mean * along.min(), v @ mean * along.max()) + far * np.sqrt(max(0, v @ v - (v @ mean) ** 2))
            n += min(line, v @ np.array(balls[c]["center"]) + np.linalg.norm(v) * balls[c]["radius"]) + vec.SLACK > r["t"]
        want += [(r["query_id"], n)] if n else []
    assert got(enclosures.query_mean_counts(m, q, DIM)) == sorted(want)


@pytest.mark.parametrize("scaling", [1.0, 0.5, {0: 0.5, 1: 3.0}])
def test_attention_over_a_buffer(spark, scaling):
    keys = rows(spark, 80, 2).withColumn("value", F.transform("key", lambda x: x + 1))
    q = asked(spark, 6).withColumn("head", (F.col("query_id") % 2).cast("int"))
    built = SparseIndex.build(keys.where("pos < 30"), Config(dim=DIM, bf=4)).append(keys.where("pos >= 30"))
    assert got(built.attend(q, scaling)) == [(i, [pytest.approx(x) for x in v]) for i, v in got(attention.attend(built.selected(q, scaling), q, DIM, DIM**-0.5))]


@pytest.mark.parametrize("odd", [None, "null", "twice"])
def test_pages(spark, data, odd):
    d = data("pages", odd)
    q, k = catalog.queries_of(spark, d), catalog.keys_of(spark, d)
    paged = k.where("pos < 208").withColumn("page", F.floor(F.col("pos") / 16).cast("long"))
    s = against(paged, q).groupBy("query_id", "page").agg(F.max(vec.dot("query", "key")).alias("s"))
    want = s.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s"), "page"))).where("r <= 4").select("query_id", "page")
    found = attention.best_pages(q, paged, 4).withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("s"), "page"))).where("r <= 4")
    assert got(found.select("query_id", "page")) == got(want)
    none = spark.createDataFrame([(0, None), (1, None)], "query_id long, query array<float>")
    assert got(attention.best_pages(none, paged, 4).groupBy("query_id").agg(F.count("*"), F.count("s"))) == [(0, 13, 0), (1, 13, 0)]


@pytest.mark.parametrize("odd", [None, "null", "twice"])
def test_rolling(spark, data, monkeypatch, odd):
    monkeypatch.setattr(metrics, "STRETCH", 16)  # many stretches
    d = data("rolling", odd)
    s = search.scores(catalog.queries_of(spark, d), catalog.keys_of(spark, d)).select("query_id", "pos", "score")
    want = metrics.rolling(s, "score", "pos", "query_id", 3).select("query_id", "pos", *[F.round(c, 6) + 0.0 for c in ("median", "low", "high")])
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(map(tuple, catalog.rolling_scores(spark, d).collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


def test_rounding_is_that_of_the_column():
    x = np.array([0.1234565, -0.1234565, 0.0000005, -0.0000004, 1.0000005, 2.5, 0.30000049999999997])
    assert metrics.rounded(x, 6).tolist() == [0.123457, -0.123457, 0.000001, 0.0, 1.000001, 2.5, 0.3]


@pytest.mark.parametrize("odd", [None, "null", "twice"])
def test_series(spark, data, odd):
    d = data("series", odd)
    s = search.scores(catalog.queries_of(spark, d), catalog.keys_of(spark, d), F.col("pos") <= F.col("query_id")).select("query_id", "pos", (F.col("score") * 0.125).alias("score")).checkpoint()
    wide = metrics.concentration(attention.weights(s, 1.0)).select("query_id", "cov50")
    names = ("sample_max", "sample_mean_max", "budget")
    want = thresholds.online_series(s, s.where("pos % 8 = 0"), names).join(wide, "query_id").join(s.groupBy("query_id").agg(F.count("*").alias("n")), "query_id")
    found = thresholds.series_over_keys(catalog.queries_of(spark, d).withColumn("until", F.col("query_id")), catalog.keys_of(spark, d), lambda k: k.where("pos % 8 = 0"), 0.125)
    columns = ["query_id", "n", "cov50", *[f"tau_{n}" for n in names]]
    assert got(found.select(columns)) == got(want.select(columns))
