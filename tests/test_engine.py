"""Properties: bounds are safe, gates lose nothing, updates agree with rebuilds, state follows its rules."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.attend import ATTENTIONS, Config, SparseIndex, dense
from keelson.functions import registry, text, vec
from keelson.operators import attention, blocks, clusterings, enclosures, index, metrics, ranks, search, subspace, thresholds
from keelson.sources import tables
from keelson.streaming import state

DIM = 16


@pytest.fixture(scope="module")
def keys(spark):
    k = tables.clustered_keys(spark, 400, DIM, centers=12, heads=1).drop("blob")
    return k.withColumn("value", F.transform("key", lambda x: x.cast("double") * 0.5 + 0.25)).cache()


@pytest.fixture(scope="module")
def asked(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.standard_normal(DIM) * (0.2 + i)).tolist()) for i in range(6)] + [(6, [0.0] * DIM)]
    return spark.createDataFrame(rows, "query_id long, query array<double>").cache()


def arrays(df, column="key"):
    rows = sorted(df.select("pos", column).collect())
    return np.array([r[1] for r in rows], float)


def test_every_bound_is_safe(keys, asked, spark):
    """No member's score exceeds its cluster's bound, for long, zero and opposite queries, and for single members."""
    opposite = spark.createDataFrame([(7, (-np.array(keys.first()["key"])).tolist())], "query_id long, query array<double>")
    queries = asked.union(opposite)
    for bf in (1, 8):
        members = index.by_position(keys, bf)
        summary = enclosures.summaries(members, DIM)
        bounds = summary.crossJoin(F.broadcast(queries)).select("query_id", "cluster", *[b(DIM).alias(n) for n, b in enclosures.BOUNDS.items()])
        best = members.crossJoin(F.broadcast(queries)).groupBy("query_id", "cluster").agg(F.max(vec.dot("query", "key")).alias("best"))
        joined = bounds.join(best, ["query_id", "cluster"])
        slack = F.lit(1e-6) * (1 + F.abs("best"))
        bad = joined.agg(*[F.count_if(~(F.col(n) + slack >= F.col("best"))).alias(n) for n in enclosures.BOUNDS]).first().asDict()
        assert not any(bad.values()), (bf, {n: c for n, c in bad.items() if c})


def test_rotation_keeps_products(keys):
    basis = enclosures.principal_basis(keys, "key", DIM)
    assert np.allclose(basis @ basis.T, np.eye(DIM), atol=1e-8)
    a, b = arrays(keys), arrays(enclosures.rotated(keys, "key", basis))
    assert np.allclose(a @ a.T, b @ b.T, atol=1e-6)
    assert (np.diff(b.var(axis=0)) <= 1e-6).all()


def test_gates_prune_clustered_data(spark):
    keys = tables.clustered_keys(spark, 1200, DIM, centers=10)
    grouped = clusterings.CLUSTERINGS["kmeans"](keys, 60)
    nodes = index.balls(grouped, DIM)
    q = keys.where("pos < 5").select(F.col("pos").alias("query_id"), vec.unit("key").alias("query"))
    q = q.join(thresholds.kth_best(search.scores(q, keys), 20), "query_id").cache()
    found = search.gated(q, nodes, grouped, emit="candidates")
    assert found.count() / (1200 * 5) < 0.55
    exact = {(r[0], r[1]) for r in search.exact(search.scores(q, keys), F.col("t")).select("query_id", "pos").collect()}
    assert exact == {(r[0], r[1]) for r in search.gated(q, nodes, grouped).select("query_id", "pos").collect()}


@pytest.mark.parametrize("name", sorted(clusterings.CLUSTERINGS))
def test_clusterings_cover_every_key(keys, name):
    got = clusterings.CLUSTERINGS[name](keys.select("head", "pos", "key").where("pos < 64"), 4).select("pos", "cluster").collect()
    assert sorted(r[0] for r in got) == list(range(64)) and all(r[1] is not None for r in got)
    sizes = np.unique([r[1] for r in got], return_counts=True)[1]
    if name.startswith(("balanced", "batch", "by_position", "l1_", "linf_nn", "nn_", "sort", "pca_axis", "pca_morton_chunk", "proj", "recursive", "fast", "pca_tree", "pca_bisect", "weighted")):
        assert sizes.max() <= 4


def test_tree_radii_enclose_keys(keys):
    nodes, leaves = index.tree(keys, DIM, 4, 3)
    assert {r[0]: r[1] for r in nodes.groupBy("level").count().collect()} == {1: 100, 2: 25, 3: 7}
    for level in (1, 2, 3):
        own = nodes.where(F.col("level") == level)
        far = leaves.withColumn("node", F.floor(F.col("pos") / 4**level)).join(own.select("node", "center", "radius"), "node")
        assert far.where(vec.distance("key", "center") > F.col("radius") + 1e-9).count() == 0


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_descent_is_exact(keys, asked, levels):
    q = asked.join(thresholds.kth_best(search.scores(asked, keys), 7), "query_id").cache()
    nodes, leaves = index.tree(keys, DIM, 4, levels)
    hits = search.descend(q, nodes, leaves, levels)
    want = search.exact(search.scores(q, keys), F.col("t")).select("query_id", "pos")
    assert hits.select("query_id", "pos").exceptAll(want).count() == 0 and want.exceptAll(hits.select("query_id", "pos")).count() == 0


def test_level_sizes():
    assert index.level_sizes(100, 4) == [100, 25, 6, 1] and index.level_sizes(100, 4, 2) == [100, 25] and index.level_sizes(3, 8) == [3]


def test_arrivals_fill_rooms_first(keys):
    old = index.centers(index.by_position(keys.where("pos < 40"), 4), DIM)
    placed, orphans = index.place_arrivals(old, keys.where("pos BETWEEN 40 AND 99").select("pos", "key"), 6)
    sizes = placed.groupBy("cluster").count().collect()
    assert placed.count() + orphans.count() == 60 and all(r[1] <= 2 for r in sizes)
    assert all(r["cluster"] >= 10 and r["count"] <= 6 for r in orphans.groupBy("cluster").count().collect())


def test_numbering(spark):
    got = index.numbered(spark.range(0, 500, 1, 7), "id").orderBy("id").select("id", "n").collect()
    assert [(r[0], r[1]) for r in got] == [(i, i + 1) for i in range(500)]


def test_heads_must_divide():
    with pytest.raises(ValueError):
        search.kv_head(F.lit(1), 6, 4)


def test_halfspace_blocks(keys, asked, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 2)
    q = asked.withColumn("t", F.lit(1.0))
    got = {(r[0], r[1]) for r in search.halfspace_blocks(q, keys).select("query_id", "pos").collect()}
    s = arrays(asked.withColumnRenamed("query_id", "pos"), "query") @ arrays(keys).T
    assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero(s >= 1.0))}


def test_index_updates(keys, asked):
    config = Config(dim=DIM, k=9)
    first = SparseIndex.build(keys.where("pos < 200"), config)
    waiting = first.append(keys.where("pos >= 200"))
    assert first.buffer is None and waiting.metrics().first()["n_buffered"] == 200
    outputs = []
    for x in (waiting, waiting.update(), waiting.configured(mode="full").update(), SparseIndex.build(keys, config)):
        found = {(r["query_id"], r["pos"]) for r in x.with_thresholds(asked).join(search.scores(asked, keys).select("query_id", "pos", "score"), "query_id").where("score >= t").collect()}
        hits = {(r[0], r[1]) for r in x.selected(x.with_thresholds(asked)).select("query_id", "pos").collect()}
        assert found <= hits
        outputs.append(found)
    assert all(o == outputs[0] for o in outputs)
    assert waiting.update().version == 1 and waiting.update().buffer is None
    with pytest.raises(ValueError):
        waiting.configured(exact_flush=True).update()


def test_attention(keys, asked):
    q, k, v = arrays(asked.withColumnRenamed("query_id", "pos"), "query"), arrays(keys), arrays(keys, "value")
    s = q @ k.T * 0.25
    p = np.exp(s - s.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    got = {r[0]: r[1] for r in dense(asked, keys, DIM, 0.25).collect()}
    assert all(np.allclose(got[i], (p @ v)[i], atol=1e-9) for i in range(len(q)))
    none = attention.attend(search.scores(asked, keys).select("query_id", "pos", "score", "value").where("score > 1e9"), asked, DIM, 0.25)
    assert all(r[1] == [0.0] * DIM for r in none.collect()) and none.count() == 7
    full = {r[0]: r[1] for r in SparseIndex.build(keys, Config(dim=DIM, scale=0.25)).attend(asked.withColumn("t", F.lit(float("-inf")))).collect()}
    assert all(np.allclose(full[i], got[i], atol=1e-9) for i in got)
    for name in ATTENTIONS:
        assert ATTENTIONS[name](asked, keys, Config(dim=DIM)).count() == 7


def test_threshold_edges(spark):
    rows = spark.createDataFrame([(0, i, float(s)) for i, s in enumerate([3, 3, 1])] + [(1, 0, -2.0)], "query_id long, pos long, score double")
    assert dict(thresholds.kth_best(rows, 64).collect()) == {0: 1.0, 1: -2.0}
    assert thresholds.kth_best(rows, 3, strict=True).collect() == [(0, 1.0)]
    assert {r[0]: r[1] for r in thresholds.sample_max(rows).collect()} == {0: 3.0, 1: -2.0}
    assert {r[1] for r in thresholds.full_search(rows).collect()} == {float("-inf")}


def test_recall_of_nothing_is_one(spark):
    none = spark.createDataFrame([], "query_id long, pos long")
    got = metrics.recall_at(spark.createDataFrame([(1, 5)], "query_id long, pos long"), none).collect()
    assert [tuple(r) for r in got] == [(1, 1.0, 1)]


def test_scorers(spark):
    rows = [("The cat, sat!", ["cat sat"], r"so \boxed{12}"), ("", [""], "the answer is 7, not 8"), ("dog", ["a cat"], "3 then -4.5"), (None, ["x"], "none"), ("x-a-b the", ["xb"], "answer: 4321, so 17")]
    df = spark.createDataFrame(rows, "p string, g array<string>, a string")
    got = df.select(text.best_f1(F.col("p"), F.col("g")), text.contains_answer(F.col("p"), F.col("g")), text.competition_answer(F.col("a"))).collect()
    # two empty texts have nothing in common; articles go before punctuation; numbers above 999 are no answers
    assert [tuple(r) for r in got] == [(1.0, True, "12"), (0.0, True, "7"), (0.0, False, "5"), (0.0, False, None), (0.0, False, "17")]
    assert text.boxed_of(r"a \boxed{1} b \boxed{\frac{1}{2}} c") == r"\frac{1}{2}" and text.boxed_of("x") is None and text.boxed_of(r"\boxed{1") == "1"
    assert text.boxed_of(r"\boxed{3} } \boxed{4") == "3" and text.boxed_of(r"\boxed{ \boxed{5} }") == "5"
    forms = {r"\left( \dfrac{1}{2} \right).": r"(\frac{1}{2}).", "007": "7", "3.50": "3.5", r"\text{Yes No}": "yesno", " ": "0", r"\bigg(X)": "g(x)", None: None}
    got = spark.createDataFrame([(x,) for x in forms], "a string").select("a", text.normalised_math(F.col("a"))).collect()
    assert dict(map(tuple, got)) == forms
    said = {"Answer is 0042.": "42", "so, 12 of 2000": "12", "it is __77__ ": "77", "x 12345": None, "1234 5678 and 007": "7"}
    got = dict(map(tuple, spark.createDataFrame([(x,) for x in said], "a string").select("a", text.competition_answer(F.col("a"))).collect()))
    assert got == said
    tasks = spark.createDataFrame([("qasper", "a b c d", ["b c", "z"]), ("trec", "It is B, then", ["b then"])], "t string, p string, g array<string>")
    assert [r[0] for r in tasks.select(text.task_score(F.col("t"), F.col("p"), F.col("g"))).collect()] == [0.8, 1.0]


def test_registry(spark):
    assert set(registry.register(spark)) == set(registry.FUNCTIONS)
    q = "array(1D, -2D)"
    got = spark.sql(f"SELECT vec_dot({q}, array(3D, 4D)), vec_norm(array(3D, 4D)), ball_bound({q}, array(0D, 0D), 2D), box_bound({q}, array(0D, 1D), array(2D, 5D))").first()
    assert tuple(got) == (-5.0, 5.0, 2 * 5**0.5, 0.0)


def test_config(tmp_path):
    (tmp_path / "c.yml").write_text("bf: 8  # children\nexact_flush: true\nscale: 0.5\nmode: 'full'\n")
    assert Config.from_yaml(str(tmp_path / "c.yml")) == Config(bf=8, exact_flush=True, scale=0.5, mode="full") == Config.from_dict({"bf": 8, "exact_flush": True, "scale": 0.5, "mode": "full"})
    with pytest.raises(ValueError):
        Config.from_dict({"nothing": 1})


def test_sources(spark, tmp_path):
    rows = [(0, 0, 0, [1.0], [1.0], "prefill"), (0, 0, 1, [2.0], [2.0], "prefill"), (0, 0, 0, [3.0], [3.0], "decode"), (1, 0, 0, [9.0], [9.0], "prefill")]
    df = spark.createDataFrame(rows, tables.KEYS + ", phase string")
    tables.write_snapshot(df, str(tmp_path / "c"), ("layer",))
    got = tables.read_capture(spark, str(tmp_path / "c"), layer=0).orderBy("pos").select("pos", "key").collect()
    assert [(r[0], r[1]) for r in got] == [(0, [1.0]), (1, [2.0]), (2, [3.0])]
    with pytest.raises(ValueError):
        tables.write_snapshot(df.drop("phase"), str(tmp_path / "d"))
        tables.read_capture(spark, str(tmp_path / "d"))
    for _ in range(2):
        tables.append_csv(spark.createDataFrame([(1, 2)], "a int, b int"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    (tmp_path / "p.jsonl").write_text("\n".join(map(json.dumps, [{"prompt": "a"}, {"input": "b", "prompt": "c"}, {"other": 1}])))
    assert sorted(r[0] for r in tables.read_prompts(spark, str(tmp_path / "p.jsonl")).select("prompt").collect()) == ["a", "b"]
    assert tables.sample_rows(spark.range(100), 7).count() == 7
    for kind in ("single", "multi", "chain", "common"):
        r = tables.retrieval_prompts(spark, 2, kind).first()
        assert all(a in r["context"] for a in r["answers"])


def stream(spark, tmp_path, batches, schema, make, mode, name):
    """Run a stateful operator over files that arrive one batch at a time; returns its rows."""
    src = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(src / f"b={i}"))
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(src))
    make(files).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name)


ARRIVALS = "head int, pos long, key array<double>"


def test_buffer_flushes_when_full(spark, tmp_path):
    batches = [[(h, p, [float(p)]) for p in range(a, b) for h in (0, 1)] for a, b in ((0, 3), (3, 11), (11, 12))]
    got = stream(spark, tmp_path, batches, ARRIVALS, lambda f: state.flushes(f, 4), "append", "flushed")
    rows = {(h, b): sorted(r["pos"] for r in got.where(f"head = {h} AND batch = {b}").collect()) for h in (0, 1) for b in range(3)}
    assert all(rows[h, b] == list(range(4 * b, 4 * b + 4)) for h in (0, 1) for b in range(3)) and got.count() == 24


def test_buffers_are_cut_in_order_across_frames(spark, tmp_path):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        shuffled = np.random.default_rng(3).permutation(2000).tolist()
        got = stream(spark, tmp_path, [[(0, p, [float(p)]) for p in shuffled]], ARRIVALS, lambda f: state.flushes(f, 256), "append", "ordered").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r["batch"], r["pos"]) for r in got) == [(p // 256, p) for p in range(1792)]


@pytest.mark.parametrize("few", [1 << 18, 0])
def test_running_ranks(spark, few):
    rows = [(g, (k * 37) % 50, k, k / 7) for g in range(3) for k in range(200)]
    df = spark.createDataFrame(rows, "g int, x int, k int, v double").repartition(5)
    got = ranks.running(df, ["g"], [F.desc("x"), F.col("k")], {"upto": "v"}, few=few).collect()
    for g in range(3):
        own = sorted((r for r in got if r["g"] == g), key=lambda r: (-r["x"], r["k"]))
        assert [r["rank"] for r in own] == list(range(1, 201)) and np.allclose([r["upto"] for r in own], np.cumsum([r["v"] for r in own]))


def test_best_is_exact_in_every_batch_and_tie(spark, keys, asked, monkeypatch):
    monkeypatch.setattr(search, "PAIRS", 64)
    twice = keys.unionByName(keys.withColumn("pos", F.col("pos") + 1000)).repartition(3)
    got = {(r["query_id"], r["pos"], r["rank"], r["score"]) for r in search.best(asked, twice, 9).collect()}
    assert got == {(r["query_id"], r["pos"], r["rank"], r["score"]) for r in search.top_k(search.scores(asked, twice), 9).collect()}


def test_heads_keep_apart(spark):
    rows = [(h, p, [float(h + 1), float(p)], [float(h), float(p)]) for h in (0, 1) for p in range(20)]
    keys = spark.createDataFrame(rows, "head int, pos long, key array<double>, value array<double>")
    asked = spark.createDataFrame([(7, 0, [1.0, 0.0], 0.0)], "query_id long, head int, query array<double>, t double")
    for config in (Config(dim=2, bf=4), Config(dim=2, bf=4, levels=2, clustering="kmeans")):
        x = SparseIndex.build(keys, config)
        got = x.selected(asked).collect()
        assert len(got) == 20 and all(r["value"][0] == 0.0 and r["score"] == 1.0 for r in got)
        assert len(SparseIndex.build(keys.where("pos < 9"), config).append(keys.where("pos >= 9")).selected(asked).collect()) == 20
    assert clusterings.CLUSTERINGS["kmeans"](keys, 4).select("head", "cluster").distinct().count() == 10


def test_clustered_tree_prunes_and_grows(spark):
    keys = tables.clustered_keys(spark, 1200, DIM, centers=10)
    q = keys.where("pos < 5").select(F.col("pos").alias("query_id"), vec.unit("key").alias("query"))
    q = q.join(thresholds.kth_of(search.best(q, keys, 20)), "query_id")
    want = {(r[0], r[1]) for r in search.halfspace_blocks(q, keys).select("query_id", "pos").collect()}
    nodes, leaves = index.tree(keys.where("pos % 5 <> 0"), DIM, 8, 2, clusterings.CLUSTERINGS["kmeans"])
    grown, more = index.add_to_tree(nodes, leaves, keys.where("pos % 5 = 0"), DIM, 8, 2, room=12)
    assert more.count() == 1200 and {(r[0], r[1]) for r in search.descend(q, grown, more, 2).select("query_id", "pos").collect()} == want
    checked = search.descent_profile(q, grown, 2).where("level = 1").agg(F.sum("passed")).first()[0]
    assert checked / (5 * grown.where("level = 1").count()) < 0.55
    # every node holds all that lies below it, old and new
    at = grown.where("level = 1").select(F.col("node").alias("parent"), "center", "radius")
    assert more.join(at, "parent").where(vec.distance("key", "center") > F.col("radius") + 1e-6).isEmpty() and more.join(at, "parent").count() == 1200
    up = grown.where("level = 2").select(F.col("node").alias("parent"), F.col("center").alias("c"), F.col("radius").alias("r"))
    low = grown.where("level = 1").join(up, "parent")
    assert low.where(vec.distance("center", "c") + F.col("radius") > F.col("r") + 1e-6).isEmpty() and low.count() == grown.where("level = 1").count()


def test_subtrees_are_padded(spark, keys):
    high, _ = index.tree(keys.where("pos < 300"), DIM, 4, 3)
    low, _ = index.tree(keys.where("pos >= 300"), DIM, 4, 1)
    both = index.append_subtree(high, low)
    assert both.count() == high.count() + 3 * low.count()
    for level in (1, 2):
        assert both.where(F.col("level") == level).join(both.where(F.col("level") == level + 1).select(F.col("node").alias("parent")), "parent").count() == both.where(F.col("level") == level).count()


def test_nearest_center_visits_few_cells(spark):
    keys = tables.clustered_keys(spark, 600, DIM, centers=10)
    centres = index.centers(index.by_position(keys, 4), DIM)
    got = index.nearest_center(keys, centres, cells=12).select("pos", "cluster").collect()
    x, c = arrays(keys), np.array([r[1] for r in sorted(centres.select("cluster", "center").collect())])
    assert dict(map(tuple, got)) == dict(enumerate(np.linalg.norm(x[:, None] - c[None], axis=2).argmin(1).tolist()))


def test_subspace_attention_by_name(keys, asked):
    got = ATTENTIONS["subspace"](asked, keys, Config(dim=DIM, k=10)).collect()
    assert len(got) == 7 and all(len(r["output"]) == DIM for r in got)


def test_reservoir_is_a_sample(spark, tmp_path):
    batches = [[(0, p, [0.0]) for p in range(a, a + 50)] for a in (0, 50, 100)]
    got = stream(spark, tmp_path, batches, ARRIVALS, lambda f: state.reservoir(f, 10), "update", "sampled").orderBy(F.desc("seen")).first()
    assert got["seen"] == 150 and len(set(got["sample"])) == 10 and max(got["sample"]) < 150 and max(got["sample"]) >= 10


def test_heavy_hitters_stay(spark, tmp_path):
    rows = [(0, s, p, 0.9 if p == 2 else 0.1) for s in range(12) for p in range(s + 1)]
    got = stream(spark, tmp_path, [rows[:30], rows[30:]], "head int, step long, pos long, p double", lambda f: state.heavy_hitter_cache(f, 1, 3), "append", "cached")
    last = got.orderBy(F.desc("step")).first()
    assert last["step"] == 11 and last["kept"] == [2, 9, 10, 11]


def test_versions(spark, tmp_path):
    x = state.VersionedIndex(spark, str(tmp_path / "index"))
    assert x.read() is None
    one = spark.createDataFrame([(0, 1, [1.0])], ARRIVALS)
    x.publish(one, 0)
    x.publish(one, 0)
    x.publish(spark.createDataFrame([(0, 2, [1.0])], ARRIVALS), 1)
    assert x.versions() == [0, 1] and x.read().count() == 2 and x.search_view(one).count() == 3
    batches = [[(0, p, [0.0]) for p in range(10)]]
    spark.createDataFrame(batches[0], ARRIVALS).write.parquet(str(tmp_path / "src"))
    y = state.VersionedIndex(spark, str(tmp_path / "live"))
    state.index_stream(spark.readStream.schema(ARRIVALS).parquet(str(tmp_path / "src")), y, 4, str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert y.read().count() == 8


def test_entry_without_training_data(spark, monkeypatch):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    real = __spark_entry__.import_module

    def gone(name):
        if name.startswith(("keelson.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(name=name)
        return real(name)

    monkeypatch.setattr(__spark_entry__, "import_module", gone)
    names = __spark_entry__.queries()
    assert names and not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in names)
    assert set(__spark_entry__.oracle_sql()) <= set(names)
