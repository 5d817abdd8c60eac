"""Threshold oracles over ``scored(query_id, pos, score)``; a sample is a stated, deterministic set of positions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelson.operators import dense, search
from keelson.operators.blocks import measured
from keelson.operators.lineage import cut
from keelson.operators.ranks import running


def in_sample(pos, size: int, n: int):
    """A deterministic stand-in for a reservoir of about ``size`` of ``n``: every (n // size)-th position."""
    return pos % max(1, n // size) == 0


def _ranked(scored: DataFrame) -> DataFrame:
    """Ranks below a bound, which Spark limits before it shuffles; whole orders go through ``ranks.running``."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "pos")))


def _all_ranked(scored: DataFrame) -> DataFrame:
    sizes = measured(scored.groupBy("query_id").agg(F.count("*").alias("m")))
    return running(scored, ["query_id"], [F.desc("score"), F.col("pos")]).join(sizes, "query_id")


def kth_best(scored: DataFrame, k: int = 64, strict: bool = False) -> DataFrame:
    """The k-th largest score; the smallest if there are fewer, or no row then if ``strict``."""
    kept = _ranked(scored).where(F.col("rank") <= k)
    out = kept.groupBy("query_id").agg(F.min("score").alias("t"), F.count("*").alias("n"))
    return (out.where(F.col("n") == k) if strict else out).select("query_id", "t")


def kth_of(best: DataFrame) -> DataFrame:
    """The least score among each query's rows of ``best(query_id, score)``, such as ``search.best`` gives: its k-th largest."""
    return best.groupBy("query_id").agg(F.min("score").alias("t"))


def sample_max(sample: DataFrame) -> DataFrame:
    return sample.groupBy("query_id").agg(F.max("score").alias("t"))


def sample_mean_max(sample: DataFrame) -> DataFrame:
    return sample.groupBy("query_id").agg(((F.avg("score") + F.max("score")) / 2).alias("t"))


def full_search(scored: DataFrame) -> DataFrame:
    return scored.select("query_id").distinct().withColumn("t", F.lit(float("-inf")))


def budget(sample: DataFrame, share: float) -> DataFrame:
    """The score at rank ``max(1, int(share * size))``."""
    return _all_ranked(sample).where(F.col("rank") == F.greatest(F.lit(1), F.floor(F.col("m") * share))).select("query_id", F.col("score").alias("t"))


def sample_gap(sample: DataFrame, share: float = 0.25) -> DataFrame:
    """Below the earliest of the three largest gaps among the best ``max(2, int(share * size))`` scores."""
    return _below_gaps(_all_ranked(sample).where(F.col("rank") <= F.greatest(F.lit(2), F.floor(F.col("m") * share))))


def _below_gaps(head: DataFrame) -> DataFrame:
    """Below the earliest of the three largest gaps of ``head(query_id, rank, score)``."""
    after = head.select("query_id", (F.col("rank") - 1).alias("rank"), F.col("score").alias("below"))
    gaps = head.join(after, ["query_id", "rank"]).withColumn("gap", F.col("score") - F.col("below"))
    largest = gaps.withColumn("g", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("gap"), "rank"))).where("g <= 3")
    return largest.groupBy("query_id").agg(F.min_by("below", "rank").alias("t"))


def mean_and_top(scored: DataFrame, sample: DataFrame, k: int = 16) -> DataFrame:
    """Half of the sample's mean plus half of the mean of the k best scores of all."""
    top = _ranked(scored).where(F.col("rank") <= k).groupBy("query_id").agg(F.avg("score").alias("b"))
    return sample.groupBy("query_id").agg(F.avg("score").alias("a")).join(top, "query_id").select("query_id", ((F.col("a") + F.col("b")) / 2).alias("t"))


#: Name -> (scored, sample) -> thresholds.
ORACLES: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "topk": lambda scored, sample: kth_best(scored, 64),
    "sample_max": lambda scored, sample: sample_max(sample),
    "sample_mean_max": lambda scored, sample: sample_mean_max(sample),
    "full_search": lambda scored, sample: full_search(scored),
    "sample_topk": lambda scored, sample: kth_best(sample, 16),
    "sample_gap": lambda scored, sample: sample_gap(sample),
    "budget": lambda scored, sample: budget(sample, 0.1),
    "sample_mean_topk": lambda scored, sample: mean_and_top(scored, sample),
}


def judge(scored: DataFrame, thresholds: DataFrame, k: int = 10) -> DataFrame:
    """Per query: retrieved share, and recall of the k best (1 if there are none)."""
    limits = measured(thresholds)
    hit = F.col("score") >= F.col("t")
    share = scored.join(limits, "query_id").groupBy("query_id").agg(F.avg(hit.cast("double")).alias("share"))
    best = _ranked(scored.select("query_id", "pos", "score")).where(F.col("rank") <= k).join(limits, "query_id")
    recall = best.groupBy("query_id").agg((F.count_if(hit) / F.count("*")).alias("recall"))
    return share.join(recall, "query_id", "left").withColumn("recall", F.coalesce("recall", F.lit(1.0)))


def online_series(scored: DataFrame, sample: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """query_id and one threshold per oracle: a row of a decode's time series, each step over the keys that it sees."""
    out = scored.select("query_id").distinct()
    for name in names:
        out = out.join(ORACLES[name](scored, sample).withColumnRenamed("t", f"tau_{name}"), "query_id", "left")
    return out


def series_over_keys(queries: DataFrame, keys: DataFrame, sample: Callable[[DataFrame], DataFrame], scale: float, share: float = 0.1) -> DataFrame:
    """query_id, n, cov50, tau_sample_max, tau_sample_mean_max, tau_budget of ``queries(query_id, query, until)``: each step over the keys up to its ``until``, scores times ``scale``.

    Passes over the keys, no row a pair.  Keys and queries that are null count as rows without a score.
    """
    asked, have = cut(queries.where(F.col("query").isNotNull())), keys.where(F.col("key").isNotNull())
    marks = queries.select(F.col("until").alias("pos"), "query_id", F.lit(0).alias("one"), F.lit(0).alias("two"))
    rows = lambda k, one, two: k.select("pos", F.lit(None).cast("long").alias("query_id"), F.lit(one).alias("one"), F.lit(two).alias("two"))
    seen = running(rows(keys, 1, 0).union(rows(sample(keys), 0, 1)).union(marks), [], [F.col("pos"), F.col("query_id").isNotNull()], {"n": "one", "m": "two"})
    seen = cut(seen.where(F.col("query_id").isNotNull()).groupBy("query_id").agg(F.sum("n").cast("long").alias("n"), F.sum("m").cast("long").alias("m")).where("n > 0"))
    half = dense.prefix(asked, have, scale, dense.totals(asked, have, scale), 0.5, "upto").select("query_id", "kept")
    sums = cut(dense.totals(asked, sample(have), 1.0).withColumnRenamed("n", "scored").join(seen.select("query_id", "m"), "query_id"))
    want = F.greatest(F.lit(1), F.floor(F.col("m") * share))
    budgets = dense.prefix(asked, sample(have), 1.0, sums, want, "rank").select("query_id", F.col("score").alias("last"))
    out = seen.join(half, "query_id", "left").join(sums.select("query_id", "scored", "total", "best"), "query_id", "left").join(budgets, "query_id", "left")
    taus = {"sample_max": F.col("best"), "sample_mean_max": (F.col("total") / F.col("scored") + F.col("best")) / 2, "budget": F.when(want <= F.col("scored"), F.col("last"))}
    return out.select("query_id", "n", ((F.coalesce("kept", F.lit(0)) + 1) / F.col("n")).alias("cov50"), *[(t * scale).alias(f"tau_{name}") for name, t in taus.items()])


def over_keys(name: str, queries: DataFrame, keys: DataFrame, sample: DataFrame) -> DataFrame:
    """query_id, t of an oracle of ORACLES, from passes over the keys and the sampled keys: no row a pair but those that the oracle ranks."""
    if name in ("topk", "sample_topk"):
        return kth_of(search.best(queries, keys, 64) if name == "topk" else search.best(queries, sample, 16))
    if name == "full_search":
        return queries.select("query_id", F.lit(float("-inf")).alias("t"))
    sums = dense.totals(queries, sample, 1.0)
    if name in ("sample_max", "sample_mean_max"):
        return sums.select("query_id", (F.col("best") if name == "sample_max" else (F.col("total") / F.col("n") + F.col("best")) / 2).alias("t"))
    if name == "sample_mean_topk":
        top = search.best(queries, keys, 16).groupBy("query_id").agg(F.avg("score").alias("b"))
        return sums.join(top, "query_id").select("query_id", ((F.col("total") / F.col("n") + F.col("b")) / 2).alias("t"))
    if name == "budget":
        return dense.prefix(queries, sample, 1.0, sums, F.greatest(F.lit(1), F.floor(F.col("n") * 0.1)), "rank").select("query_id", F.col("score").alias("t"))
    if name != "sample_gap":
        raise ValueError(f"no oracle is called {name}")
    last = dense.prefix(queries, sample, 1.0, sums, F.greatest(F.lit(2), F.floor(F.col("n") * 0.25)), "rank").select("query_id", F.col("kept").alias("take"), F.col("score").alias("t"))
    last = cut(last)
    first = search.halfspace_blocks(cut(queries.drop("t").join(last.select("query_id", "t"), "query_id")), sample)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "pos")
    return _below_gaps(first.withColumn("rank", F.row_number().over(by)).join(measured(last), "query_id").where("rank <= take"))


def judge_over_keys(queries: DataFrame, keys: DataFrame, limits: DataFrame, names: list[str], k: int = 10) -> DataFrame:
    """query_id, oracle, share, recall: ``judge`` for every column of ``limits(query_id, ...)`` that ``names`` lists."""
    asked = cut(queries.join(limits, "query_id"))
    kept = dense.counts(asked, keys, tuple(names)).join(measured(keys.agg(F.count("*").alias("n"))))
    best = search.best(queries, keys, k).select("query_id", "score").join(measured(limits), "query_id")
    recall = best.groupBy("query_id").agg(*[(F.count_if(F.col("score") >= F.col(n)) / F.count("*")).alias(n) for n in names])
    long = lambda df, value: df.select("query_id", *(["n"] if "n" in df.columns else []), F.inline(F.array(*[F.struct(F.lit(n).alias("oracle"), F.col(n).cast("double").alias(value)) for n in names])))
    return long(kept, "count").join(long(recall, "recall"), ["query_id", "oracle"], "left").select("query_id", "oracle", (F.col("count") / F.col("n")).alias("share"), F.coalesce("recall", F.lit(1.0)).alias("recall"))
