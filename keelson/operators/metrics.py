"""Quality and cost metrics as aggregates."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.functions import vec
from keelson.operators import dense
from keelson.operators.blocks import against, measured
from keelson.operators.lineage import cut
from keelson.operators.ranks import running
from keelson.operators.search import Asked, ask, matrix, meet
from keelson.operators.search import best as best_keys

#: Gate cost of a bound relative to a dot product; others cost DEFAULT_COST.
GATE_COST = {
    "ball_centroid": 1.0,
    "l1_ball": 1.0,
    "min_enclosing_ball": 1.0,
    "aabb": 2.0,
    "cone": 1.5,
    "hybrid": 4.5,
    "ellipsoid": 2.5,
    "split_aabb": 4.0,
    "hybrid_plus": 10.0,
    "quad_aabb": 8.0,
    "bisect_aabb": 5.0,
    "slab_bundle": 2.0,
    "topk_aabb_residual": 3.0,
    "centerline": 3.0,
    "span_ball": 1.0,
    "outlier_ball_centroid": 2.0,
    "outlier_span_ball": 2.0,
    "axis_interval": 1.0,
    "dual_axis_interval": 2.0,
    "outlier_aabb": 3.0,
    "partial_aabb_d4": 1.03,
    "partial_aabb_d8": 1.06,
    "partial_aabb_d16": 1.12,
    "partial_aabb_d32": 1.25,
    "partial_aabb_d64": 1.50,
    "cheap_outlier_aabb": 2.0,
    "cheap_outlier_ball_aabb": 3.0,
}
DEFAULT_COST = 2.0


def recall_at(retrieved: DataFrame, best: DataFrame) -> DataFrame:
    """query_id, recall, retrieved: share of ``best(query_id, pos)`` that was retrieved; 1 where there is nothing to find."""
    sizes = retrieved.groupBy("query_id").agg(F.count("*").alias("retrieved"))
    hit = best.join(retrieved.select("query_id", "pos", F.lit(1).alias("hit")), ["query_id", "pos"], "left")
    r = hit.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))
    return r.join(sizes, "query_id", "full").select("query_id", F.coalesce("recall", F.lit(1.0)).alias("recall"), F.coalesce("retrieved", F.lit(0)).alias("retrieved"))


def analytic_cost(scanned: DataFrame, bf: int) -> DataFrame:
    """enclosing, scanned, ratio = cost / bf + scanned, speedup = 1 / ratio, averaged over queries."""
    cost = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in GATE_COST.items() for x in kv]), F.col("enclosing")), F.lit(DEFAULT_COST))
    mean = scanned.groupBy("enclosing").agg(F.avg("scanned").alias("scanned"))
    return mean.withColumn("ratio", cost / bf + F.col("scanned")).withColumn("speedup", 1 / F.col("ratio"))


def concentration(weighted: DataFrame, ks: tuple[int, ...] = (8, 32, 128)) -> DataFrame:
    """Per query over ``weighted(query_id, pos, p)``: top-k mass, cov50 share, effective size, entropy, share above uniform."""
    sizes = measured(weighted.groupBy("query_id").agg(F.count("*").alias("n")))
    r = running(weighted.select("query_id", "pos", "p"), ["query_id"], [F.desc("p"), F.col("pos")], {"cum": "p"}).withColumn("cum", F.round("cum", 9)).join(sizes, "query_id")
    return r.groupBy("query_id").agg(
        *[F.sum(F.when(F.col("rank") <= k, F.col("p")).otherwise(0.0)).alias(f"top{k}") for k in ks],
        ((F.count_if(F.col("cum") < 0.5) + 1) / F.max("n")).alias("cov50"),
        (1 / F.sum(F.col("p") * F.col("p"))).alias("eff_size"),
        (-F.sum(F.when(F.col("p") > 0, F.col("p") * F.log("p")).otherwise(0.0))).alias("entropy"),
        F.avg((F.col("p") * F.col("n") > 1).cast("double")).alias("above_uniform"),
    )


def sizes(sums: DataFrame) -> DataFrame:
    """query_id, eff_size, entropy of the weights whose ``dense.totals`` are given."""
    return sums.select("query_id", (F.col("mass") * F.col("mass") / F.col("square")).alias("eff_size"), dense.entropy().alias("entropy"))


def half_covered(queries: DataFrame, keys: DataFrame, sums: DataFrame, scale: float) -> DataFrame:
    """query_id, cov50: the share of the keys that half of the weight takes."""
    half = dense.prefix(queries, keys, scale, sums, 0.5, "upto")
    return half.join(sums.select("query_id", "n"), "query_id").select("query_id", ((F.col("kept") + 1) / F.col("n")).alias("cov50"))


def concentration_over_keys(queries: DataFrame, keys: DataFrame, sums: DataFrame, scale: float, ks: tuple[int, ...] = (8, 32, 128)) -> DataFrame:
    """``concentration`` of each query over all keys, from passes over the keys: no row a pair."""
    top = best_keys(queries, keys, max(ks)).select("query_id", "score", "rank").join(measured(sums.select("query_id", "best", "mass")), "query_id").withColumn("p", dense.weight(scale))
    tops = top.groupBy("query_id").agg(*[F.sum(F.when(F.col("rank") <= k, F.col("p")).otherwise(0.0)).alias(f"top{k}") for k in ks])
    uniform = cut(queries.join(sums.select("query_id", (F.col("best") + F.log(F.col("mass") / F.col("n")) / scale).alias("uniform")), "query_id"))
    above = dense.counts(uniform, keys, ("uniform",), strict=True).withColumnRenamed("uniform", "above")
    out = tops.join(half_covered(queries, keys, sums, scale), "query_id").join(sizes(sums), "query_id").join(above, "query_id").join(sums.select("query_id", "n"), "query_id")
    return out.select("query_id", *[f"top{k}" for k in ks], "cov50", "eff_size", "entropy", (F.col("above") / F.col("n")).alias("above_uniform"))


def norm_marginals(keys: DataFrame, dims: tuple[str, ...]) -> DataFrame:
    """Mean and population deviation of key norms over each dimension alone and over all; NaN norms don't count."""
    n = keys.select(*dims, F.nanvl(vec.norm("key"), F.lit(None).cast("double")).alias("norm"))
    sets = ", ".join(f"({d})" for d in dims) + ", ()"
    n.createOrReplaceTempView("keelson_norms")
    return n.sparkSession.sql(f"SELECT {', '.join(dims)}, count(norm) AS n, avg(norm) AS mean, stddev_pop(norm) AS sd FROM keelson_norms GROUP BY GROUPING SETS ({sets})")


def orthants(vectors: DataFrame, column: str, dims: int) -> DataFrame:
    """orthant (sign bits of the first ``dims`` dimensions), n."""
    bits = F.array_join(F.transform(F.slice(column, 1, dims), lambda x: F.when(x >= 0, "1").otherwise("0")), "")
    return vectors.groupBy(bits.alias("orthant")).agg(F.count("*").alias("n"))


def orthant_summary(counts: DataFrame) -> DataFrame:
    """Distinct orthants, shares of the best 1, 5 and 10, entropy in bits, effective count and inverse concentration."""
    total = counts.agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    best = counts.orderBy(F.desc("n"), "orthant").limit(10).select("n", F.row_number().over(Window.orderBy(F.desc("n"), "orthant")).alias("rank"))
    shares = best.agg(*[F.sum(F.when(F.col("rank") <= k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in (1, 5, 10)])
    p = F.col("n") / F.col("total")
    spread = counts.crossJoin(F.broadcast(total)).agg((-F.sum(p * F.log2(p))).alias("bits"), (1 / F.sum(p * p)).alias("inverse_hhi"))
    return total.crossJoin(shares).crossJoin(spread).select("kinds", *[(F.col(f"n{k}") / F.col("total")).alias(f"top{k}") for k in (1, 5, 10)], "bits", F.pow(F.lit(2.0), "bits").alias("effective"), "inverse_hhi")


def pair_overlap(sets: DataFrame) -> DataFrame:
    """a, b, common, jaccard, overlap of every pair of the stated queries' ``sets(query_id, item)``."""
    sizes = sets.groupBy("query_id").agg(F.count("*").alias("size"))
    common = sets.alias("x").join(sets.alias("y"), "item").where("x.query_id < y.query_id").groupBy(F.col("x.query_id").alias("a"), F.col("y.query_id").alias("b")).agg(F.count("*").alias("common"))
    every = sizes.select(F.col("query_id").alias("a"), F.col("size").alias("na")).join(sizes.select(F.col("query_id").alias("b"), F.col("size").alias("nb")), F.col("a") < F.col("b"))
    j = every.join(common, ["a", "b"], "left").withColumn("common", F.coalesce("common", F.lit(0)))
    return j.select("a", "b", "common", (F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("jaccard"), (F.col("common") / F.least("na", "nb")).alias("overlap"))


def pca_summary(rows: DataFrame, column: str, dim: int) -> DataFrame:
    """k90, k95, k99, effective rank, participation ratio and the errors of 8, 16 and 32 axes of the covariance spectrum; dim numbers reach the driver."""
    import numpy as np

    from keelson.operators.enclosures import principal_basis, rotated

    turned = rotated(rows.select(column), column, principal_basis(rows, column, dim))
    var = turned.agg(vec.each_dim(dim, lambda i: F.var_pop(F.get(F.col(column), F.lit(i)))).alias("v")).first()["v"]
    w = np.sort(np.maximum(np.array(var, float), 0))[::-1]
    p = w / max(w.sum(), 1e-300)
    cum = np.cumsum(p)
    row = [int(np.searchsorted(cum, x - 1e-12) + 1) for x in (0.9, 0.95, 0.99)] + [float(np.exp(-np.sum(p[p > 0] * np.log(p[p > 0])))), float(w.sum() ** 2 / max((w**2).sum(), 1e-300))]
    row += [float(1 - cum[min(k, dim) - 1]) for k in (8, 16, 32)]
    return rows.sparkSession.createDataFrame([row], "k90 int, k95 int, k99 int, effective_rank double, participation double, error8 double, error16 double, error32 double")


def divergence(dense: DataFrame, dropped: DataFrame) -> DataFrame:
    """query_id, kl (dense from dropped) and whether both prefer the same position, over ``(query_id, pos, p)``."""
    j = dense.join(dropped.select("query_id", "pos", F.col("p").alias("r")), ["query_id", "pos"], "left")
    kl = F.sum(F.when(F.col("p") > 0, F.col("p") * F.log(F.col("p") / F.greatest(F.coalesce("r", F.lit(0.0)), F.lit(1e-12)))).otherwise(0.0))
    best = lambda c: F.max_by("pos", F.struct(F.round(c, 12), -F.col("pos")))
    return j.groupBy("query_id").agg(kl.alias("kl"), (best("p") == best(F.coalesce("r", F.lit(-1.0)))).alias("top1_agrees"))


def sum_threshold(weighted: DataFrame, n: int, share: float) -> DataFrame:
    """Smallest K whose best weights, sinks (first and last position) set aside and renormalised, sum to ``share``."""
    inner = weighted.where((F.col("pos") > 0) & (F.col("pos") < n - 1))
    mass = inner.groupBy("query_id").agg(F.sum("p").alias("m"))
    shares = inner.join(measured(mass), "query_id").select("query_id", "pos", (F.col("p") / F.col("m")).alias("p"))
    cum = running(shares, ["query_id"], [F.desc("p"), F.col("pos")], {"cum": "p"}).withColumn("cum", F.round("cum", 9))
    return cum.groupBy("query_id").agg((F.count_if(F.col("cum") < share) + 1).alias("k"))


def divergence_over_keys(queries: DataFrame, keys: DataFrame, kept: DataFrame, sums: DataFrame, scale: float) -> DataFrame:
    """``divergence`` of the weights over all keys from those over ``kept(query_id, pos, score)`` alone: the dropped rows count by the sums that they leave."""
    p = kept.join(measured(sums.select("query_id", "best", "mass")), "query_id").withColumn("p", dense.weight(scale))
    p = cut(p.select("query_id", "pos", "p"))
    r = p.join(measured(p.groupBy("query_id").agg(F.sum("p").alias("share"))), "query_id").withColumn("r", F.col("p") / F.col("share"))
    mine = r.groupBy("query_id").agg(F.sum(F.col("p") * F.log(F.greatest("r", F.lit(1e-12)))).alias("told"), F.sum("p").alias("share"), F.max_by("pos", F.struct(F.round("r", 12), -F.col("pos"))).alias("kept_first"))
    out = sums.join(mine, "query_id", "left").join(dense.first_choice(queries, keys, scale, sums).withColumnRenamed("pos", "first"), "query_id")
    least = F.log(F.lit(1e-12))
    kl = -dense.entropy() - F.coalesce("told", F.lit(0.0)) - (1 - F.coalesce("share", F.lit(0.0))) * least
    return out.select("query_id", kl.alias("kl"), F.coalesce(F.col("first") == F.col("kept_first"), F.lit(False)).alias("top1_agrees"))


def sum_threshold_over_keys(queries: DataFrame, keys: DataFrame, n: int, share: float, scale: float, relevant: float | None = None) -> DataFrame:
    """``sum_threshold`` over all keys from passes over them; with a score from which keys are relevant, coverage and full as ``sum_threshold_coverage`` has them: relevant keys are the first of the order."""
    inner = keys.where((F.col("pos") > 0) & (F.col("pos") < n - 1))
    sums = dense.totals(queries, inner, scale)
    k = dense.prefix(queries, inner, scale, sums, share, "upto").select("query_id", (F.col("kept") + 1).alias("k"))
    if relevant is None:
        return k
    count = cut(dense.counts(cut(queries.withColumn("relevant", F.lit(relevant))), inner, ("relevant",)))
    have = count.join(sums, "query_id")
    taken = dense.prefix(queries, inner, scale, sums, share, "before").select("query_id", F.col("kept").alias("taken"))
    full = dense.prefix(queries, inner, scale, have, F.col("relevant"), "rank").select("query_id", "share")
    out = k.join(taken, "query_id").join(have.select("query_id", "relevant"), "query_id").join(full, "query_id")
    some = F.col("relevant") > 0
    return out.select("query_id", "k", F.when(some, F.least("taken", "relevant") / F.col("relevant")).otherwise(1.0).alias("coverage"), F.when(some, F.round("share", 9)).otherwise(0.0).alias("full"))


def kept_positions(n: int, mode: str, m: int, relevant: Column | None = None) -> Column:
    """Position sets of the drop experiments: ``random`` (hash order stand-in), ``window`` ({0} and the last m), ``relevant``."""
    pos = F.col("pos")
    if mode == "window":
        return (pos == 0) | (pos >= n - m)
    if mode == "relevant":
        return relevant
    return F.pmod(pos * 7919, F.lit(n)) < m


def hide_ratio(events: DataFrame) -> DataFrame:
    """1 - waited / kernel time of asynchronous updates."""
    return events.agg((1 - F.sum("wait") / F.sum("kernel")).alias("hide_ratio"))


def amortised(search: Column, update: Column, interval: int) -> Column:
    return search + update / interval


def rolling(series: DataFrame, value: str, order: str, by: str, width: int) -> DataFrame:
    """Rolling median, minimum and maximum over ``width`` rows on either side."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(-width, width)
    return series.withColumns({"median": F.percentile(value, F.lit(0.5)).over(w), "low": F.min(value).over(w), "high": F.max(value).over(w)})


#: Rows of a stretch of a series that one task rolls over, and cells of rows and queries that are held at once.
STRETCH, CELLS = 1024, 1 << 16


def rolling_over_keys(queries: DataFrame, keys: DataFrame, dim: int, width: int, places: int = 6) -> DataFrame:
    """query_id, pos, median, low, high of each query's scores in order of position, over ``width`` keys on either side, rounded: ``rolling`` without a shuffle of a row a pair.

    Keys go to stretches of STRETCH, each with the ``width`` keys before and after it; a stretch meets the queries a few at a time.
    A key or query that is null has no score; the copies of a query follow one another at each key.
    """
    ranked = running(keys.select("pos", "key"), [], [F.col("pos")], rank="r_").withColumn("r_", F.col("r_") - 1)
    block = lambda shift: F.floor((F.col("r_") + shift) / STRETCH).cast("long")
    rows = ranked.withColumn("block", F.explode(F.array_distinct(F.array(block(-width), block(0), block(width))))).where("block >= 0")
    none = F.array_repeat(F.lit(0.0), dim)
    rows = rows.select("block", "r_", "pos", F.col("key").isNotNull().alias("some"), F.coalesce(F.col("key").cast("array<double>"), none).alias("key"), (F.col("block") == block(0)).alias("core"))
    parts = max(1, min(1 << 12, -(-ranked.count() // STRETCH)))
    rows = cut(rows.repartition(parts, "block").sortWithinPartitions("block", "r_"))

    def make(asked: Asked, batch: pa.RecordBatch, state: dict) -> Iterator[dict]:
        held = [state["rows"], batch] if state else [batch]
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        blocks = table.column("block").to_numpy()
        ends = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist()]
        for a, b in zip(ends, ends[1:], strict=False):
            yield from _rolled(asked, table.slice(a, b - a), width, places)
        state["rows"] = table.slice(ends[-1])

    def end(asked: Asked, state: dict) -> Iterator[dict]:
        if state:
            yield from _rolled(asked, state["rows"], width, places)

    schema = "query_id bigint, pos bigint, median double, low double, high double"
    made = [meet(rows, shared, schema, make, end) for shared in ask(queries.where(F.col("query").isNotNull()))]
    blank = against(keys.select("pos"), queries.where(F.col("query").isNull()).select("query_id")).select("query_id", "pos", *[F.lit(None).cast("double").alias(c) for c in ("median", "low", "high")])
    return reduce(DataFrame.union, made).union(blank)


def _rolled(asked: Asked, rows: pa.RecordBatch, width: int, places: int) -> Iterator[dict]:
    x, pos, core = matrix(rows.column("key")), rows.column("pos").to_numpy(), rows.column("core").to_numpy(zero_copy_only=False)
    some = rows.column("some").to_numpy(zero_copy_only=False) & ~np.isnan(x).any(axis=1)
    first = np.flatnonzero(np.diff(asked.ids, prepend=asked.ids[0] - 1))
    copies = np.diff(np.append(first, len(asked.ids)))
    for c in np.unique(copies):
        places_of = first[copies == c]
        for at in range(0, len(places_of), step := max(1, CELLS // (len(x) * c))):
            own = places_of[at : at + step]
            q = asked.vectors[(own[:, None] + np.arange(c)).ravel()].T
            s = np.zeros((len(x), q.shape[1]))
            for j in range(x.shape[1]):  # in order, as these are results
                s += x[:, j, None] * q[j]
            s[~some] = np.nan
            s = s.reshape(len(x), len(own), c).transpose(0, 2, 1).reshape(len(x) * c, len(own))
            out = _windows(s, np.repeat(some, c), np.flatnonzero(np.repeat(core, c)), width)
            cols = [pa.array(v.T.ravel(), mask=np.isnan(v.T.ravel())) for v in (rounded(v, places) for v in out)]
            at_ = np.repeat(pos[core], c)
            yield {"query_id": np.repeat(asked.ids[own], len(at_)), "pos": np.tile(at_, len(own))} | dict(zip(("median", "low", "high"), cols, strict=True))


def _windows(s: np.ndarray, some: np.ndarray, core: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Median, minimum and maximum of columns of ``s`` over the windows around the rows ``core``; rows that are not ``some`` have no value."""
    n, size = len(s), 2 * width + 1
    out = tuple(np.full((len(core), s.shape[1]), np.nan) for _ in range(3))
    whole = np.zeros(n, bool)
    if n >= size:
        whole[width : n - width] = np.convolve(some.astype(int), np.ones(size, int), "valid") == size
        a = [s[i : n - size + 1 + i] for i in range(size)]
        for turn in range(size):  # sorts the rows of all windows at once
            for i in range(turn % 2, size - 1, 2):
                a[i], a[i + 1] = np.minimum(a[i], a[i + 1]), np.maximum(a[i], a[i + 1])
        fit = np.flatnonzero(whole[core])
        for to, v in zip(out, (a[width], a[0], a[-1]), strict=True):
            to[fit] = v[core[fit] - width]
    for i in np.flatnonzero(~whole[core]):  # at either end of the series, and beside what has no score
        near_ = np.arange(max(0, core[i] - width), min(n, core[i] + width + 1))
        v = s[near_[some[near_]]]
        if len(v):
            out[0][i], out[1][i], out[2][i] = np.median(v, axis=0), v.min(axis=0), v.max(axis=0)
    return out


def rounded(x: np.ndarray, places: int) -> np.ndarray:
    """``F.round(x, places) + 0.0``: half up by the decimal form of a number."""
    size = 10.0**places
    y = np.abs(x) * size
    low = np.floor(y)
    out = np.copysign((low + (y - low >= 0.5)) / size, x) + 0.0
    for i in np.argwhere(np.abs(y - low - 0.5) <= 1e-6 + 1e-12 * y):
        out[tuple(i)] = float(Decimal(repr(float(x[tuple(i)]))).quantize(Decimal(1).scaleb(-places), ROUND_HALF_UP)) + 0.0
    return out


def context(rows: DataFrame, text: str, order: str, by: str, width: int) -> DataFrame:
    """Each row with the rows around it, in order, joined by blanks."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(-width, width)
    return rows.withColumn("context", F.array_join(F.collect_list(text).over(w), " "))


def hierarchical_cost(levels: DataFrame, n: int, dim_cost: float = 1.0) -> DataFrame:
    """query_id, cost (nodes checked at all levels over n keys) and speedup from ``levels(query_id, level, checked, passed)``."""
    return levels.groupBy("query_id").agg((F.sum("checked") * dim_cost / n).alias("cost")).withColumn("speedup", 1 / F.col("cost"))


def transfer_means(rows: DataFrame) -> DataFrame:
    """Mean search and transfer times in ms, four places."""
    return rows.agg(F.round(F.avg("search_ms"), 4).alias("search_ms"), F.round(F.avg("transfer_ms"), 4).alias("transfer_ms"))


def spread(values: DataFrame, names: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """Minimum, maximum and mean of metrics across queries, by head or layer if asked."""
    return values.groupBy(*by).agg(*[f(n).alias(f"{n}_{label}") for n in names for label, f in (("min", F.min), ("max", F.max), ("mean", F.avg))])


def extremes(series: DataFrame, value: str, step: str, n: int) -> DataFrame:
    """The ``n`` steps with the largest and the ``n`` with the smallest values: kind (wide, narrow), rank, step, value; ties by step."""
    out = []
    for kind, order in (("wide", F.desc(value)), ("narrow", F.asc(value))):
        best = series.orderBy(order, step).limit(n)  # a top-n report: few rows are ranked
        out.append(best.select(F.lit(kind).alias("kind"), F.row_number().over(Window.orderBy(order, step)).alias("rank"), step, value))
    return out[0].union(out[1])


def overlap_summary(pairs: DataFrame, value: str, shares: tuple[float, ...] = (0.1, 0.5, 0.9)) -> DataFrame:
    """Quantiles, by linear interpolation, and the mean of a pair metric."""
    return pairs.agg(F.avg(value).alias("mean"), *[F.percentile(value, F.lit(p)).alias(f"p{round(100 * p)}") for p in shares])


def top_pairs(pairs: DataFrame, value: str, n: int) -> DataFrame:
    """The ``n`` pairs with the largest values; ties by the pair."""
    return pairs.orderBy(F.desc(value), "a", "b").limit(n)


def sum_threshold_coverage(weighted: DataFrame, n: int, share: float, relevant: Column) -> DataFrame:
    """query_id, k, coverage (share of the relevant inner positions among the k best that sum to ``share``), full (the sum at which all are covered); 1 and 0 where none is relevant."""
    inner = weighted.where((F.col("pos") > 0) & (F.col("pos") < n - 1)).withColumn("relevant", relevant)
    mass = measured(inner.groupBy("query_id").agg(F.sum("p").alias("m")))
    shares = inner.join(mass, "query_id").select("query_id", "pos", "relevant", (F.col("p") / F.col("m")).alias("p"))
    cum = running(shares, ["query_id"], [F.desc("p"), F.col("pos")], {"cum": "p"}).withColumn("cum", F.round("cum", 9)).withColumn("before", F.round(F.col("cum") - F.col("p"), 9))
    covered = F.count_if(F.col("relevant") & (F.col("before") < share)) / F.nullif(F.count_if("relevant"), F.lit(0))
    return cum.groupBy("query_id").agg((F.count_if(F.col("cum") < share) + 1).alias("k"), F.coalesce(covered, F.lit(1.0)).alias("coverage"), F.coalesce(F.max(F.when(F.col("relevant"), F.col("cum"))), F.lit(0.0)).alias("full"))
