"""Upper bounds of q.k over a cluster, one expression each, from per-cluster statistics.

``summaries`` makes the statistics in three aggregates over the members;
``BOUNDS`` maps names to expressions over a row that holds a query and a
cluster's statistics.  A gate passes where the bound (plus slack) exceeds the
threshold.  All bounds are safe for queries of any length.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.functions import vec
from keelson.operators import oriented
from keelson.operators.blocks import against, measured
from keelson.operators.lineage import cut
from keelson.operators.search import Asked, ask, halfspace_blocks, heads, matrix, meet, near, summed, tiles

#: Share of keys that ``hot_key_aabb`` checks one by one; random directions of the slab bundle.
HOT_SHARE, SLABS = 0.03, 8


def _dims(dim: int, make: Callable[[Column], Column], column: str) -> Column:
    return vec.each_dim(dim, lambda i: make(F.get(F.col(column), F.lit(i))))


def _slab_directions(dim: int, seed: int = 11) -> list[list[float]]:
    g = np.random.default_rng(seed).standard_normal((SLABS, dim))
    return (g / np.linalg.norm(g, axis=1, keepdims=True)).tolist()


def _half_boxes(dim: int, side: bool) -> list[Column]:
    """Box of the members above or below the middle of the widest dimension."""
    own = lambda i: F.when(F.col("upper") == side, F.get("k", F.lit(i)))
    return [vec.each_dim(dim, lambda i: F.min(own(i))).alias(f"lo_{side}"), vec.each_dim(dim, lambda i: F.max(own(i))).alias(f"hi_{side}")]


def summaries(members: DataFrame, dim: int, by: tuple[str, ...] = ("cluster",), tight: bool = True, shared: dict[str, DataFrame] | None = None) -> DataFrame:
    """Statistics of each cluster of ``members([head, ]cluster, pos, key)``; the iterated and anchored balls and the boxes along axes only if ``tight``.

    A head's axes go to ``shared``, if it is given, and not into every row.
    """
    by = (*(h for h in heads(members) if h not in by), *by)
    on = list(by)
    m = members.select(*by, "pos", vec.doubles("key").alias("k"), vec.norm("key").alias("kn"))
    hot = m.withColumn("nr", F.percent_rank().over(Window.partitionBy(*by).orderBy(F.desc("kn"), "pos")) < HOT_SHARE)
    first = hot.groupBy(*by).agg(
        F.count("*").alias("size"),
        _dims(dim, F.avg, "k").alias("center"),
        _dims(dim, F.min, "k").alias("lo"),
        _dims(dim, F.max, "k").alias("hi"),
        F.max("kn").alias("norm_max"),
        F.min("kn").alias("norm_min"),
        F.max_by("k", F.struct("kn", F.col("pos"))).alias("longest"),
        F.max_by("pos", F.struct("kn", F.col("pos"))).alias("longest_pos"),
        F.coalesce(F.collect_list(F.when(F.col("nr"), F.col("k"))), F.array()).alias("hot"),
        vec.each_dim(dim, lambda i: F.min(F.when(~F.col("nr"), F.get("k", F.lit(i))))).alias("cold_lo"),
        vec.each_dim(dim, lambda i: F.max(F.when(~F.col("nr"), F.get("k", F.lit(i))))).alias("cold_hi"),
    )
    half = F.zip_with("lo", "hi", lambda a, b: (b - a) / 2)
    first = first.withColumn("mid", F.zip_with("lo", "hi", lambda a, b: (a + b) / 2)).withColumn("half", half)
    first = first.withColumn("axis", vec.unit("center")).withColumn("wide", (F.array_position("half", F.array_max("half")) - 1).cast("int"))
    first = first.withColumn("axis2", vec.unit(vec.minus(F.transform("half", lambda _, i: (i == F.col("wide")).cast("double")), vec.scaled("axis", F.get("axis", F.col("wide"))))))
    j = m.join(first.select(*by, "center", "mid", "axis", "axis2", "wide", "longest_pos"), on)
    away = vec.minus("k", "center")
    along, along2 = vec.dot("k", "axis"), vec.dot("k", "axis2")
    rest = F.sqrt(F.greatest(F.lit(0.0), F.pow("kn", F.lit(2)) - F.pow(along, F.lit(2))))
    rest2 = F.sqrt(F.greatest(F.lit(0.0), F.pow("kn", F.lit(2)) - F.pow(along, F.lit(2)) - F.pow(along2, F.lit(2))))
    cos = F.when(F.col("kn") > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), along / F.col("kn")))).otherwise(1.0)
    upper = F.get("k", F.col("wide")) > F.get("mid", F.col("wide"))
    j = j.withColumns({"away": away, "d": vec.norm(away), "upper": upper, "far": F.col("pos") == F.col("longest_pos")})
    directions = _slab_directions(dim)
    slabs = [vec.dot("k", F.array(*map(F.lit, g))) for g in directions]
    off = vec.dot("away", "axis")
    second = j.groupBy(*by).agg(
        F.max("d").alias("radius"),
        F.max(vec.norm1("away")).alias("radius_1"),
        F.max(vec.norm_inf("away")).alias("radius_inf"),
        F.max(vec.norm_p(F.col("away"), 3.0)).alias("radius_3"),
        _dims(dim, lambda x: F.max(F.abs(x)), "away").alias("sigma"),
        F.min(along).alias("along_lo"),
        F.max(along).alias("along_hi"),
        F.max(rest).alias("rest"),
        F.min(along2).alias("along2_lo"),
        F.max(along2).alias("along2_hi"),
        F.max(rest2).alias("rest2"),
        F.max(F.abs(off)).alias("reach"),
        F.max(F.sqrt(F.greatest(F.lit(0.0), F.pow("d", F.lit(2)) - off * off))).alias("across"),
        F.min(cos).alias("cos_min"),
        F.max_by("k", F.struct("d", F.col("pos"))).alias("outlier"),
        F.max_by("pos", F.struct("d", F.col("pos"))).alias("outlier_pos"),
        *[part for side in (True, False) for part in _half_boxes(dim, side)],
        vec.each_dim(dim, lambda i: F.min(F.when(~F.col("far"), F.get("k", F.lit(i))))).alias("short_lo"),
        vec.each_dim(dim, lambda i: F.max(F.when(~F.col("far"), F.get("k", F.lit(i))))).alias("short_hi"),
        F.max(F.when(~F.col("far"), F.col("d"))).alias("short_radius"),
        F.array(*[F.struct(F.min(x).alias("lo"), F.max(x).alias("hi"), F.max(F.sqrt(F.greatest(F.lit(0.0), F.pow("kn", F.lit(2)) - x * x))).alias("rest")) for x in slabs]).alias("slabs"),
    )
    j = j.join(second.select(*by, "sigma", "outlier_pos"), on)
    stretched = F.sqrt(vec.total(F.zip_with("away", "sigma", lambda x, s: F.when(s > 0, F.pow(x / s, F.lit(2))).otherwise(0.0))))
    inner = F.col("pos") != F.col("outlier_pos")
    third = j.groupBy(*by).agg(
        F.max(stretched).alias("radius_m"),
        vec.each_dim(dim, lambda i: F.min(F.when(inner, F.get("k", F.lit(i))))).alias("inner_lo"),
        vec.each_dim(dim, lambda i: F.max(F.when(inner, F.get("k", F.lit(i))))).alias("inner_hi"),
        F.max(F.when(inner, F.col("d"))).alias("inner_radius"),
    )
    out = first.join(second, on).join(third, on)
    return oriented.with_axis_boxes(cut(_with_tight_balls(cut(out), m, dim, on)), members, dim, on, shared) if tight else out


def _with_tight_balls(summary: DataFrame, members: DataFrame, dim: int, on: list[str], rounds: int = 10) -> DataFrame:
    """A ball whose centre moved halfway to its farthest member, ``rounds`` times; and two balls around far members, each for those nearest to it."""
    shift = lambda a, b: F.zip_with(a, b, lambda x, y: x + (y - x) / 2)
    now = summary.select(*on, F.col("center").alias("c"))
    for _ in range(rounds):
        far = members.join(now, on).groupBy(*on).agg(F.first("c").alias("c"), F.max_by("k", F.struct(vec.distance("k", "c").alias("d"), -F.col("pos"))).alias("f"))
        now = cut(far.select(*on, shift("c", "f").alias("c")))
    ball_ = members.join(now, on).groupBy(*on).agg(F.first("c").alias("meb_center"), F.max(vec.distance("k", "c")).alias("meb_radius"))
    one = members.join(summary.select(*on, F.col("outlier").alias("a")), on).groupBy(*on).agg(F.first("a").alias("anchor"), F.max_by("k", F.struct(vec.distance("k", "a").alias("d"), -F.col("pos"))).alias("anchor2"))
    d = members.join(cut(one), on).withColumns({"d": vec.distance("k", "anchor"), "d2": vec.distance("k", "anchor2")})
    two = d.groupBy(*on).agg(*[F.first(c).alias(c) for c in ("anchor", "anchor2")], F.max(F.when(F.col("d") <= F.col("d2"), F.col("d"))).alias("anchor_radius"), F.max(F.when(F.col("d") > F.col("d2"), F.col("d2"))).alias("anchor2_radius"))
    return summary.join(ball_, on).join(two, on)


def ball() -> Column:
    return vec.dot("query", "center") + vec.norm("query") * F.col("radius")


def box() -> Column:
    return vec.box_bound(F.col("query"), F.col("lo"), F.col("hi"))


def _box_or_never(lo: str, hi: str) -> Column:
    """Bound of a part's box; a part without members never passes."""
    return F.when(F.get(F.col(lo), F.lit(0)).isNull(), F.lit(float("-inf"))).otherwise(vec.box_bound(F.col("query"), F.col(lo), F.col(hi)))


def span_ball() -> Column:
    return vec.dot("query", "mid") + vec.norm("query") * vec.norm("half")


def ellipsoid() -> Column:
    return vec.dot("query", "center") + F.least(F.col("radius_m") * vec.norm(vec.times("query", "sigma")), F.col("radius") * vec.norm("query"))


def partial_box(d: int) -> Column:
    """Exact in the d widest dimensions, Cauchy-Schwarz in the others; ties go to the first dimensions."""
    order = F.array_sort(F.transform("half", lambda h, i: F.struct((-h).alias("h"), i.alias("i"))))
    wide = F.transform(F.slice(order, 1, d), lambda x: x["i"])
    exact = vec.total(F.zip_with(vec.doubles("query"), F.transform("half", lambda h, i: F.when(F.array_contains(wide, i), h).otherwise(0.0)), lambda x, h: F.abs(x) * h))
    rest_q = F.transform(vec.doubles("query"), lambda x, i: F.when(F.array_contains(wide, i), 0.0).otherwise(x))
    rest_h = F.transform("half", lambda h, i: F.when(F.array_contains(wide, i), 0.0).otherwise(h))
    return vec.dot("query", "mid") + exact + vec.norm(rest_q) * vec.norm(rest_h)


def lp_ball(radius: str, dual: Column) -> Column:
    return vec.dot("query", "center") + F.col(radius) * dual


def cone() -> Column:
    """Longest member at the best angle; where that is negative the shortest member bounds it."""
    n = vec.norm("query")
    angle = F.acos(F.when(n > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), vec.dot("query", "axis") / n))).otherwise(1.0))
    best = F.cos(F.greatest(F.lit(0.0), angle - F.acos("cos_min")))
    return n * best * F.when(best >= 0, F.col("norm_max")).otherwise(F.col("norm_min"))


def axis_interval() -> Column:
    a = vec.dot("query", "axis")
    rest = F.sqrt(F.greatest(F.lit(0.0), F.pow(vec.norm("query"), F.lit(2)) - a * a))
    return F.greatest(a * F.col("along_lo"), a * F.col("along_hi")) + rest * F.col("rest")


def anchored_balls() -> Column:
    """The better of two balls around members that lie far apart; a ball without members never passes."""
    one, two = (vec.dot("query", a) + vec.norm("query") * F.col(f"{a}_radius") for a in ("anchor", "anchor2"))
    return F.greatest(one, F.coalesce(two, F.lit(float("-inf"))))


def centerline() -> Column:
    """From the centroid: the reach along its own direction either way, and the rest across it; never above the ball."""
    a = vec.dot("query", "axis")
    across = F.sqrt(F.greatest(F.lit(0.0), F.pow(vec.norm("query"), F.lit(2)) - a * a))
    return F.least(vec.dot("query", "center") + F.col("reach") * F.abs(a) + F.col("across") * across, ball())


def dual_axis_interval() -> Column:
    a, b = vec.dot("query", "axis"), vec.dot("query", "axis2")
    rest = F.sqrt(F.greatest(F.lit(0.0), F.pow(vec.norm("query"), F.lit(2)) - a * a - b * b))
    return F.greatest(a * F.col("along_lo"), a * F.col("along_hi")) + F.greatest(b * F.col("along2_lo"), b * F.col("along2_hi")) + rest * F.col("rest2")


def slab_bundle(dim: int) -> Column:
    n2 = F.pow(vec.norm("query"), F.lit(2))
    out = []
    for i, g in enumerate(_slab_directions(dim)):
        a, s = vec.dot("query", F.array(*map(F.lit, g))), F.get("slabs", F.lit(i))
        out.append(F.greatest(a * s["lo"], a * s["hi"]) + F.sqrt(F.greatest(F.lit(0.0), n2 - a * a)) * s["rest"])
    return F.least(*out, ball())


def split_box() -> Column:
    return F.greatest(_box_or_never("lo_True", "hi_True"), _box_or_never("lo_False", "hi_False"))


def with_outlier(core: Column, outlier: str) -> Column:
    return F.greatest(F.coalesce(core, F.lit(float("-inf"))), vec.dot("query", outlier))


def hot_keys_box() -> Column:
    return F.greatest(_box_or_never("cold_lo", "cold_hi"), F.coalesce(F.array_max(F.transform("hot", lambda k: vec.dot("query", k))), F.lit(float("-inf"))))


#: Name -> bound for keys of ``dim`` dimensions.
BOUNDS: dict[str, Callable[[int], Column]] = {
    "ball_centroid": lambda dim: ball(),
    "min_enclosing_ball": lambda dim: vec.dot("query", "meb_center") + vec.norm("query") * F.col("meb_radius"),
    "aabb": lambda dim: box(),
    "fp16_aabb": lambda dim: vec.box_bound(F.col("query"), F.transform("lo", lambda x: (x - 1e-3).cast("float").cast("double")), F.transform("hi", lambda x: (x + 1e-3).cast("float").cast("double"))),
    "span_ball": lambda dim: span_ball(),
    **{f"partial_aabb_d{d}": lambda dim, d=d: partial_box(d) for d in (8, 16, 32, 64)},
    "ellipsoid": lambda dim: ellipsoid(),
    "outlier_aabb": lambda dim: with_outlier(_box_or_never("inner_lo", "inner_hi"), "outlier"),
    "outlier_ball_centroid": lambda dim: with_outlier(vec.dot("query", "center") + vec.norm("query") * F.col("inner_radius"), "outlier"),
    "outlier_span_ball": lambda dim: with_outlier(F.when(F.col("size") > 1, vec.dot("query", F.zip_with("inner_lo", "inner_hi", lambda a, b: (a + b) / 2)) + vec.norm("query") * vec.norm(F.zip_with("inner_lo", "inner_hi", lambda a, b: (b - a) / 2))), "outlier"),
    "cheap_outlier_aabb": lambda dim: with_outlier(_box_or_never("short_lo", "short_hi"), "longest"),
    "cheap_outlier_ball_aabb": lambda dim: F.least(ball(), with_outlier(F.least(_box_or_never("short_lo", "short_hi"), vec.dot("query", "center") + vec.norm("query") * F.col("short_radius")), "longest")),
    "hot_key_aabb": lambda dim: hot_keys_box(),
    "l1_ball": lambda dim: lp_ball("radius_1", vec.norm_inf("query")),
    "linf_ball": lambda dim: lp_ball("radius_inf", vec.norm1("query")),
    "lp_ball": lambda dim: lp_ball("radius_3", vec.norm_p(F.col("query"), 1.5)),
    "multi_ball": lambda dim: F.least(ball(), anchored_balls()),
    "cone": lambda dim: cone(),
    "centerline": lambda dim: centerline(),
    "dual_centerline": lambda dim: F.least(dual_axis_interval(), ball()),
    "axis_interval": lambda dim: axis_interval(),
    "dual_axis_interval": lambda dim: dual_axis_interval(),
    "split_aabb": lambda dim: split_box(),
    "bisect_aabb": lambda dim: F.least(split_box(), ball()),
    "topk_aabb_residual": lambda dim: F.least(partial_box(16), ball()),
    "slab_bundle": slab_bundle,
    "hybrid": lambda dim: F.least(ball(), box(), cone()),
    "hybrid_plus": lambda dim: F.least(ball(), box(), cone(), ellipsoid(), centerline()),
    **{name: lambda dim, name=name: oriented.box_bound(name) for name in oriented.BOXES},
    "tight_hybrid": lambda dim: F.least(ball(), box(), ellipsoid(), split_box(), axis_interval()),
}


def rotated(rows: DataFrame, column: str, basis: np.ndarray) -> DataFrame:
    """``column`` in another orthogonal basis (rows of ``basis``), a bounded matrix; q.k doesn't change."""
    b = np.asarray(basis, float)

    @F.pandas_udf("array<double>")
    def turn(v):
        import pandas as pd

        return pd.Series(list(np.array(v.tolist(), float).reshape(len(v), -1) @ b.T)) if len(v) else pd.Series([], dtype=object)

    return rows.withColumn(column, turn(column))


def principal_basis(rows: DataFrame, column: str, dim: int) -> np.ndarray:
    """Principal axes as rows, from first and second moments summed in the cluster; dim**2 numbers reach the driver."""

    def moments(batches):
        import pandas as pd

        s, c, n = np.zeros(dim), np.zeros((dim, dim)), 0
        for b in batches:
            x = np.array(b[column].tolist(), float).reshape(len(b), -1)
            if len(x):
                s, c, n = s + x.sum(axis=0), c + x.T @ x, n + len(x)
        yield pd.DataFrame({"i": np.arange(dim), "n": n, "s": s, "c": list(c)})

    parts = rows.select(column).mapInPandas(moments, "i int, n long, s double, c array<double>")
    total = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), vec.each_dim(dim, lambda k: F.sum(F.get("c", F.lit(k)))).alias("c")).orderBy("i").collect()
    n = max(total[0]["n"], 1)
    mean = np.array([r["s"] for r in total]) / n
    cov = np.array([r["c"] for r in total]) / n - np.outer(mean, mean)
    w, v = np.linalg.eigh(cov)
    return v[:, np.argsort(-w)].T


def passes(summary: DataFrame, queries: DataFrame, dim: int, names: list[str]) -> DataFrame:
    """query_id, cluster, size and one boolean per bound: whether the cluster may hold a key at or above ``t``."""
    both = against(summary, queries.select("query_id", "query", "t"))
    slack = F.lit(vec.SLACK) * F.greatest(F.abs("t"), F.lit(1.0))
    return both.select("query_id", "cluster", "size", *[(BOUNDS[n](dim) + slack > F.col("t")).alias(n) for n in names])


def passes_of(summary: DataFrame, queries: DataFrame, pairs: DataFrame, dim: int, names: list[str]) -> DataFrame:
    """The same for ``pairs(query_id, cluster)`` alone."""
    both = pairs.join(summary, "cluster").join(measured(queries.select("query_id", "query", "t")), "query_id")
    slack = F.lit(vec.SLACK) * F.greatest(F.abs("t"), F.lit(1.0))
    return both.select("query_id", "cluster", "size", *[(BOUNDS[n](dim) + slack > F.col("t")).alias(n) for n in names])


def as_products(boxes: DataFrame, queries: DataFrame, upper: bool = True) -> tuple[DataFrame, DataFrame]:
    """``boxes(..., lo, hi)`` as keys and queries whose product is the largest (or least) q.k of the box: a query's positive parts meet one corner, its negative ones the other."""
    one, other = ("hi", "lo") if upper else ("lo", "hi")
    parts = F.concat(F.transform(vec.doubles("query"), lambda x: F.greatest(x, F.lit(0.0))), F.transform(vec.doubles("query"), lambda x: F.least(x, F.lit(0.0))))
    return boxes.withColumn("key", F.concat(vec.doubles(one), vec.doubles(other))).withColumn("pos", F.monotonically_increasing_id()), queries.withColumn("query", parts)


def scanned(passed: DataFrame, names: list[str]) -> DataFrame:
    """query_id, enclosing, scanned: share of keys whose cluster passes."""
    wide = passed.groupBy("query_id").agg(*[(F.sum(F.when(F.col(n), F.col("size")).otherwise(0)) / F.sum("size")).alias(n) for n in names])
    return wide.unpivot("query_id", names, "enclosing", "scanned")


def hull_passes(members: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, cluster of clusters whose convex hull reaches the threshold: its best vertex is its best member, so only members that reach it are found."""
    asked = cut(queries.select("query_id", "query", "t"))
    wide = asked.withColumn("t", F.col("t") - 2 * vec.SLACK * F.greatest(F.abs("t"), F.lit(1.0)))
    found = halfspace_blocks(wide, members.select(F.col("cluster").alias("pos"), "key")).withColumnRenamed("pos", "cluster")
    limits = measured(asked.select("query_id", "t"))
    return found.join(limits, "query_id").where(F.col("score") + F.lit(vec.SLACK) >= F.col("t")).select("query_id", "cluster").distinct()


def intersecting(passed: DataFrame, clusters: int) -> DataFrame:
    """query_id, count and percentage of clusters that pass."""
    return passed.groupBy("query_id").agg(F.count("*").alias("count")).withColumn("percentage", 100.0 * F.col("count") / clusters)


def parts_passes(members: DataFrame, queries: DataFrame, dim: int, parts: int = 4) -> DataFrame:
    """query_id, cluster where any of ``parts`` boxes passes; parts are runs along the cluster's widest dimension."""
    wide = members.groupBy("cluster").agg(vec.each_dim(dim, lambda i: F.max(F.get(vec.doubles("key"), F.lit(i))) - F.min(F.get(vec.doubles("key"), F.lit(i)))).alias("span"))
    axis = wide.select("cluster", (F.array_position("span", F.array_max("span")) - 1).cast("int").alias("axis"))
    run = F.ntile(parts).over(Window.partitionBy("cluster").orderBy(F.get(vec.doubles("key"), F.col("axis")), "pos"))
    at = lambda i: F.get(vec.doubles("key"), F.lit(i))
    boxes = members.join(axis, "cluster").withColumn("part", run).groupBy("cluster", "part").agg(vec.each_dim(dim, lambda i: F.min(at(i))).alias("lo"), vec.each_dim(dim, lambda i: F.max(at(i))).alias("hi"))
    return against(boxes, queries.select("query_id", "query", "t")).where(box() + vec.SLACK > F.col("t")).select("query_id", "cluster").distinct()


def query_mean_counts(members: DataFrame, queries: DataFrame, dim: int) -> DataFrame:
    """query_id, count of clusters where the interval along the mean query's direction, with the rest across it, reaches the threshold, and so does the ball.

    Bounds are matrix products of ball centres and queries; a task sends a number a query, and queries that no cluster reaches have no row.
    """
    from keelson.operators.index import balls

    mean = queries.agg(vec.each_dim(dim, lambda i: F.avg(F.get(vec.doubles("query"), F.lit(i)))).alias("m")).select(vec.unit("m").alias("mean"))
    own = [*heads(members), "cluster"]
    across = lambda v: F.sqrt(F.greatest(F.lit(0.0), vec.dot(v, v) - vec.dot(v, "mean") * vec.dot(v, "mean")))
    turned = members.crossJoin(F.broadcast(mean)).select(*own, vec.dot("key", "mean").alias("along"), across("key").alias("rest"))  # one row
    lines = turned.groupBy(*own).agg(F.min("along").alias("low"), F.max("along").alias("high"), F.max("rest").alias("far"))
    rows = lines.join(balls(members, dim).select(*own, "center", "radius"), own).select(*heads(members, queries), F.col("center").alias("key"), "radius", "low", "high", "far")
    asked = queries.crossJoin(F.broadcast(mean)).withColumns({"along": vec.dot("query", "mean"), "rest": across("query"), "length": vec.norm("query")})  # one row

    def make(asked: Asked, batch: pa.RecordBatch, state: dict) -> Iterator[dict]:
        if not state:
            state["count"] = np.zeros(len(asked.ids), np.int64)
        radius, low, high, far = (batch.column(c).to_numpy() for c in ("radius", "low", "high", "far"))
        for own, part, x, s in tiles(asked, batch):
            t, along, rest, length = asked.limits[own], *(asked.extra[c][own] for c in ("along", "rest", "length"))
            ball_ = s + length * radius[part, None]
            line = np.maximum(along * low[part, None], along * high[part, None]) + far[part, None] * rest
            ok = np.minimum(line, ball_) + vec.SLACK > t
            row, col = np.nonzero(np.abs(ball_ + vec.SLACK - t) <= near(x, asked, own))
            if len(row):
                again = summed(asked.vectors[own[col]], x[row]) + length[col] * radius[part[row]]
                ok[row, col] = np.minimum(line[row, col], again) + vec.SLACK > t[col]
            state["count"][own] += np.count_nonzero(ok, axis=0)
        return iter(())

    def end(asked: Asked, state: dict) -> Iterator[dict]:
        some = np.flatnonzero(state["count"]) if state else []
        if len(some):
            yield {"query_id": asked.ids[some], "count": state["count"][some]}

    shared = ask(asked.select("query_id", *heads(members, queries), "query", "t", "along", "rest", "length"), ("along", "rest", "length"))
    made = [meet(rows, part, "query_id bigint, count bigint", make, end) for part in shared]
    return reduce(DataFrame.union, made).groupBy("query_id").agg(F.sum("count").alias("count"))


def basis_of(kind: str, keys: DataFrame, queries: DataFrame, dim: int, parts: int = 4) -> np.ndarray:
    """Bases of rotated boxes: of all keys, of each slice of them, or of the queries seen so far."""
    if kind == "global_pca":
        return principal_basis(keys, "key", dim)
    if kind == "query_adaptive":
        return principal_basis(queries, "query", dim)
    if kind == "subspace":
        out = np.zeros((dim, dim))
        for a, w in vec.split_widths(dim, parts):
            out[a : a + w, a : a + w] = principal_basis(keys.select(vec.piece(F.col("key"), a, w).alias("key")), "key", w)
        return out
    raise ValueError(f"no basis is called {kind}")


def refine(members: DataFrame, queries: DataFrame, dim: int, least: int = 2, rounds: int = 3) -> DataFrame:
    """Members with finer clusters: boxes that pass without holding a hit are halved along their widest dimension, a few rounds."""
    from keelson.operators.index import centers

    now = members
    for _ in range(rounds):
        summary, useless = cut(centers(now, dim)), useless_boxes(now, queries)
        spans = summary.where(F.col("size") > least).select("cluster", F.zip_with("lo", "hi", lambda a, b: b - a).alias("span"))
        axis = spans.join(useless, "cluster", "left_semi").select("cluster", (F.array_position("span", F.array_max("span")) - 1).cast("int").alias("axis"))
        half = F.ntile(2).over(Window.partitionBy("cluster").orderBy(F.get(vec.doubles("key"), F.col("axis")), "pos"))
        now = cut(now.join(axis, "cluster", "left").withColumn("cluster", F.when(F.col("axis").isNull(), F.col("cluster") * 2).otherwise(F.col("cluster") * 2 + half - 1)).select(*members.columns))
    return now


#: Pairs of a member and a query that are multiplied at once, and how far a matrix product may lie from the sum in order, relatively.
PAIRS, APART = 1 << 20, 1e-13


def useless_boxes(members: DataFrame, queries: DataFrame) -> DataFrame:
    """The clusters of ``members(cluster, key)`` whose box passes for a query that none of their members reaches.

    A cluster's members come to one task one after another, which keeps the box and the
    best score of each query of the one cluster that is not complete.
    """
    rows = members.select("cluster", "key").repartition("cluster").sortWithinPartitions("cluster")

    def make(asked: Asked, batch: pa.RecordBatch, state: dict) -> Iterator[dict]:
        x, cluster = matrix(batch.column("key")), batch.column("cluster").to_numpy()
        for at in range(0, len(x), step := max(1, PAIRS // len(asked.ids))):
            yield from _judged(asked, x[at : at + step], cluster[at : at + step], state)

    def end(asked: Asked, state: dict) -> Iterator[dict]:
        if state:
            yield from _complete(asked, state["cluster"], *(state[c][None] for c in ("best", "lo", "hi")))

    found = [meet(rows, shared, "cluster bigint", make, end) for shared in ask(queries.select("query_id", "query", "t"))]
    return reduce(DataFrame.union, found).distinct()


def _judged(asked: Asked, x: np.ndarray, cluster: np.ndarray, state: dict) -> Iterator[dict]:
    """Clusters that end among these members; the last one stays in ``state``."""
    s = x @ asked.vectors.T
    limit = asked.limits - vec.SLACK
    row, col = np.nonzero(np.abs(s - limit) <= APART * (asked.norms * np.sqrt((x * x).sum(1).max()) + np.abs(limit)))
    s[row, col] = summed(x[row], asked.vectors[col])
    first = np.flatnonzero(np.diff(cluster, prepend=cluster[0] - 1))
    names, best, lo, hi = cluster[first], np.maximum.reduceat(s, first), np.minimum.reduceat(x, first), np.maximum.reduceat(x, first)
    if state and state["cluster"][0] == names[0]:
        best[0], lo[0], hi[0] = np.maximum(best[0], state["best"]), np.minimum(lo[0], state["lo"]), np.maximum(hi[0], state["hi"])
    elif state:
        yield from _complete(asked, state["cluster"], *(state[c][None] for c in ("best", "lo", "hi")))
    yield from _complete(asked, names[:-1], best[:-1], lo[:-1], hi[:-1])
    state |= {"cluster": names[-1:], "best": best[-1].copy(), "lo": lo[-1].copy(), "hi": hi[-1].copy()}


def _complete(asked: Asked, cluster: np.ndarray, best: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[dict]:
    up, down, t = np.maximum(asked.vectors, 0), np.minimum(asked.vectors, 0), asked.limits
    bound = hi @ up.T + lo @ down.T
    row, col = np.nonzero(np.abs(bound + vec.SLACK - t) <= APART * (asked.norms * np.sqrt(np.maximum(lo * lo, hi * hi).sum(1).max(initial=0.0)) + np.abs(t)))
    bound[row, col] = summed(np.where(asked.vectors[col] > 0, hi[row], lo[row]), asked.vectors[col])
    some = ((bound + vec.SLACK > t) & ~(best + vec.SLACK >= t)).any(axis=1)
    if some.any():
        yield {"cluster": cluster[some]}
