"""Boxes along principal axes, of a head's keys, of a cluster's own members, or of the queries seen so far.

Second moments are kept as factors: rows whose products with themselves sum to
those of all rows they stand for.  Rows are their own factor, any number of rows is
brought down to dim + 1 by a QR step, and factors are merged by putting
them under each other.  So a group's axes come from few rows a task, whatever
the group holds, and small clusters send no more than their members.

A cluster's box has an interval on each axis and, for what the axes leave out, the
largest residual norm.  ``q.k`` is at most what the intervals allow plus that residual times
the query's own, so that any number of axes is safe.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions import vec
from keelson.operators.blocks import against, measured
from keelson.operators.lineage import cut
from keelson.operators.search import heads, matrix

#: Bytes of factors that a task holds before it hands them on, merges of a group's factors at once, and rows projected at once.
HELD, MERGES, ROWS = 32 << 20, 64, 512


def _factor(rows: np.ndarray) -> np.ndarray:
    return rows if len(rows) <= rows.shape[1] else np.linalg.qr(rows, mode="r")


def principal_axes(rows: DataFrame, column: str, dim: int, count: int, by: tuple[str, ...] = ()) -> DataFrame:
    """[by, ]mean, axes: the ``count`` principal axes of ``column`` around its mean, the widest first, for each group of ``by``."""
    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in by)

    def factors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            names = [k for k, f in held.items() for _ in range(len(f))]
            cols = [pa.array([n[i] for n in names], schema.field(c).type) for i, c in enumerate(by)]
            return pa.RecordBatch.from_arrays([*cols, pa.array([r.tolist() for f in held.values() for r in f], pa.list_(pa.float64()))], [*by, "row"])

        schema = None
        for batch in batches:
            if not batch.num_rows:
                continue
            schema, x = batch.schema, matrix(batch.column(column))
            x = np.hstack([x, np.ones((len(x), 1))])
            keys = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True)) if by else [()] * len(x)
            for key, mine in pd.Series(range(len(x))).groupby(pd.Series(keys, dtype=object)) if by else [((), slice(None))]:
                part = x[mine] if isinstance(mine, slice) else x[mine.to_numpy()]
                held[key] = _factor(np.vstack([held[key], part]) if key in held else part)
            if sum(f.nbytes for f in held.values()) > HELD:
                yield out()
                held.clear()
        if held:
            yield out()

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        f = _factor(np.array(group["row"].tolist(), float))
        return pd.DataFrame({c: group[c].iloc[0] for c in by} | {"row": [r.tolist() for r in f]})

    def solved(group: pd.DataFrame) -> pd.DataFrame:
        f = np.array(group["row"].tolist(), float)
        m = f.T @ f
        mean = m[:dim, dim] / m[dim, dim]
        width, axes = np.linalg.eigh(m[:dim, :dim] / m[dim, dim] - np.outer(mean, mean))
        axes = axes[:, np.argsort(-width)[:count]].T
        return pd.DataFrame({c: group[c].iloc[:1].to_numpy() for c in by} | {"mean": [mean.tolist()], "axes": [axes.tolist()]})

    made = rows.select(*by, column).mapInArrow(factors, f"{kinds}row array<double>").withColumn("part", F.pmod(F.spark_partition_id(), F.lit(MERGES)))
    once = made.groupBy(*by, "part").applyInPandas(merged, f"{kinds}row array<double>")
    return once.groupBy(*by).applyInPandas(solved, f"{kinds}mean array<double>, axes array<array<double>>")


def axis_boxes(members: DataFrame, axes: DataFrame, by: tuple[str, ...], on: tuple[str, ...] = ()) -> DataFrame:
    """[by, ]lo, hi, rest of ``members(by, key)``: each cluster's intervals on the axes that its row of ``axes([on, ]axes[, origin])`` holds."""
    names = [c for c in axes.columns if c in ("axes", "origin")]
    joined = members.select(*by, vec.doubles("key").alias("k")).join(axes.select(*on, *names), list(on)) if on else members.select(*by, vec.doubles("key").alias("k")).crossJoin(F.broadcast(axes.select(*names)))  # one row
    kinds = "".join(f"`{c}` {joined.schema[c].dataType.simpleString()}, " for c in by)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                x = matrix(batch.column("k"))
                if "origin" in names:
                    x = x - matrix(batch.column("origin"))
                a = batch.column("axes").flatten()
                a = a.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1, x.shape[1])
                p = np.einsum("nd,nmd->nm", x, a)
                rest = np.sqrt(np.maximum(((x - np.einsum("nm,nmd->nd", p, a)) ** 2).sum(1), 0))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in by), pa.array(list(p), pa.list_(pa.float64())), pa.array(rest)], [*by, "p", "rest"])

    count = len((axes.select("axes").first() or [[]])[0])
    each = joined.mapInArrow(project, f"{kinds}p array<double>, rest double")
    return each.groupBy(*by).agg(
        vec.each_dim(count, lambda i: F.min(F.get("p", F.lit(i)))).alias("lo"), vec.each_dim(count, lambda i: F.max(F.get("p", F.lit(i)))).alias("hi"), F.max("rest").alias("rest")
    )


def axis_bound(axes: Column, lo: Column, hi: Column, rest: Column, origin: Column | None = None) -> Column:
    """Largest q.k of a box along ``axes`` around ``origin``, with the residual of the axes left out."""
    p = F.transform(axes, lambda a: vec.dot(F.col("query"), a))
    inside = vec.total(F.zip_with(p, F.arrays_zip(lo.alias("lo"), hi.alias("hi")), lambda x, b: F.greatest(x * b["lo"], x * b["hi"])))
    left = F.sqrt(F.greatest(F.lit(0.0), vec.dot(F.col("query"), F.col("query")) - vec.total(F.transform(p, lambda x: x * x))))
    bound = inside + left * rest
    return bound if origin is None else bound + vec.dot(F.col("query"), origin)


#: Kind of box -> axes that it keeps (all if None), what its axes belong to, and what its intervals are measured from.
BOXES: dict[str, tuple[int | None, str, str | None]] = {
    "pca_obb": (None, "head", None),
    "pca_projection_box": (8, "head", None),
    "centered_pca_box": (8, "head", "mean"),
    "centroid_pca_box": (8, "cluster", "centroid"),
}


def with_axis_boxes(summary: DataFrame, members: DataFrame, dim: int, by: list[str], shared: dict[str, DataFrame] | None = None) -> DataFrame:
    """``summary([by, ]..., center)`` with, for every kind, a struct of its axes, intervals, residual and origin.

    Axes that belong to a head are left out of the rows and put into ``shared``, if it is given, by kind: [head, ]mean, axes.
    """
    own = heads(members)
    out, m = summary, members.select(*by, "key")
    bases: dict[tuple, DataFrame] = {}
    for name, (count, scope, origin) in BOXES.items():
        on = tuple(own) if scope == "head" else tuple(by)
        key = (min(count or dim, dim), on)
        if key not in bases:
            bases[key] = cut(principal_axes(m, "key", dim, key[0], on))
        axes = bases[key].withColumnRenamed("mean", "origin")
        axes = axes.drop("origin") if origin is None else axes
        boxes = axis_boxes(m, measured(axes), tuple(by), on)
        if shared is not None and scope == "head":
            shared[name] = bases[key]
            out = out.join(cut(boxes.select(*by, F.struct("lo", "hi", "rest").alias(name))), by)
            continue
        both = boxes.join(measured(axes), list(on)) if on else boxes.crossJoin(F.broadcast(axes))  # one row
        fields = ["axes", "lo", "hi", "rest", *(["origin"] if origin else [])]
        out = out.join(cut(both.select(*by, F.struct(*fields).alias(name))), by)
    return out


def box_bound(name: str) -> Column:
    """The bound of a kind of box on a row with its struct; around centroids never above the ball."""
    s = F.col(name)
    bound = axis_bound(s["axes"], s["lo"], s["hi"], s["rest"], s["origin"] if BOXES[name][2] else None)
    return F.least(bound, vec.dot("query", "center") + vec.norm("query") * F.col("radius")) if BOXES[name][2] == "centroid" else bound


def adaptive_passes(members: DataFrame, seen: DataFrame, queries: DataFrame, dim: int, count: int = 4, pairs: DataFrame | None = None) -> DataFrame:
    """query_id[, head], cluster that pass a gate made for the queries ``seen``: intervals on their ``count`` principal axes, the residual, and never above the ball.

    ``queries(query_id[, head], query, t)`` may be others than those seen: the bound is safe for all.  With ``pairs(query_id, [head, ]cluster)`` only those are judged.
    """
    from keelson.operators.index import balls

    own, of = heads(members, seen), heads(members, queries)
    by = [*heads(members), "cluster"]
    axes = cut(principal_axes(seen.select(*own, "query"), "query", dim, count, tuple(own)).drop("mean"))
    boxes = axis_boxes(members, measured(axes), tuple(by), tuple(own))
    boxes = boxes.join(measured(axes), own) if own else boxes.crossJoin(F.broadcast(axes))  # one row
    boxes, asked = boxes.join(balls(members, dim).select(*by, "center", "radius"), by), queries.select("query_id", *of, "query", "t")
    both = against(boxes, asked, of or None) if pairs is None else boxes.join(pairs, by).join(measured(asked.drop(*of)), "query_id")
    line = axis_bound(F.col("axes"), F.col("lo"), F.col("hi"), F.col("rest"))
    ball = vec.dot("query", "center") + vec.norm("query") * F.col("radius")
    slack = F.lit(vec.SLACK) * F.greatest(F.abs("t"), F.lit(1.0))
    return both.where(F.least(line, ball) + slack > F.col("t")).select("query_id", *by)
