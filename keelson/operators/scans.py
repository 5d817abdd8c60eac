"""The bounds of ``enclosures.BOUNDS`` over all clusters and queries, without a row a pair.

Every bound is written in products of a query's features with a cluster's, so that a batch
of clusters meets a block of queries in matrix products; a task sends, for each query and bound, the
number of keys whose cluster passes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.functions import vec
from keelson.operators import enclosures, oriented
from keelson.operators.search import Asked, _by_head, ask, matrix, meet

#: Pairs of a cluster and a query that are judged at once; some twenty arrays of so many are held.
PAIRS = 1 << 17


class Queries:
    """Features of a block of queries, a column each."""

    def __init__(self, q: np.ndarray):
        a = np.abs(q)
        self.q, self.up, self.down, self.size, self.square = q.T, np.maximum(q, 0).T, np.minimum(q, 0).T, a.T, (q * q).T
        self.n2 = (q * q).sum(1)
        self.n, self.n1, self.most, self.n15 = np.sqrt(self.n2), a.sum(1), a.max(axis=1, initial=0.0), (a**1.5).sum(1) ** (1 / 1.5)


class Clusters:
    """Statistics of some clusters, as arrays of a row each, against queries: bounds are arrays of clusters by queries, made once."""

    def __init__(self, rows: pa.RecordBatch, of: Queries, shared: dict[str, dict]):
        self.rows, self.of, self.shared, self.made = rows, of, shared, {}

    def once(self, name, make) -> np.ndarray:
        if name not in self.made:
            self.made[name] = make()
        return self.made[name]

    def vectors(self, name: str) -> np.ndarray:
        return self.once(("vectors", name), lambda: matrix(self.rows.column(name)))

    def number(self, name: str) -> np.ndarray:
        return self.rows.column(name).to_numpy(zero_copy_only=False).astype(float)[:, None]

    def dot(self, name: str) -> np.ndarray:
        return self.once(("dot", name), lambda: self.vectors(name) @ self.of.q)

    def box(self, lo: str = "lo", hi: str = "hi") -> np.ndarray:
        """A part without members has nulls, and never passes."""
        return self.once(("box", lo), lambda: never(self.vectors(hi) @ self.of.up + self.vectors(lo) @ self.of.down))

    @cached_property
    def ball(self) -> np.ndarray:
        return self.dot("center") + self.of.n * self.number("radius")

    @cached_property
    def span_ball(self) -> np.ndarray:
        return self.dot("mid") + self.of.n * np.linalg.norm(self.vectors("half"), axis=1)[:, None]

    @cached_property
    def ellipsoid(self) -> np.ndarray:
        return self.dot("center") + np.minimum(self.number("radius_m") * np.sqrt(self.vectors("sigma") ** 2 @ self.of.square), self.number("radius") * self.of.n)

    @cached_property
    def cone(self) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            cos = np.where(self.of.n > 0, np.clip(self.dot("axis") / self.of.n, -1, 1), 1.0)
        best = np.cos(np.maximum(0, np.arccos(cos) - np.arccos(self.number("cos_min"))))
        return self.of.n * best * np.where(best >= 0, self.number("norm_max"), self.number("norm_min"))

    @cached_property
    def axis_interval(self) -> np.ndarray:
        a = self.dot("axis")
        return np.maximum(a * self.number("along_lo"), a * self.number("along_hi")) + np.sqrt(np.maximum(0, self.of.n2 - a * a)) * self.number("rest")

    @cached_property
    def centerline(self) -> np.ndarray:
        a = self.dot("axis")
        line = self.dot("center") + self.number("reach") * np.abs(a) + self.number("across") * np.sqrt(np.maximum(0, self.of.n2 - a * a))
        return np.minimum(line, self.ball)

    @cached_property
    def dual_axis_interval(self) -> np.ndarray:
        a, b = self.dot("axis"), self.dot("axis2")
        both = np.maximum(a * self.number("along_lo"), a * self.number("along_hi")) + np.maximum(b * self.number("along2_lo"), b * self.number("along2_hi"))
        return both + np.sqrt(np.maximum(0, self.of.n2 - a * a - b * b)) * self.number("rest2")

    @cached_property
    def split(self) -> np.ndarray:
        return np.maximum(self.box("lo_True", "hi_True"), self.box("lo_False", "hi_False"))

    def partial(self, d: int) -> np.ndarray:
        half = self.vectors("half")
        wide = np.zeros(half.shape, bool)
        np.put_along_axis(wide, np.argsort(-half, axis=1, kind="stable")[:, :d], True, axis=1)
        rest = np.sqrt((~wide).astype(float) @ self.of.square) * np.linalg.norm(np.where(wide, 0.0, half), axis=1)[:, None]
        return self.dot("mid") + np.where(wide, half, 0.0) @ self.of.size + rest

    def outlier(self, core: np.ndarray, name: str) -> np.ndarray:
        return np.maximum(never(core), self.dot(name))

    def inner_span(self) -> np.ndarray:
        lo, hi = self.vectors("inner_lo"), self.vectors("inner_hi")
        return (lo + hi) / 2 @ self.of.q + self.of.n * np.linalg.norm((hi - lo) / 2, axis=1)[:, None]

    def anchored(self) -> np.ndarray:
        one, two = (self.dot(a) + self.of.n * self.number(f"{a}_radius") for a in ("anchor", "anchor2"))
        return np.maximum(never(one), never(two))

    def hot(self) -> np.ndarray:
        lists = self.rows.column("hot")
        each, out = lists.value_lengths().to_numpy(zero_copy_only=False), self.box("cold_lo", "cold_hi").copy()
        if some := int(each.sum()):
            full = np.flatnonzero(each)
            score = matrix(lists.flatten()) @ self.of.q
            assert len(score) == some
            out[full] = np.maximum(out[full], np.maximum.reduceat(score, np.concatenate([[0], np.cumsum(each[full])[:-1]])))
        return out

    def slabs(self, dim: int) -> np.ndarray:
        flat = self.rows.column("slabs").flatten()
        lo, hi, rest = (flat.field(c).to_numpy(zero_copy_only=False).reshape(len(self.rows), -1) for c in ("lo", "hi", "rest"))
        out = self.ball
        for i, g in enumerate(enclosures._slab_directions(dim)):
            a = np.array(g) @ self.of.q
            bound = hi[:, i, None] * np.maximum(a, 0) + lo[:, i, None] * np.minimum(a, 0) + np.sqrt(np.maximum(0, self.of.n2 - a * a)) * rest[:, i, None]
            out = np.minimum(out, bound)
        return out

    def along_axes(self, name: str) -> np.ndarray:
        """A kind of ``oriented.BOXES``: its axes are those of the rows, or one set for all of their head."""
        column, own = self.rows.column(name), self.shared.get(name)
        part = lambda c: matrix(column.field(c))
        lo, hi, rest = part("lo"), part("hi"), column.field("rest").to_numpy(zero_copy_only=False)[:, None]
        origin = oriented.BOXES[name][2]
        if own is not None:
            head = self.rows.column("head")[0].as_py() if None not in own else None
            axes, mean = own[head]
            p = axes @ self.of.q
            inside, seen = hi @ np.maximum(p, 0) + lo @ np.minimum(p, 0), (p * p).sum(0)
            shift = mean @ self.of.q if origin else 0.0
        else:
            axes = column.field("axes").flatten().flatten().to_numpy(zero_copy_only=False).reshape(len(lo), lo.shape[1], -1)
            inside, seen = 0.0, 0.0
            for j in range(lo.shape[1]):
                p = axes[:, j] @ self.of.q
                inside, seen = inside + np.maximum(p * lo[:, j, None], p * hi[:, j, None]), seen + p * p
            shift = part("origin") @ self.of.q if origin else 0.0
        bound = inside + np.sqrt(np.maximum(0, self.of.n2 - seen)) * rest + shift
        return np.minimum(bound, self.ball) if origin == "centroid" else bound


def never(bound: np.ndarray) -> np.ndarray:
    """A bound of what has no members is below every threshold."""
    return np.where(np.isnan(bound), -np.inf, bound)


def least(*bounds: np.ndarray) -> np.ndarray:
    return reduce(np.minimum, bounds)


def _single(c: Clusters) -> np.ndarray:
    lo, hi = ((c.vectors(n) + e).astype(np.float32).astype(float) for n, e in (("lo", -1e-3), ("hi", 1e-3)))
    return hi @ c.of.up + lo @ c.of.down


#: The names of ``enclosures.BOUNDS`` -> the same bounds of clusters by queries.
BOUNDS = {
    "ball_centroid": lambda c, dim: c.ball,
    "min_enclosing_ball": lambda c, dim: c.dot("meb_center") + c.of.n * c.number("meb_radius"),
    "aabb": lambda c, dim: c.box(),
    "fp16_aabb": lambda c, dim: _single(c),
    "span_ball": lambda c, dim: c.span_ball,
    **{f"partial_aabb_d{d}": lambda c, dim, d=d: c.partial(d) for d in (8, 16, 32, 64)},
    "ellipsoid": lambda c, dim: c.ellipsoid,
    "outlier_aabb": lambda c, dim: c.outlier(c.box("inner_lo", "inner_hi"), "outlier"),
    "outlier_ball_centroid": lambda c, dim: c.outlier(c.dot("center") + c.of.n * c.number("inner_radius"), "outlier"),
    "outlier_span_ball": lambda c, dim: c.outlier(c.inner_span(), "outlier"),
    "cheap_outlier_aabb": lambda c, dim: c.outlier(c.box("short_lo", "short_hi"), "longest"),
    "cheap_outlier_ball_aabb": lambda c, dim: least(c.ball, c.outlier(least(c.box("short_lo", "short_hi"), never(c.dot("center") + c.of.n * c.number("short_radius"))), "longest")),
    "hot_key_aabb": lambda c, dim: c.hot(),
    "l1_ball": lambda c, dim: c.dot("center") + c.number("radius_1") * c.of.most,
    "linf_ball": lambda c, dim: c.dot("center") + c.number("radius_inf") * c.of.n1,
    "lp_ball": lambda c, dim: c.dot("center") + c.number("radius_3") * c.of.n15,
    "multi_ball": lambda c, dim: least(c.ball, c.anchored()),
    "cone": lambda c, dim: c.cone,
    "centerline": lambda c, dim: c.centerline,
    "dual_centerline": lambda c, dim: least(c.dual_axis_interval, c.ball),
    "axis_interval": lambda c, dim: c.axis_interval,
    "dual_axis_interval": lambda c, dim: c.dual_axis_interval,
    "split_aabb": lambda c, dim: c.split,
    "bisect_aabb": lambda c, dim: least(c.split, c.ball),
    "topk_aabb_residual": lambda c, dim: least(c.partial(16), c.ball),
    "slab_bundle": lambda c, dim: c.slabs(dim),
    "hybrid": lambda c, dim: least(c.ball, c.box(), c.cone),
    "hybrid_plus": lambda c, dim: least(c.ball, c.box(), c.cone, c.ellipsoid, c.centerline),
    **{name: lambda c, dim, name=name: c.along_axes(name) for name in oriented.BOXES},
    "tight_hybrid": lambda c, dim: least(c.ball, c.box(), c.ellipsoid, c.split, c.axis_interval),
}


def scanned(summary: DataFrame, queries: DataFrame, dim: int, names: list[str], shared: dict[str, DataFrame] | None = None) -> DataFrame:
    """query_id, enclosing, scanned: share of keys whose cluster passes the bound, of ``summary`` as ``enclosures.summaries`` makes it.

    ``shared`` holds the axes of a head by kind of box, where the rows don't.
    """
    known = {}
    for name, axes in (shared or {}).items():
        rows = axes.collect()  # a row a head
        known[name] = {(r["head"] if "head" in axes.columns else None): (np.array(r["axes"], float), np.array(r["mean"], float)) for r in rows}
    given = summary.sparkSession.sparkContext.broadcast(known)

    def make(asked: Asked, batch: pa.RecordBatch, state: dict) -> Iterator[dict]:
        if not state:
            state |= {name: np.zeros(len(asked.ids), np.int64) for name in ("keys", *names)}
            state["of"] = Queries(asked.vectors)
        limit = asked.limits - vec.SLACK * np.maximum(np.abs(asked.limits), 1.0)
        step = max(1, PAIRS // len(asked.ids))
        for head, rows in _by_head(batch):
            own = batch if len(rows) == batch.num_rows else batch.take(pa.array(rows))
            for at in range(0, own.num_rows, step):
                part = own.slice(at, step)
                clusters, size = Clusters(part, state["of"], given.value), part.column("size").to_numpy()
                state["keys"] += size.sum()
                for name in names:
                    state[name] += size @ (BOUNDS[name](clusters, dim) > limit)
        return iter(())

    def end(asked: Asked, state: dict) -> Iterator[dict]:
        if state:
            yield {"query_id": asked.ids} | {name: state[name] for name in ("keys", *names)}

    kinds = "query_id bigint, keys bigint" + "".join(f", `{name}` bigint" for name in names)
    parts = reduce(DataFrame.union, [meet(summary, block, kinds, make, end) for block in ask(queries.select("query_id", "query", "t"))])
    wide = parts.groupBy("query_id").agg(*[(F.sum(name) / F.sum("keys")).alias(name) for name in names])
    return wide.unpivot("query_id", names, "enclosing", "scanned")
