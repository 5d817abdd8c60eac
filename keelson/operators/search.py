"""Halfspace search: every key whose inner product with a query reaches its threshold.

Queries are a stated set that travels to the rows in blocks of a checked size;
keys are never shuffled for them.  Scans, gates and tree levels multiply
matrices over Arrow batches; where a score or its place against a threshold is
a result, it is summed again from the first element to the last, so that it
has the same bits as the column expressions of ``functions.vec``.

Keys, clusters and nodes may carry a ``head``.  It is then part of every key
that joins them, and a query that carries a ``head`` meets its own head only.
Absence of a row means rejection; a score of exactly 0 is a score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from keelson.functions import vec
from keelson.operators.blocks import against, measured, split

#: Pairs of a row and a query that are multiplied at once, and how far a matrix product may lie from the exact sum.
PAIRS, NEAR = 1 << 20, 1e-9
FOUND = "query_id bigint, pos bigint, score double"


def kv_head(q_head: Column, q_heads: int, kv_heads: int) -> Column:
    """Key head of a query head: consecutive query heads share one."""
    if q_heads % kv_heads:
        raise ValueError(f"{q_heads} query heads can't share {kv_heads} key heads evenly")
    return F.floor(q_head / (q_heads // kv_heads)).cast("int")


def heads(*tables: DataFrame) -> list[str]:
    """``head``, if all of the tables have it."""
    return ["head"] if all("head" in t.columns for t in tables) else []


def scores(queries: DataFrame, keys: DataFrame, on: Column | str | None = None) -> DataFrame:
    """Each query against each key (of its own head, if both have one): the query set is blocked onto every key row."""
    own = heads(queries, keys)
    return against(keys, queries, "head" if on is None and own else on).withColumn("score", vec.dot("query", "key"))


def exact(scored: DataFrame, threshold: Column, scaling: float | dict[int, float] = 1.0) -> DataFrame:
    """Rows at or above the threshold, compared on the raw score and scaled after, by one number or by one a head."""
    return scaled(scored.where(F.col("score") >= threshold), scaling)


def scaled(found: DataFrame, scaling: float | dict[int, float]) -> DataFrame:
    """Scores times ``scaling``; heads that a dict doesn't name keep theirs."""
    return found if scaling == 1.0 else found.withColumn("score", F.col("score") * factor(scaling))


def factor(scaling: float | dict[int, float]) -> Column:
    """What ``scaled`` multiplies a row's score by."""
    if not isinstance(scaling, dict):
        return F.lit(float(scaling))
    by_head = F.create_map(*[F.lit(x) for head, s in scaling.items() for x in (int(head), float(s))]) if scaling else None
    return F.lit(1.0) if by_head is None else F.coalesce(F.try_element_at(by_head, F.col("head").cast("int")), F.lit(1.0))


def with_limits(scored: DataFrame, limits: DataFrame) -> DataFrame:
    """Each scored row with the ``t`` of its query."""
    return scored.join(measured(limits), "query_id")


def top_k(scored: DataFrame, k: int, by: str = "query_id", tie: str = "pos") -> DataFrame:
    """The k best keys of each query, ties by position; partial top-k runs before the shuffle (rank limit push-down)."""
    w = Window.partitionBy(by).orderBy(F.desc("score"), tie)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


@dataclass
class Asked:
    """A block of queries as arrays, sorted by id."""

    ids: np.ndarray
    vectors: np.ndarray
    limits: np.ndarray
    head: np.ndarray | None
    extra: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        self.norms = np.sqrt((self.vectors * self.vectors).sum(axis=1))

    def of_head(self, head: int | None) -> np.ndarray:
        return np.arange(len(self.ids)) if self.head is None or head is None else np.flatnonzero(self.head == head)


def ask(queries: DataFrame, extra: tuple[str, ...] = ()) -> list[Broadcast]:
    """The query set as broadcast blocks of at most about BLOCK queries, with the columns ``extra`` as arrays of numbers."""
    return [queries.sparkSession.sparkContext.broadcast(_asked(part, extra)) for part in split(queries)]


def _asked(part: DataFrame, extra: tuple[str, ...] = ()) -> Asked:
    head = heads(part)
    t = F.col("t").cast("double") if "t" in part.columns else F.lit(float("-inf"))
    rows = part.select(F.col("query_id").cast("long"), vec.doubles("query").alias("query"), t.alias("t"), *head, *[F.col(c).cast("double").alias(f"{c}_") for c in extra]).toPandas().sort_values("query_id", kind="stable")
    vectors = np.array(rows["query"].tolist(), float).reshape(len(rows), -1) if len(rows) else np.zeros((0, 0))
    return Asked(rows["query_id"].to_numpy(np.int64), vectors, rows["t"].to_numpy(float), rows["head"].to_numpy(np.int64) if head else None, {c: rows[f"{c}_"].to_numpy(float) for c in extra})


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equally long vectors as a matrix of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(column), -1)


def summed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed from the first element to the last."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += a[:, j] * b[:, j]
    return out


def summed_at(x: np.ndarray, q: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Inner products of the rows ``row`` of ``x`` and the columns ``col`` of ``q``, summed as in ``summed`` without a copy of any vector."""
    out, xt = np.zeros(len(row)), np.ascontiguousarray(x.T)
    for a, b in zip(xt, q, strict=True):
        out += a[row] * b[col]
    return out


def _by_head(batch: pa.RecordBatch) -> Iterator[tuple[int | None, np.ndarray]]:
    if "head" not in batch.schema.names:
        yield None, np.arange(batch.num_rows)
        return
    head = batch.column("head").to_numpy(zero_copy_only=False)
    for h in np.unique(head):
        yield int(h), np.flatnonzero(head == h)


def meet(rows: DataFrame, shared: Broadcast, schema: str, make: Callable[[Asked, pa.RecordBatch, dict], Iterator[dict]], end: Callable[[Asked, dict], Iterator[dict]] | None = None) -> DataFrame:
    """``make`` over every Arrow batch of ``rows`` with a block of queries: one narrow pass.

    ``make`` yields columns by name, and may keep a task's state in its third
    argument; ``end`` yields what is left after a task's last batch.
    """
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, state = shared.value, {}
        made = (cols for batch in batches if batch.num_rows and len(asked.ids) for cols in make(asked, batch, state))
        for cols in chain(made, end(asked, state) if end else ()):
            yield pa.RecordBatch.from_arrays([x if isinstance(x := cols[f.name], pa.Array) else pa.array(x, f.type) for f in out], schema=out)

    return rows.mapInArrow(run, schema)


def untils(queries: DataFrame) -> list[str]:
    """``until``, if the queries have it: the last position whose key a query meets."""
    return ["until"] if "until" in queries.columns else []


def tiles(asked: Asked, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Queries (as places in ``asked``), rows of the batch, their keys, and the product of each such row with each such query; PAIRS at a time.

    Where queries have an ``until``, only those that meet a row are given, and the product with a row behind it is -inf.
    """
    k, until = matrix(batch.column("key")), asked.extra.get("until")
    pos = batch.column("pos").to_numpy() if until is not None else None
    for head, rows in _by_head(batch):
        own = asked.of_head(head)
        step = max(1, PAIRS // max(1, len(own)))
        for at in range(0, len(rows) if len(own) else 0, step):
            part = rows[at : at + step]
            x, some = k[part], own if pos is None else own[until[own] >= pos[part].min()]
            s = x @ asked.vectors[some].T
            if pos is not None:
                s[pos[part][:, None] > until[some]] = -np.inf
            if len(some):
                yield some, part, x, s


def near(k: np.ndarray, asked: Asked, own: np.ndarray) -> np.ndarray:
    """How far a matrix product of these rows may lie from the exact sum, by query."""
    return NEAR * asked.norms[own] * np.sqrt((k * k).sum(axis=1).max(initial=0.0)) + 1e-300


def halfspace_blocks(queries: DataFrame, keys: DataFrame) -> DataFrame:
    """query_id, pos, score of all hits of ``queries(query_id, query, t)``; the path for long scans.  A key or query that is null has no hits."""

    def make(asked: Asked, batch: pa.RecordBatch, state: dict) -> Iterator[dict]:
        k, pos = matrix(batch.column("key")), batch.column("pos")
        for head, rows in _by_head(batch):
            own = asked.of_head(head)
            q, limits, ids = np.ascontiguousarray(asked.vectors[own].T), asked.limits[own], asked.ids[own]
            step = max(1, PAIRS // max(1, len(own)))
            for at in range(0, len(rows) if len(own) else 0, step):
                x = k[rows[at : at + step]]
                row, col = np.nonzero(x @ q >= limits - near(x, asked, own))
                s = summed_at(x, q, row, col)
                keep = s >= limits[col]
                yield {"query_id": ids[col[keep]], "pos": pos.take(pa.array(rows[at + row[keep]])), "score": s[keep]}

    rows = keys.where(F.col("key").isNotNull()).select(*heads(keys, queries), F.col("pos").cast("long").alias("pos"), "key")
    return reduce(DataFrame.union, [meet(rows, shared, FOUND, make) for shared in ask(queries.where(F.col("query").isNotNull()))])


def k_best(held: list[tuple], k: int) -> tuple[np.ndarray, ...]:
    """Of (queries, positions, scores) the k best of each query, ties by position."""
    col, pos, s = (np.concatenate(x) for x in zip(*held, strict=True))
    by = np.lexsort((pos, -s, col))
    col, pos, s = col[by], pos[by], s[by]
    first = np.flatnonzero(np.diff(col, prepend=-1))
    place = np.arange(len(col)) - np.repeat(first, np.diff(np.append(first, len(col))))
    keep = place < k
    return col[keep], pos[keep], s[keep]


def best(queries: DataFrame, keys: DataFrame, k: int) -> DataFrame:
    """query_id, pos, score, rank of each query's k best keys, exactly: every task keeps its own k best, and those are ranked together."""

    def reduced(held: list[tuple]) -> tuple[np.ndarray, ...]:
        return k_best(held, k)

    def make(asked: Asked, batch: pa.RecordBatch, state: dict) -> Iterator[dict]:
        if not state:
            state |= {"held": [], "size": 0, "least": np.full(len(asked.ids), -np.inf)}
        keys_, pos = matrix(batch.column("key")), batch.column("pos").to_numpy()
        for head, rows in _by_head(batch):
            own = asked.of_head(head)
            step = max(1, PAIRS // max(1, len(own)))
            for at in range(0, len(rows), step):
                x = keys_[rows[at : at + step]]
                rough, apart = x @ asked.vectors[own].T, near(x, asked, own)
                limit = state["least"][own]
                if len(x) > k:
                    limit = np.maximum(limit, np.partition(rough, len(x) - k, axis=0)[len(x) - k] - apart)
                row, col = np.nonzero(rough >= limit - apart)
                state["held"].append((own[col], pos[rows[at + row]], summed(x[row], asked.vectors[own[col]])))
                state["size"] += len(row)
                if state["size"] > 4 * k * len(asked.ids) + PAIRS:
                    state["held"] = [reduced(state["held"])]
                    col, _, s = state["held"][0]
                    state["size"], full = len(col), np.flatnonzero(np.bincount(col, minlength=len(asked.ids)) == k)
                    last = np.full(len(asked.ids), -np.inf)
                    np.minimum.at(least := np.full(len(asked.ids), np.inf), col, s)
                    last[full] = least[full]
                    state["least"] = last
        return iter(())

    def end(asked: Asked, state: dict) -> Iterator[dict]:
        if state.get("held"):
            col, pos, s = reduced(state["held"])
            for at in range(0, len(col), PAIRS):
                yield {"query_id": asked.ids[col[at : at + PAIRS]], "pos": pos[at : at + PAIRS], "score": s[at : at + PAIRS]}

    return top_k(reduce(DataFrame.union, [meet(keys.select(*heads(keys), "pos", "key"), shared, FOUND, make, end) for shared in ask(queries)]), k)


def _pairs(batch: pa.RecordBatch, asked: Asked) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and queries (as places in ``asked``) to compare: those that ``ids`` lists, else all of a row's head, PAIRS at a time."""
    if "ids" in batch.schema.names:
        lists = batch.column("ids")
        row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
        col = np.searchsorted(asked.ids, lists.flatten().to_numpy())
        for at in range(0, len(row), PAIRS):
            yield row[at : at + PAIRS], col[at : at + PAIRS]
        return
    for head, rows in _by_head(batch):
        own = asked.of_head(head)
        step = max(1, PAIRS // max(1, len(own)))
        for at in range(0, len(rows) if len(own) else 0, step):
            part = rows[at : at + step]
            yield np.repeat(part, len(own)), np.tile(own, len(part))


def _through(nodes: DataFrame, shared: Broadcast, strict: bool, slack: float) -> DataFrame:
    """Nodes with ``ids``, the queries whose halfspace their ball may reach: of those that ``ids`` lists, else of all of their head.

    ``nodes(..., center, radius[, ids])``; center and radius are dropped.
    """
    names = [c for c in nodes.columns if c not in ("center", "radius", "ids")]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema if f.name in names)

    def make(asked: Asked, whole: pa.RecordBatch, state: dict) -> Iterator[dict]:
        step = max(1, PAIRS // len(asked.ids))  # the lists of a whole batch would take its rows times the queries
        for at in range(0, len(whole), step):
            yield from passed(asked, whole.slice(at, step))

    def passed(asked: Asked, batch: pa.RecordBatch) -> Iterator[dict]:
        c, r = matrix(batch.column("center")), batch.column("radius").to_numpy(zero_copy_only=False)
        held: list[list] = [[], []]
        for row, col in _pairs(batch, asked):
            t = asked.limits[col]
            bound = np.einsum("ij,ij->i", c[row], asked.vectors[col]) + asked.norms[col] * r[row] + slack * np.maximum(np.abs(t), 1.0)
            ok = bound > t if strict else bound >= t
            held[0].append(row[ok])
            held[1].append(asked.ids[col[ok]])
        row, ids = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in held)
        by = np.argsort(row, kind="stable")
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(ends, ids[by].astype(np.int64))
        keep = pa.array(np.diff(ends) > 0)
        yield {n: batch.column(n).filter(keep) for n in names} | {"ids": lists.filter(keep)}

    return meet(nodes, shared, f"{kinds}, ids array<bigint>", make)


def _hits(rows: DataFrame, shared: Broadcast, keep: tuple[str, ...], emit: str) -> DataFrame:
    """query_id, pos, score and ``keep`` of ``rows(pos, key, ids, ...)`` and the queries in ``ids``: at or above the threshold, or all."""
    kinds = "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def make(asked: Asked, batch: pa.RecordBatch, state: dict) -> Iterator[dict]:
        k, pos = matrix(batch.column("key")), batch.column("pos").to_numpy()
        for row, col in _pairs(batch, asked):
            s = summed(k[row], asked.vectors[col])
            ok = np.ones(len(s), bool) if emit == "candidates" else s >= asked.limits[col]
            yield {"query_id": asked.ids[col[ok]], "pos": pos[row[ok]], "score": s[ok]} | {c: batch.column(c).take(pa.array(row[ok])) for c in keep}

    return meet(rows, shared, FOUND + kinds, make)


def of_candidates(queries: DataFrame, keys: DataFrame, candidates: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """query_id, pos, score and ``keep`` of ``candidates(query_id, [head, ]pos)`` alone: a key meets the list of the queries that it is a candidate of."""
    own, out = heads(keys, candidates), []
    parts = split(queries)
    for part in parts:
        mine = candidates if len(parts) == 1 else candidates.join(F.broadcast(part.select("query_id")), "query_id", "left_semi")  # a block
        lists = mine.groupBy(*own, "pos").agg(F.collect_list(F.col("query_id").cast("long")).alias("ids"))
        rows = keys.select(*own, "pos", "key", *keep).join(lists, [*own, "pos"])
        out.append(_hits(rows, queries.sparkSession.sparkContext.broadcast(_asked(part)), keep, "candidates"))
    return reduce(DataFrame.union, out)


def gate(queries: DataFrame, nodes: DataFrame, strict: bool = False, slack: float = vec.SLACK) -> DataFrame:
    """The clusters of ``nodes(cluster, center, radius, ...)`` whose ball any query's halfspace may reach, with those queries as ``ids``."""
    return reduce(DataFrame.union, [_through(nodes, part, strict, slack) for part in ask(queries)])


def _reaching(asked: Asked, own: np.ndarray, x: np.ndarray, bound: np.ndarray, radius: np.ndarray, slack: float) -> np.ndarray:
    """Which balls ``gate`` passes, from the products ``bound`` of their centres ``x`` with the queries ``own``; close ones are summed again as it does."""
    t, norms = asked.limits[own], asked.norms[own]
    edge = slack * np.maximum(np.abs(t), 1.0)
    bound += norms * radius[:, None]
    bound += edge
    ok = bound >= t
    row, col = np.nonzero(np.abs(np.subtract(bound, t, out=bound)) <= near(x, asked, own))
    if len(row):
        again = np.einsum("ij,ij->i", x[row], asked.vectors[own[col]]) + norms[col] * radius[row] + edge[col]
        ok[row, col] = again >= t[col]
    return ok


def gate_counts(queries: DataFrame, nodes: DataFrame, slack: float = vec.SLACK) -> DataFrame:
    """query_id, clusters, scanned: how many of ``nodes(size, center, radius)`` pass ``gate`` for a query, and their sizes; queries that none passes have no row, and a task sends two numbers a query."""

    def make(asked: Asked, batch: pa.RecordBatch, state: dict) -> Iterator[dict]:
        for name in ("clusters", "scanned") if not state else ():
            state[name] = np.zeros(len(asked.ids), np.int64)
        r, size = batch.column("radius").to_numpy(zero_copy_only=False), batch.column("size").to_numpy()
        for own, part, x, bound in tiles(asked, batch):
            ok = _reaching(asked, own, x, bound, r[part], slack)
            state["clusters"][own] += np.count_nonzero(ok, axis=0)
            state["scanned"][own] += size[part] @ ok
        return iter(())

    def end(asked: Asked, state: dict) -> Iterator[dict]:
        some = np.flatnonzero(state["clusters"]) if state else []
        if len(some):
            yield {"query_id": asked.ids[some]} | {name: v[some] for name, v in state.items()}

    rows = nodes.select(*heads(nodes, queries), F.col("size").cast("long").alias("size"), vec.doubles("center").alias("key"), F.col("radius").cast("double").alias("radius"))
    made = [meet(rows, shared, "query_id bigint, clusters bigint, scanned bigint", make, end) for shared in ask(queries)]
    return reduce(DataFrame.union, made).groupBy("query_id").agg(F.sum("clusters").alias("clusters"), F.sum("scanned").alias("scanned"))


def gate_totals(queries: DataFrame, nodes: DataFrame, by: str, slack: float = vec.SLACK) -> DataFrame:
    """``by``, clusters, keys, seen: how many balls of ``nodes(by, size, center, radius)`` there are, their sizes, and the sizes that pass ``gate``, summed over all queries; a task sends a few numbers.

    ``nodes`` is read once a block of queries.
    """

    def judged(count_all: bool) -> Callable[[Asked, pa.RecordBatch, dict], Iterator[dict]]:
        def make(asked: Asked, batch: pa.RecordBatch, state: dict) -> Iterator[dict]:
            r, size = batch.column("radius").to_numpy(zero_copy_only=False), batch.column("size").to_numpy()
            seen = np.zeros(batch.num_rows, np.int64)
            for own, part, x, bound in tiles(asked, batch):
                seen[part] += np.count_nonzero(_reaching(asked, own, x, bound, r[part], slack), axis=1) * size[part]
            names = batch.column(by).dictionary_encode()
            code = names.indices.to_numpy()
            for name, *sums in zip(names.dictionary.to_pylist(), np.bincount(code), *(np.bincount(code, x) for x in (size, seen)), strict=True):
                held = state.setdefault(name, [0, 0, 0])
                state[name] = [a + int(b) for a, b in zip(held, [*(sums[:2] if count_all else (0, 0)), sums[2]], strict=True)]
            return iter(())

        return make

    def end(asked: Asked, state: dict) -> Iterator[dict]:
        if state:
            yield {by: list(state)} | {c: [x[i] for x in state.values()] for i, c in enumerate(("clusters", "keys", "seen"))}

    rows = nodes.select(by, F.col("size").cast("long").alias("size"), vec.doubles("center").alias("key"), F.col("radius").cast("double").alias("radius"))
    kinds = f"`{by}` {nodes.schema[by].dataType.simpleString()}, clusters bigint, keys bigint, seen bigint"
    made = reduce(DataFrame.union, [meet(rows, shared, kinds, judged(i == 0), end) for i, shared in enumerate(ask(queries))])
    return made.groupBy(by).agg(*[F.sum(c).alias(c) for c in ("clusters", "keys", "seen")])


def gated(queries: DataFrame, nodes: DataFrame, members: DataFrame, strict: bool = False, emit: str = "exact", slack: float = vec.SLACK, keep: tuple[str, ...] = ()) -> DataFrame:
    """Two-level search: gate clusters by their ball, then look at members of surviving ones only: query_id, pos, score and ``keep``.

    ``nodes([head, ]cluster, center, radius)``, ``members([head, ]cluster, pos,
    key)``.  The bound is ``c.q + |q| r``; a relative slack keeps rounding from
    losing hits.  ``strict`` drops clusters whose bound equals the threshold.
    ``emit`` is ``exact`` or ``candidates`` (all members of surviving clusters).
    A surviving cluster meets its members once, with the list of its queries.
    """
    own = heads(nodes, members)
    out = []
    for part in ask(queries):
        alive = _through(nodes.select(*own, "cluster", "center", "radius"), part, strict, slack)
        rows = members.select(*own, "cluster", "pos", "key", *keep).join(alive, [*own, "cluster"]).drop("cluster")
        out.append(_hits(rows, part, keep, emit))
    return reduce(DataFrame.union, out)


def _paths(nodes: DataFrame, levels: int) -> dict[int, DataFrame]:
    """By level: [head, ]node, parent, centers, radii; the two hold a node's own ball first, then those of its ancestors, the top last."""
    own, out = heads(nodes), {}
    for level in range(levels, 0, -1):
        rows = nodes.where(F.col("level") == level).select(*own, "node", "parent", vec.doubles("center").alias("centers"), F.array(F.col("radius").cast("double")).alias("radii"))
        if level < levels:
            above = out[level + 1].select(*own, F.col("node").alias("parent"), F.col("centers").alias("up_"), F.col("radii").alias("far_"))
            rows = rows.join(above, [*own, "parent"]).select(*own, "node", "parent", F.concat("centers", "up_").alias("centers"), F.concat("radii", "far_").alias("radii"))
        out[level] = rows
    return out


def _reached(asked: Asked, own: np.ndarray, parents: np.ndarray, centers: np.ndarray, radii: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """For queries ``own``: which reach the balls of each distinct parent of these rows and of all above it, and each row's place among those parents."""
    first, place = np.unique(parents, return_index=True, return_inverse=True)[1:]
    q, t = asked.vectors[own], asked.limits[own]
    ok = np.ones((len(first), len(own)), bool)
    c = centers[first].reshape(len(first), -1, q.shape[1])
    for depth in range(c.shape[1] - 1, -1, -1):
        some = np.flatnonzero(ok.any(axis=1))
        ok[some] &= c[some, depth] @ q.T + asked.norms[own] * radii[first[some], depth, None] + slack * np.maximum(np.abs(t), 1.0) >= t
    return ok, place.reshape(-1)


def descend(queries: DataFrame, nodes: DataFrame, keys: DataFrame, levels: int, slack: float = vec.SLACK, keep: tuple[str, ...] = ()) -> DataFrame:
    """Tree search from the top level down: query_id, pos, score and ``keep`` of all hits.

    ``nodes([head, ]level, node, parent, center, radius)`` from level 1 up,
    ``keys([head, ]pos, key, parent)``.  Every key comes with the balls of its
    ancestors, by one equi-join a level: a batch judges each ancestor path once, and multiplies
    only keys below a path that a query passes.  No row or list grows with the queries.
    """
    own, out = heads(nodes, keys), []
    path = _paths(nodes, levels)[1].select(*own, F.col("node").alias("parent"), "centers", "radii")
    rows = keys.select(*own, "parent", "pos", "key", *keep).join(path, [*own, "parent"])
    kinds = "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def make(asked: Asked, batch: pa.RecordBatch, state: dict) -> Iterator[dict]:
        k, pos, parent = matrix(batch.column("key")), batch.column("pos").to_numpy(), batch.column("parent").to_numpy()
        centers, radii = matrix(batch.column("centers")), matrix(batch.column("radii"))
        for head, mine in _by_head(batch):
            of = asked.of_head(head)
            step = max(1, PAIRS // max(1, len(of)))
            for at in range(0, len(mine) if len(of) else 0, step):
                part = mine[at : at + step]
                ok, place = _reached(asked, of, parent[part], centers[part], radii[part], slack)
                some = np.flatnonzero(ok.any(axis=1)[place])
                if not len(some):
                    continue
                x = k[part[some]]
                row, col = np.nonzero((x @ asked.vectors[of].T >= asked.limits[of] - near(x, asked, of)) & ok[place[some]])
                s = summed(x[row], asked.vectors[of[col]])
                hit = s >= asked.limits[of[col]]
                at_ = part[some[row[hit]]]
                yield {"query_id": asked.ids[of[col[hit]]], "pos": pos[at_], "score": s[hit]} | {c: batch.column(c).take(pa.array(at_)) for c in keep}

    for part in ask(queries):
        out.append(meet(rows, part, FOUND + kinds, make))
    return reduce(DataFrame.union, out)


def descent_profile(queries: DataFrame, nodes: DataFrame, levels: int, slack: float = vec.SLACK) -> DataFrame:
    """query_id, level, checked, passed: nodes of each level that a tree search compares and those that pass; each task sends two numbers a query and level."""
    own = heads(nodes)
    dim = F.size("centers") / F.size("radii")
    every = []
    for level, path in _paths(nodes, levels).items():
        above = lambda c, n: F.slice(c, (n + 1).cast("int"), F.greatest(F.size(c) - n, F.lit(0)).cast("int"))
        split_ = path.select(*own, "parent", F.slice("centers", 1, dim.cast("int")).alias("center"), F.get("radii", F.lit(0)).alias("radius"), above("centers", dim).alias("centers"), above("radii", F.lit(1)).alias("radii"))
        every.append((level, split_))

    def run(level: int):
        def make(asked: Asked, batch: pa.RecordBatch, state: dict) -> Iterator[dict]:
            c, r, parent = matrix(batch.column("center")), batch.column("radius").to_numpy(), batch.column("parent").to_numpy()
            up = (matrix(batch.column("centers")), matrix(batch.column("radii"))) if level < levels else None
            for name in ("checked", "passed") if not state else ():
                state[name] = np.zeros(len(asked.ids), np.int64)
            for head, mine in _by_head(batch):
                of = asked.of_head(head)
                step = max(1, PAIRS // max(1, len(of)))
                for at in range(0, len(mine) if len(of) else 0, step):
                    part = mine[at : at + step]
                    if up is None:
                        before = np.ones((len(part), len(of)), bool)
                    else:
                        ok, place = _reached(asked, of, parent[part], up[0][part], up[1][part], slack)
                        some = np.flatnonzero(ok.any(axis=1)[place])
                        part, before = part[some], ok[place[some]]
                    t = asked.limits[of]
                    passed = before & (c[part] @ asked.vectors[of].T + asked.norms[of] * r[part, None] + slack * np.maximum(np.abs(t), 1.0) >= t)
                    state["checked"][of] += before.sum(axis=0)
                    state["passed"][of] += passed.sum(axis=0)
            return iter(())

        def end(asked: Asked, state: dict) -> Iterator[dict]:
            some = np.flatnonzero(state["checked"]) if state else []
            if len(some):
                yield {"query_id": asked.ids[some], "level": np.full(len(some), level, np.int32)} | {name: x[some] for name, x in state.items()}

        return make, end

    kinds = "query_id bigint, level int, checked bigint, passed bigint"
    out = [meet(rows, part, kinds, *run(level)) for part in ask(queries) for level, rows in every]
    return reduce(DataFrame.union, out).groupBy("query_id", "level").agg(F.sum("checked").alias("checked"), F.sum("passed").alias("passed"))
