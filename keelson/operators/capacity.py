"""Clusters of a bounded size: Lloyd rounds with reseeding, then keys and centres are matched.

Keys and centres both rank each other by distance (ties by number and by position),
so there is one stable outcome: no key and centre would rather have each other than
what they have.  It is reached in rounds that settle many pairs at once.  In a round
every free key proposes to its nearest centre with room.  A centre accepts a proposer if
fewer free keys lie nearer to it than it has room for, those counted that proposed elsewhere: what
it accepts it would never give up.  The nearest pair of all is always accepted,
so every round shrinks what the next one looks at.  Rounds get many while little is left to settle:
once FINISH pairs or fewer are left, one task a head settles them by deferred acceptance.

All of it runs over whole heads.  Keys meet the centres in blocks of BLOCK_CENTERS, one
broadcast and one narrow pass each, and a broadcast ends with its pass; a centre that very many keys contest gets
``bf`` of a task's keys at most, so that no group reaches the shuffle whole.  Work grows
with keys times centres of a head: larger heads are given as coarse
cells (``quantizers.ListIndex``), each as a head of its own.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelson.functions import vec
from keelson.operators.blocks import measured
from keelson.operators.lineage import cut
from keelson.operators.quantizers import mixed
from keelson.operators.ranks import running
from keelson.operators.search import NEAR, PAIRS, heads, matrix

#: Centres of one broadcast; pairs of a free key and a centre with room that one task settles, and how many keys and centres it may hold.
BLOCK_CENTERS, FINISH, FINISH_ROWS = 1 << 14, 1 << 23, 1 << 16


def _meet(keys: DataFrame, centers: DataFrame, kinds: str, make: Callable[[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict], dict]) -> DataFrame:
    """``make(batch, rows, keys, squares, slack, block)`` for the keys of each batch and a block of their head's centres, PAIRS at a time; its columns have ``kinds``.

    Squared distances come from a matrix product, and are within ``slack`` (one a row) of the exact ones: what is close is to be measured by ``_apart``.
    """
    own = heads(keys, centers)
    parts = max(1, -(-centers.count() // BLOCK_CENTERS))
    blocks = [centers.where(F.pmod(F.xxhash64("cluster"), F.lit(parts)) == p) for p in range(parts)] if parts > 1 else [centers]

    def one(block: DataFrame) -> DataFrame:
        rows = block.toArrow().combine_chunks()  # a block
        rows = rows.sort_by("cluster")
        head, by_head = rows.column("head").to_numpy() if own else np.zeros(len(rows)), {}
        columns = {c: rows.column(c).to_numpy() for c in rows.column_names if c not in ("head", "center")} | {"center": matrix(rows.column("center").combine_chunks()) if len(rows) else np.zeros((0, 0))}
        for h in np.unique(head) if own else [None]:
            by_head[h] = {c: v[head == h] if own else v for c, v in columns.items()}
        shared = keys.sparkSession.sparkContext.broadcast(by_head)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(batch.column("key")) if batch.num_rows else np.zeros((0, 0))
                head = batch.column("head").to_numpy() if own else None
                for h, known in shared.value.items():
                    mine, c = np.flatnonzero(head == h) if own else np.arange(len(x)), known["center"]
                    if not len(c):  # none has room left
                        continue
                    turned, size = np.ascontiguousarray(-2 * c.T), (c * c).sum(1)
                    for at in range(0, len(mine), step := max(1, PAIRS // len(c))):
                        part = mine[at : at + step]
                        own_x = x[part]
                        length = (own_x * own_x).sum(1)
                        squares = own_x @ turned
                        squares += size
                        squares += length[:, None]
                        cols = make(batch, part, own_x, squares, NEAR * (length + size.max()) + 1e-300, known)
                        cols = {"head": np.full(len(cols["pos"]), h, np.int32)} | cols if own else cols
                        yield pa.RecordBatch.from_arrays([pa.array(v) for v in cols.values()], list(cols))

        made = cut(keys.mapInArrow(run, ("head int, " if own else "") + kinds))
        shared.destroy()  # rounds would leave a block each with the driver
        return made

    return reduce(DataFrame.union, [one(b) for b in blocks])


def _apart(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Distances of rows, summed from the first dimension to the last."""
    d = np.zeros(len(x))
    for j in range(x.shape[1]):
        d += (x[:, j] - c[:, j]) ** 2
    return np.sqrt(d)


def nearest_of(keys: DataFrame, centers: DataFrame) -> DataFrame:
    """[head, ]pos, d, cluster: each key's nearest of ``centers([head, ]cluster, center)``, of equal ones the least number."""

    def make(batch: pa.RecordBatch, rows: np.ndarray, x: np.ndarray, squares: np.ndarray, slack: np.ndarray, known: dict) -> dict:
        row, col = np.nonzero(squares <= (squares.min(1) + 2 * slack)[:, None])
        d = _apart(x[row], known["center"][col])
        by = np.lexsort((col, d, row))
        first = by[np.flatnonzero(np.diff(row[by], prepend=-1))]
        return {"pos": batch.column("pos").to_numpy()[rows], "d": d[first], "cluster": known["cluster"][col[first]]}

    own = heads(keys, centers)
    found = _meet(keys.select(*own, "pos", "key"), centers.select(*own, "cluster", "center"), "pos bigint, d double, cluster bigint", make)
    least = F.min(F.struct("d", "cluster")).alias("x")
    return found.groupBy(*own, "pos").agg(least).select(*own, "pos", "x.d", "x.cluster") if centers.count() > BLOCK_CENTERS else found


def trained_centers(keys: DataFrame, bf: int, dim: int, rounds: int = 10) -> DataFrame:
    """[head, ]cluster, center: ceil(n / bf) centres a head by Lloyd rounds; the centres without keys become the keys that lie farthest from theirs."""
    own = heads(keys)
    sizes = keys.groupBy(*own).agg(F.ceil(F.count("*") / bf).alias("k_"))
    ranked = running(keys.select(*own, "pos", vec.doubles("key").alias("center")), own, [mixed(), F.col("pos")])
    seeds = (ranked.join(measured(sizes), own) if own else ranked.crossJoin(F.broadcast(sizes))).where(F.col("rank") <= F.col("k_"))  # one row
    now = cut(seeds.select(*own, (F.col("rank") - 1).cast("long").alias("cluster"), "center"))
    for _ in range(rounds):
        placed = cut(keys.select(*own, "pos", "key").join(nearest_of(keys, now), [*own, "pos"]))
        means = cut(placed.groupBy(*own, "cluster").agg(vec.each_dim(dim, lambda i: F.avg(F.get(vec.doubles("key"), F.lit(i)))).alias("center")))
        empty = cut(now.join(means, [*own, "cluster"], "left_anti").select(*own, "cluster"))
        if (most := empty.count()) == 0:
            now = means
            continue
        numbered = running(empty, own, [F.col("cluster")], rank="r_")
        farthest = placed.withColumn("r_", F.row_number().over(Window.partitionBy(*own).orderBy(F.desc("d"), "pos"))).where(F.col("r_") <= most)
        now = cut(means.unionByName(numbered.join(farthest.select(*own, "r_", vec.doubles("key").alias("center")), [*own, "r_"]).select(*own, "cluster", "center")))
    return now


def _intruders(free: DataFrame, edges: DataFrame, bf: int) -> DataFrame:
    """[head, ]pos, d, cluster: free keys that lie within the ``edge`` of a centre they did not propose to; the ``bf`` nearest of a batch."""

    def make(batch: pa.RecordBatch, rows: np.ndarray, x: np.ndarray, squares: np.ndarray, slack: np.ndarray, known: dict) -> dict:
        pos, mine = batch.column("pos").to_numpy()[rows], batch.column("cluster").to_numpy()[rows]
        squares -= 2 * slack[:, None]
        row, col = np.nonzero(squares <= (known["edge"] ** 2)[None])
        other = known["cluster"][col] != mine[row]
        row, col = row[other], col[other]
        d = _apart(x[row], known["center"][col])
        inside = d <= known["edge"][col]
        row, col, d = row[inside], col[inside], d[inside]
        by = np.lexsort((pos[row], d, col))
        row, col, d = row[by], col[by], d[by]
        first = np.flatnonzero(np.diff(col, prepend=-1))
        keep = np.arange(len(col)) - np.repeat(first, np.diff(np.append(first, len(col)))) < bf
        return {"pos": pos[row[keep]], "d": d[keep], "cluster": known["cluster"][col[keep]]}

    return _meet(free, edges, "pos bigint, d double, cluster bigint", make)


def _finished(free: DataFrame, room: DataFrame) -> DataFrame:
    """[head, ]pos, cluster, distance of what is left, by deferred acceptance: one task a head."""
    own = heads(free, room)

    def run(keys: pd.DataFrame, left: pd.DataFrame) -> pd.DataFrame:
        names = [*own, "pos", "cluster", "distance"]
        if not (len(keys) and len(left)):
            return pd.DataFrame([], columns=names)
        left = left.sort_values("cluster", kind="stable")
        x, pos = np.array(keys["key"].tolist(), float), keys["pos"].tolist()
        c, most = np.array(left["center"].tolist(), float), left["room"].tolist()
        d = np.empty((len(x), len(c)))
        for i in range(len(x)):
            d[i] = _apart(np.broadcast_to(x[i], c.shape), c)
        lists, step = np.argsort(d, axis=1, kind="stable"), [0] * len(x)
        held: list[list[tuple[float, int, int]]] = [[] for _ in most]  # the worst first
        todo = list(range(len(x)))[::-1]
        while todo:
            i = todo.pop()
            if step[i] == len(c):
                continue
            j = int(lists[i, step[i]])
            step[i] += 1
            heapq.heappush(held[j], (-d[i, j], -pos[i], i))
            if len(held[j]) > most[j]:
                todo.append(heapq.heappop(held[j])[2])
        found = [(pos[i], int(left["cluster"].iloc[j]), -far) for j, group in enumerate(held) for far, _, i in group]
        return pd.DataFrame([(*keys[own].iloc[0], *row) for row in found], columns=names)

    kinds = ("head int, " if own else "") + "pos bigint, cluster bigint, distance double"
    by = "head" if own else "all_"
    one = lambda t: t if own else t.withColumn("all_", F.lit(0))
    rows = one(free.select(*own, "pos", vec.doubles("key").alias("key")))
    return rows.groupBy(by).cogroup(one(room.select(*own, "cluster", "center", "room")).groupBy(by)).applyInPandas(run, kinds)


def matched(keys: DataFrame, centers: DataFrame, bf: int) -> DataFrame:
    """[head, ]pos, cluster, distance of ``keys([head, ]pos, key)``: the stable outcome in which no centre has more than ``bf`` keys.

    Centres need room for all keys of their head: keys that none has room for are left out.
    """
    own = heads(keys, centers)
    on, settled = [*own, "cluster"], []
    free = cut(keys.select(*own, "pos", "key"))
    room = cut(centers.select(*own, "cluster", vec.doubles("center").alias("center"), F.lit(bf).alias("room")))
    rank = F.row_number().over(Window.partitionBy(*on).orderBy("d", "pos"))
    once = free.groupBy(*own, "pos").count().where("count > 1").isEmpty()  # rounds settle all rows of a position together
    while True:
        left, open_ = free.count(), room.count()
        if once and left * open_ <= FINISH and left + open_ <= FINISH_ROWS:
            settled.append(cut(_finished(free, room).select(*own, "pos", "cluster", "distance")))
            return reduce(DataFrame.unionByName, settled)
        wishes = cut(free.join(nearest_of(free, room), [*own, "pos"]))
        if wishes.isEmpty():
            return reduce(DataFrame.unionByName, settled or [wishes.select(*own, "pos", "cluster", F.col("d").alias("distance"))])
        chosen = wishes.select(*own, "pos", "d", "cluster").withColumn("r_", rank).where(F.col("r_") <= bf).join(room.select(*on, "room"), on).where(F.col("r_") <= F.col("room"))
        chosen = cut(chosen.select(*own, "pos", "d", "cluster", F.lit(True).alias("asked")))
        edges = chosen.groupBy(*on).agg(F.max("d").alias("edge")).join(room, on).select(*on, "center", "edge")
        others = _intruders(wishes.select(*own, "pos", "key", "cluster"), edges, bf).withColumn("asked", F.lit(False))
        judged = chosen.unionByName(others).withColumn("r_", rank).where(F.col("r_") <= bf).join(room.select(*on, "room"), on)
        accepted = cut(judged.where(F.col("asked") & (F.col("r_") <= F.col("room"))).select(*own, "pos", "cluster", F.col("d").alias("distance")))
        settled.append(accepted)
        free = cut(free.join(accepted.select(*own, "pos"), [*own, "pos"], "left_anti"))
        taken = accepted.groupBy(*on).agg(F.count("*").alias("n_"))
        room = cut(room.join(taken, on, "left").withColumn("room", (F.col("room") - F.coalesce("n_", F.lit(0))).cast("int")).where("room > 0").drop("n_"))


def bounded(keys: DataFrame, bf: int, dim: int, rounds: int = 10) -> DataFrame:
    """``keys`` with ``cluster``: ceil(n / bf) clusters a head, each of ``bf`` keys at most, around trained centres."""
    own = heads(keys)
    placed = matched(keys, trained_centers(keys, bf, dim, rounds), bf)
    return keys.join(placed.select(*own, "pos", "cluster"), [*own, "pos"])
