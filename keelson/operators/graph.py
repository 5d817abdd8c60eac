"""A hierarchical neighbour graph over unit keys, in shards: built by insertion, searched from the top level down.

Positions draw their level from a fixed hash, a key being on each level with a chance of
1 in LINKS of being on the one below.  A key is inserted where a greedy descent and then a
beam on each of its levels lead; of the keys found it links to those that are
nearer to it than to any key already linked, so that links point different ways, and keys
that get too many links choose again by the same rule.  A tree of first links is never
thinned out, so that a shard's lowest level is in one piece.  No shard's keys are compared all with all.

Shards are dealt by a hash of the position, SHARD keys or so in each, which bounds
a task's memory and time; a shard's graph is a set of rows of the stored table,
and a search visits every shard and ranks what the shards return.  Search is
approximate: the beam that finds enough depends on the keys and on how many a shard holds,
so every shard widens its own until it finds ENOUGH of what a full scan of the shard gives
TRIED of the queries.  A beam that holds a quarter of a shard's keys looks at about all of them: there
the queries meet the shard as one matrix product.  A task keeps the best of all its shards.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.functions import vec
from keelson.operators.blocks import split
from keelson.operators.lineage import shared_folder
from keelson.operators.quantizers import mixed
from keelson.operators.search import FOUND, NEAR, PAIRS, heads, k_best, summed, summed_at, top_k

#: Keys of a shard, links of a key (twice as many on the lowest level), and the width of the beam while building.
SHARD, LINKS, BUILD_BEAM = 1 << 14, 12, 64
#: Queries of a block that a shard tries its beam on, the share of their best keys that it must find, and its first width.
TRIED, ENOUGH, BEAM = 64, 0.95, 64
#: Keys of a shard for each that a beam holds, up to which all are compared instead.
SPARSE = 4
ROW = "shard bigint, pos bigint, key array<double>, links array<array<int>>"


def level_of(pos: int, links: int = LINKS) -> int:
    """The highest level of a position: each level holds one in ``links`` of those below it."""
    x = (pos * 0x9E3779B97F4A7C15 + 0x7F4A7C15) & (1 << 64) - 1
    x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    return int(-np.log(((x >> 11) + 1) / (1 << 53)) / np.log(links))


class Graph:
    """One shard: unit vectors, and for each vector a list of links on each of its levels."""

    def __init__(self, units: np.ndarray, links: list[list[list[int]]], most: int = LINKS):
        self.units, self.links, self.most = units, links, most
        self.tied: list[set[int]] = []  # while building: the tree that holds the lowest level together
        self.small = False  # while building: few enough keys to compare a new one with all
        self.entry = max(range(len(links)), key=lambda i: len(links[i]), default=-1)

    @classmethod
    def build(cls, units: np.ndarray, levels: list[int], most: int = LINKS, beam: int = BUILD_BEAM) -> Graph:
        graph = cls(units, [], most)
        graph.small = len(units) <= SPARSE * beam
        for i, level in enumerate(levels):
            graph._insert(i, level, beam)
        graph.small = False
        return graph

    def _insert(self, i: int, level: int, beam: int) -> None:
        self.links.append([[] for _ in range(level + 1)])
        self.tied.append(set())
        if self.entry < 0:
            self.entry = i
            return
        q, top = self.units[i], len(self.links[self.entry]) - 1
        at = self._descend(q, level)
        for lv in range(min(level, top), -1, -1):
            found = self.beam(q, at, beam, lv)
            mine = self._spread(found, self.most)
            if lv == 0:
                up = next((j for _, j in found if len(self.tied[j]) < self.most), found[0][1])
                self.tied[i].add(up)
                self.tied[up].add(i)
                mine += [up] if up not in mine else []
            self.links[i][lv] = mine
            for j in mine:
                self.links[j][lv].append(i)
                self._thin(j, lv)
            at = [j for _, j in found]
        if level > top:
            self.entry = i

    def _thin(self, j: int, lv: int) -> None:
        """Links of a key that has too many are chosen again; on the lowest level those of the tree stay."""
        theirs, most = self.links[j][lv], self.most * (2 if lv == 0 else 1)
        if len(theirs) <= most:
            return
        tied = self.tied[j] if lv == 0 else set()
        near = sorted(zip((self.units[theirs] @ self.units[j]).tolist(), theirs, strict=True), reverse=True)
        self.links[j][lv] = [*tied, *self._spread([x for x in near if x[1] not in tied], most - len(tied))]

    def _descend(self, q: np.ndarray, down_to: int) -> list[int]:
        """The nearest key that greedy steps reach on the levels above ``down_to``."""
        at = self.entry
        s = float(self.units[at] @ q)
        for lv in range(len(self.links[self.entry]) - 1, down_to, -1):
            while near := self.links[at][lv]:
                sims = self.units[near] @ q
                best = int(sims.argmax())
                if sims[best] <= s:
                    break
                at, s = near[best], float(sims[best])
        return [at]

    def beam(self, q: np.ndarray, start: list[int], width: int, level: int) -> list[tuple[float, int]]:
        """(similarity, key) of the ``width`` best keys that links from ``start`` lead to, best first."""
        if level == 0 and self.small:  # links lead everywhere on the lowest level
            sims = self.units[: len(self.tied)] @ q
            return sorted(zip(sims.tolist(), range(len(sims)), strict=True), reverse=True)[: width + 1]
        best = [(float(s), j) for s, j in zip(self.units[start] @ q, start, strict=True)]
        seen, todo = set(start), [(-s, j) for s, j in best]
        heapq.heapify(best)
        heapq.heapify(todo)
        while todo:
            s, j = heapq.heappop(todo)
            if len(best) >= width and -s < best[0][0]:
                break
            fresh = [n for n in self.links[j][level] if n not in seen]
            if not fresh:
                continue
            seen.update(fresh)
            for t, n in zip((self.units[fresh] @ q).tolist(), fresh, strict=True):
                if len(best) < width:
                    heapq.heappush(best, (t, n))
                elif t > best[0][0]:
                    heapq.heapreplace(best, (t, n))
                else:
                    continue
                heapq.heappush(todo, (-t, n))
        return sorted(best, reverse=True)

    def _spread(self, found: list[tuple[float, int]], most: int) -> list[int]:
        """Of keys by similarity, those that are nearer to the new one than to any taken before; the nearest others fill up."""
        taken, passed, own = [], [], self.units[[j for _, j in found]]
        between, least = own @ own.T, np.full(len(found), -np.inf)  # how near each is to the nearest one taken
        for i, (s, j) in enumerate(found):
            if len(taken) == most:
                break
            if s > least[i]:
                taken.append(j)
                np.maximum(least, between[i], out=least)
            else:
                passed.append(j)
        return taken + passed[: most - len(taken)]

    def search(self, q: np.ndarray, k: int, width: int) -> list[int]:
        return [j for _, j in self.beam(q, self._descend(q, 0), max(width, k), 0)[:k]] if self.links else []


    def nearby(self, q: np.ndarray, x: np.ndarray, k: int, width: int) -> np.ndarray:
        """Places of the k keys of ``x`` with the largest products among those that a beam finds: the graph goes by angles, so the whole beam is scored anew."""
        best = np.array(self.search(q / max(np.linalg.norm(q), 1e-12), max(k, width), width), np.int64)
        return best[np.argsort(-(x[best] @ q), kind="stable")[:k]]

    def wide_enough(self, queries: np.ndarray, x: np.ndarray, k: int, width: int = BEAM) -> int:
        """The least doubling of ``width`` whose beams find ENOUGH of the k best keys of ``queries``; as many as there are keys finds all."""
        k = min(k, len(x))
        scores = queries @ x.T
        least = np.partition(scores, len(x) - k, axis=1)[:, len(x) - k] - 1e-9 * np.abs(scores).max(axis=1, initial=0.0) if k else None
        while k and width < len(x):
            hits = sum(int((scores[i, self.nearby(q, x, k, width)] >= least[i]).sum()) for i, q in enumerate(queries))
            if hits >= ENOUGH * k * len(queries):
                break
            width *= 2
        return width


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class GraphIndex:
    """The stored graphs of all shards of ``keys([head, ]pos, key)``."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    @classmethod
    def build(cls, keys: DataFrame, shard: int = SHARD, path: str | None = None) -> GraphIndex:
        """Every shard's graph is built in one task, positions in ascending order; the rows are written once."""
        spark, own = keys.sparkSession, heads(keys)
        shards = max(1, -(-keys.count() // shard))
        dealt = keys.select(*own, F.shiftright(mixed() * shards, 32).alias("shard"), "pos", vec.doubles("key").alias("key"))

        def run(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("pos", kind="stable").reset_index(drop=True)
            graph = Graph.build(_units(np.array(group["key"].tolist(), float)), [level_of(int(p)) for p in group["pos"]])
            return group.assign(links=graph.links)

        schema = ("head int, " if own else "") + ROW
        made = dealt.groupBy(*own, "shard").applyInPandas(run, schema)
        path = path or f"{shared_folder(spark)}/keelson-graph-{uuid.uuid4().hex}"
        made.write.parquet(path)
        return cls(spark.read.schema(made.schema).parquet(path))

    def shards(self) -> int:
        return self.rows.select(*heads(self.rows), "shard").distinct().count()

    def search(self, queries: DataFrame, k: int, width: int | None = None) -> DataFrame:
        """query_id, pos, score, rank: the best of what every shard's graph returns, by the product with the key itself; beams of ``width``, or as wide as a shard needs."""
        return top_k(reduce(DataFrame.union, [self._block(part, k, width) for part in split(queries)]), k)

    def _block(self, queries: DataFrame, k: int, width: int | None) -> DataFrame:
        own, of = heads(self.rows), heads(self.rows, queries)
        asked = queries.select("query_id", *of, vec.doubles("query").alias("query")).toPandas()  # a block
        q = np.array(asked["query"].tolist(), float).reshape(len(asked), -1)
        shared = self.rows.sparkSession.sparkContext.broadcast((asked["query_id"].to_numpy(np.int64), q, asked["head"].to_numpy() if of else None))

        by, size = [*own, "shard"], SPARSE * max(k, BEAM) if width is None else max(k, width)

        def found(group: pd.DataFrame, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            """Queries, positions and scores of a shard; those below a query's ``least`` may be left out."""
            _, vectors, head = shared.value
            x, pos = np.array(group["key"].tolist(), float), group["pos"].to_numpy()
            mine = np.arange(len(vectors)) if head is None else np.flatnonzero(head == group["head"].iloc[0])
            beam, graph = len(x), None
            if len(x) > size:
                graph = Graph(_units(x), [[list(level) for level in links] for links in group["links"]])
                beam = width or graph.wide_enough(vectors[mine[:: max(1, -(-len(mine) // TRIED))]], x, k, max(k, BEAM))
            if max(k, beam) * (SPARSE if width is None else 1) < len(x):
                for i in mine:
                    best = np.array(graph.search(vectors[i] / max(np.linalg.norm(vectors[i]), 1e-12), max(k, beam), beam), np.int64)
                    yield np.full(len(best), i), pos[best], summed(x[best], np.broadcast_to(vectors[i], x[best].shape))
                return
            far = np.sqrt((x * x).sum(axis=1).max())
            for at in range(0, len(mine), step := max(1, PAIRS // len(x))):
                part = mine[at : at + step]
                q = np.ascontiguousarray(vectors[part].T)
                rough, apart = x @ q, NEAR * far * np.sqrt((q * q).sum(axis=0)) + 1e-300
                limit = least[part] - apart
                if len(x) > k:
                    limit = np.maximum(limit, np.partition(rough, len(x) - k, axis=0)[len(x) - k] - 2 * apart)
                row, col = np.nonzero(rough >= limit)
                yield part[col], pos[row], summed_at(x, q, row, col)

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids = shared.value[0]
            held, rows, least = [], 0, np.full(len(ids), -np.inf)
            for group in _groups(frames, by):
                for more in found(group, least):
                    held.append(more)
                    rows += len(more[0])
                    if rows > 4 * k * len(ids) + PAIRS:
                        held = [k_best(held, k)]
                        col, _, s = held[0]
                        rows, full = len(col), np.bincount(col, minlength=len(ids)) == k
                        np.minimum.at(last := np.full(len(ids), np.inf), col, s)
                        least[full] = last[full]
            if held:
                col, pos, s = k_best(held, k)
                yield pd.DataFrame({"query_id": ids[col], "pos": pos, "score": s})

        parts = max(1, min(self.shards(), 4 * self.rows.sparkSession.sparkContext.defaultParallelism))
        return self.rows.repartition(parts, *by).sortWithinPartitions(*by, "pos").mapInPandas(run, FOUND)


def _groups(frames: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of rows that come group after group."""
    held, last = [], None
    for frame in frames:
        for name, group in frame.groupby(by, sort=False):
            if held and name != last:
                yield pd.concat(held, ignore_index=True)
                held = []
            last = name
            held.append(group)
    if held:
        yield pd.concat(held, ignore_index=True)
