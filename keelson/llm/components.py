"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import cut, with_groups


def _state(edges: DataFrame) -> tuple:
    # summed in halves, so that no sum of hashes can overflow
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.sum(F.shiftright(h, 32)), F.sum(h.bitwiseAND(0xFFFFFFFF))).first())


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = with_groups(both, "u", {"m": F.min("v")}, 2 * total).withColumn("m", F.least("m", "u"))
    return least.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    least = with_groups(edges, "u", {"m": F.min("v")}, total)
    pairs = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
    return least.select(F.explode(pairs).alias("x")).select("x.u", "x.v").where("u <> v").distinct()


def contracted(edges: DataFrame, most_rounds: int = 60, settle: bool = True) -> DataFrame:
    """Edges ``u, v`` with ``v < u`` that join the same nodes as ``edges(u, v)``, drawn to ever smaller ``v``.

    Every round connects each node's neighbours to the least one, first the
    larger, then the smaller; the number of edges never grows, minima combine
    before they shuffle, nodes with very many edges get theirs by broadcast, and
    nothing is gathered.  When a round changes nothing, every node has one edge,
    to its component's least node; without ``settle`` it may end before.
    """
    pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = cut(pairs.where("u > v").distinct())
    state = _state(now)
    for _ in range(most_rounds):
        if not state[0]:
            return now
        after = cut(_small_star(cut(_large_star(now, state[0])), state[0]))
        before, state, now = state, _state(after), after
        if state == before:
            return now
    if settle:
        raise RuntimeError("components did not settle")
    return now


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node, root`` for every node of ``edges(u, v)``; the root is the component's least node.

    Self loops are ignored, and so are nodes that have no other edge.
    """
    now = contracted(edges, most_rounds)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v").distinct())
