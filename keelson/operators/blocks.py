"""Joins with small sides whose size is measured before they are broadcast.

A query set comes to the rows in blocks of at most about ``BLOCK`` vectors, so
that no broadcast grows with it; tables of a row per query are computed once,
measured, and broadcast only up to ``FEW`` rows and ``MAX_BYTES``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.operators.lineage import cut, size_of

#: Vectors of one broadcast; rows without vectors of one broadcast, and their bytes.
BLOCK, FEW, MAX_BYTES = 4096, 1_000_000, 64 << 20


def split(queries: DataFrame, id_col: str = "query_id") -> list[DataFrame]:
    """The query set in as many parts, by a hash of its id, as leave about BLOCK rows or fewer in each."""
    parts = -(-queries.count() // BLOCK)
    if parts <= 1:
        return [queries]
    return [queries.where(F.pmod(F.xxhash64(id_col), F.lit(parts)) == p) for p in range(parts)]


def against(rows: DataFrame, queries: DataFrame, on: str | list[str] | Column | None = None, id_col: str = "query_id") -> DataFrame:
    """Every query with every row, or with those that ``on`` names.

    Rows are never shuffled: each part of the query set is one broadcast and
    one narrow pass over the rows.
    """
    out = None
    for part in split(queries, id_col):
        met = rows.crossJoin(F.broadcast(part)) if on is None else rows.join(F.broadcast(part), on)
        out = met if out is None else out.union(met)
    return out


def measured(table: DataFrame) -> DataFrame:
    """``table`` computed once; marked for broadcast if it has FEW rows and MAX_BYTES or fewer, else joined as its size asks for."""
    kept = cut(table)
    rows, size = size_of(kept)
    return F.broadcast(kept) if rows <= FEW and size <= MAX_BYTES else kept
