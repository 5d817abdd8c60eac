"""Ranks and running sums within groups that may be as large as the table.

A window over a whole group is one task.  Here such groups are cut into ranges
of their order, each range is ranked by itself, and the counts and sums of the
ranges before it are added: one shuffle, and a small table of one row a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.operators.blocks import measured
from keelson.operators.lineage import cut

#: Rows of a table whose groups are ranked in one task each.
FEW = 1 << 18


def running(df: DataFrame, by: list[str], order: list[Column], sums: dict[str, str] | None = None, rank: str = "rank", few: int | None = None) -> DataFrame:
    """``df`` with ``rank`` (from 1 within ``by``, in ``order``, which must decide ties) and inclusive sums: new name -> column."""
    sums = sums or {}
    kept = cut(df)
    every = Window.partitionBy(*by).orderBy(*order)
    total = lambda w: {name: F.sum(column).over(w.rowsBetween(Window.unboundedPreceding, 0)) for name, column in sums.items()}
    if kept.count() <= (FEW if few is None else few):
        return kept.withColumns({rank: F.row_number().over(every), **total(every)})
    # the ranges are sampled: what is ranked and what is counted must be the same ones
    ranged = cut(kept.repartitionByRange(*by, *order).withColumn("range_", F.spark_partition_id()))
    own = Window.partitionBy(*by, "range_").orderBy(*order)
    inside = ranged.withColumns({rank: F.row_number().over(own), **total(own)})
    ranges = ranged.groupBy(*by, "range_").agg(F.count("*").alias("rows_"), *[F.sum(c).alias(f"sum_{name}_") for name, c in sums.items()])
    before = Window.partitionBy(*by).orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select(*by, "range_", F.coalesce(F.sum("rows_").over(before), F.lit(0)).alias("rows_"), *[F.coalesce(F.sum(f"sum_{name}_").over(before), F.lit(0.0)).alias(f"sum_{name}_") for name in sums])
    both = inside.join(measured(offsets), [*by, "range_"])
    return both.withColumns({rank: F.col(rank) + F.col("rows_"), **{name: F.col(name) + F.col(f"sum_{name}_") for name in sums}}).select(*df.columns, rank, *sums)
