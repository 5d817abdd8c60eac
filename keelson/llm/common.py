"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of one Arrow batch are handed to the operators in slices of about this many text bytes.
SLICE_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for cut lineage; a temporary one only for a local session that names none."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="keelson-checkpoint-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage through the shared checkpoint folder."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, so that it is computed once."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/keelson-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, stem: str) -> str:
    """A name that no column of ``df`` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def quoted(name: str) -> str:
    """A column's name as it stands, dots and backticks included."""
    return "`" + name.replace("`", "``") + "`"


#: Keys that may be hot at once, and rows below which no key is.
MOST_HOT, LEAST_HOT = 2000, 200


def _hot_rows(groups: DataFrame, total: int) -> DataFrame | None:
    """The rows of ``groups(..., n)`` with more than ``total / MOST_HOT`` rows each: MOST_HOT at most, as a local table."""
    bound = max(LEAST_HOT, total // MOST_HOT)
    rows = groups.where(F.col("n") > bound).collect() if total > bound else []
    return F.broadcast(groups.sparkSession.createDataFrame(rows, groups.schema)) if rows else None


def with_groups(rows: DataFrame, key: str, made: dict[str, Column], total: int) -> DataFrame:
    """``rows`` with aggregates over all rows of the same ``key``, of ``total`` rows altogether.

    A key with more than ``total / MOST_HOT`` rows would land in one task;
    there are at most MOST_HOT of them, whose aggregates combine before they
    shuffle and come back as a broadcast.  All others go through a window.
    """
    groups = rows.groupBy(key).agg(F.count("*").alias("n"), *[x.alias(name) for name, x in made.items()])
    hot = _hot_rows(groups, total)
    over = Window.partitionBy(key)
    if hot is None:
        return rows.withColumns({name: x.over(over) for name, x in made.items()})
    rest = rows.join(hot.select(key), key, "left_anti").withColumns({name: x.over(over) for name, x in made.items()})
    return rows.join(hot.drop("n"), key).unionByName(rest)


def join_unique(left: DataFrame, right: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join with the written table ``right(key, n, ...)``, which has one row a key; ``n`` is how many of the ``total`` rows of ``left`` have it.

    Hot keys are broadcast, as in ``with_groups``, and their rows of ``left``
    stay where they are.  ``n`` is dropped.
    """
    hot = _hot_rows(right, total)
    if hot is None:
        return left.join(right.drop("n"), key)
    rest = left.join(hot.select(key), key, "left_anti").join(right.drop("n"), key)
    return left.join(hot.drop("n"), key).unionByName(rest)


def slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into pieces of at most ``limit`` bytes (one row at least)."""
    n = batch.num_rows
    if not n:
        return
    step = max(1, int(n * limit / max(batch.nbytes, 1)))
    for at in range(0, n, step):
        yield batch.slice(at, step)


def map_columns(df: DataFrame, schema: str, fn: Callable[[dict[str, list]], dict[str, list]], limit: int = SLICE_BYTES) -> DataFrame:
    """``mapInArrow`` over Python lists: ``fn`` gets the columns of a slice of ``limit`` bytes and returns the output columns."""

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, limit):
                cols = fn({k: piece.column(i).to_pylist() for i, k in enumerate(piece.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], type=f.type) for f in out], schema=out)

    return df.mapInArrow(run, schema)
