"""Keys, queries and captures as tables; readers, writers and generators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.sources.prompts import KINDS, ROWS, PromptSource

KEYS = "layer int, head int, pos bigint, key array<float>, value array<float>"
QUERIES = "query_id bigint, layer int, q_head int, step bigint, query array<float>"


def keys_of(spark: SparkSession, sf_dir: str, heads: int = 1, same_positions: bool = False) -> DataFrame:
    """``embeddings`` as keys: head, pos, key, value (half the key plus a quarter); with ``same_positions`` every head counts from 0, as captures do."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    pos = F.floor(F.col("vec_id") / heads).cast("long") if same_positions else F.col("vec_id")
    return e.select((F.col("vec_id") % heads).cast("int").alias("head"), pos.alias("pos"), F.col("embedding").alias("key"), F.transform("embedding", lambda x: x.cast("double") * 0.5 + 0.25).alias("value"))


def queries_of(spark: SparkSession, sf_dir: str, every: int = 50, heads: int = 1, key_heads: int | None = None) -> DataFrame:
    """The stated query set: the embeddings whose id is divisible by ``every``; dealt to ``heads``, which share ``key_heads`` if given."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(F.col("vec_id") % every == 0)
    if key_heads is None:
        return e.select(F.col("vec_id").alias("query_id"), (F.col("vec_id") % heads).cast("int").alias("q_head"), F.col("embedding").alias("query"))
    from keelson.operators.search import kv_head

    own = e.select(F.col("vec_id").alias("query_id"), (F.floor(F.col("vec_id") / every) % heads).cast("int").alias("q_head"), F.col("embedding").alias("query"))
    return own.withColumn("head", kv_head(F.col("q_head"), heads, key_heads))


def read_capture(spark: SparkSession, path: str, layer: int | None = None) -> DataFrame:
    """Captured rows with ``phase`` prefill or decode, as one key sequence; decode follows prefill."""
    rows = spark.read.parquet(path)
    odd = [c for c in ("layer", "head", "pos", "key", "phase") if c not in rows.columns]
    if odd:
        raise ValueError(f"a capture needs columns {odd}")
    if layer is not None:
        rows = rows.where(F.col("layer") == layer)
    prefill, decode = rows.where("phase = 'prefill'"), rows.where("phase = 'decode'")
    length = prefill.groupBy("layer", "head").agg((F.max("pos") + 1).alias("prompt"))
    moved = decode.join(length, ["layer", "head"], "left").withColumn("pos", F.col("pos") + F.coalesce("prompt", F.lit(0))).drop("prompt")
    return prefill.unionByName(moved)


def write_snapshot(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def store_by_position(keys: DataFrame, table: str, buckets: int = 64, path: str | None = None) -> DataFrame:
    """``keys([head, ]pos, ...)`` as a table bucketed and sorted by position, in the warehouse or at ``path``: the far store that selected rows are fetched from."""
    out = keys.write.mode("overwrite").bucketBy(buckets, "pos").sortBy("pos")
    (out.option("path", path) if path else out).saveAsTable(table)
    return keys.sparkSession.table(table)


def gather(selected: DataFrame, stored: DataFrame) -> DataFrame:
    """The rows of ``stored`` that ``selected(pos, ...[, head])`` names, with its columns: only the selection is shuffled, to the buckets; stored rows stay where they are."""
    on = [*(["head"] if "head" in selected.columns and "head" in stored.columns else []), "pos"]
    names = [c for c in selected.columns if c not in on and c in stored.columns]
    if names:
        raise ValueError(f"both sides have {names}")
    return selected.hint("merge").join(stored, on)


def append_csv(df: DataFrame, path: str) -> None:
    """Result rows added to a folder of CSV files."""
    df.write.mode("append").option("header", True).csv(path)


def read_prompts(spark: SparkSession, path: str, fields: tuple[str, ...] = ("input", "prompt", "text", "context")) -> DataFrame:
    """JSON lines with the first non-null of several prompt fields."""
    lines = spark.read.text(path)
    return lines.select(F.coalesce(*[F.get_json_object("value", f"$.{f}") for f in fields]).alias("prompt"), "value").where("prompt IS NOT NULL")


def read_tasks(spark: SparkSession, path: str, templates: dict[str, str]) -> DataFrame:
    """JSON lines of tasks (task, input, context, answers) with the prompt that each task's template makes; unknown tasks have none.

    Templates hold ``{context}`` and ``{input}``.
    """
    rows = spark.read.schema("task string, input string, context string, answers array<string>").json(path)
    form = F.try_element_at(F.create_map(*[F.lit(x) for kv in templates.items() for x in kv]), F.col("task"))
    filled = F.replace(F.replace(form, F.lit("{input}"), F.coalesce("input", F.lit(""))), F.lit("{context}"), F.coalesce("context", F.lit("")))
    return rows.withColumn("prompt", filled)


def sample_rows(df: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """A sampling operator: n rows in seeded random order."""
    return df.orderBy(F.rand(seed)).limit(n)


def clustered_keys(spark: SparkSession, n: int, dim: int = 64, centers: int = 20, spread: float = 0.15, length: float = 15.0, heads: int = 1, seed: int = 7) -> DataFrame:
    """A Gaussian mixture whose centres have norm ``length``: data in which gates can prune."""

    def gauss(salt: Column, i: int) -> Column:
        u = lambda k: (F.pmod(F.xxhash64(salt, F.lit(i), F.lit(k), F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
        return F.sqrt(-2 * F.log(u(0))) * F.cos(F.lit(6.283185307179586) * u(1))

    rows = spark.range(n).select((F.col("id") % heads).cast("int").alias("head"), F.col("id").alias("pos"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(centers)).alias("blob"))
    rows = rows.withColumn("c", F.array(*[gauss(F.concat(F.lit("c"), "blob"), i) for i in range(dim)]))
    size = F.sqrt(F.aggregate("c", F.lit(0.0), lambda a, x: a + x * x))
    rows = rows.withColumn("noise", F.array(*[gauss(F.concat(F.lit("n"), "pos"), i) for i in range(dim)]))
    key = F.zip_with(F.transform("c", lambda x: x * length / size), "noise", lambda x, e: (x + e * spread).cast("float"))
    return rows.select("head", "pos", key.alias("key"), "blob")


def retrieval_prompts(spark: SparkSession, count: int, kind: str = "single", needles: int = 4, filler: int = 200, seed: int = 0, rows: int | None = None) -> DataFrame:
    """Needle prompts: ``single``, ``multi``, ``chain`` (variable tracking) and ``common`` (most common words), made by the tasks that read them, ``rows`` a partition."""
    if kind not in KINDS:
        raise ValueError(f"no kind of prompt is called {kind}")
    spark.dataSource.register(PromptSource)
    options = {"count": count, "kind": kind, "needles": needles, "filler": filler, "seed": seed, "rows": rows or ROWS}
    return spark.read.format("prompts").options(**options).load()
