"""Importance resampling towards a target: hashed word n-grams, additive gains, Gumbel scores.

Features are hashed into buckets that are counted over the raw documents and
over the target.  A bucket's gain is the scaled logarithm of its smoothed shares;
a document's weight is the sum of an array of gains over its features.  With a
Gumbel number made from its id the weight is a score, and the highest scores are a
draw without replacement in proportion to the weights.

Scores are integers, so the draw is exact without sorting documents.  A histogram counts
the documents of each score; sums over all higher scores are the ranks at which a score
begins; the lowest score that begins within the draw is the cutoff.  Only documents
at or above it are numbered, by id within their score.  The histogram is cut into
ranges of scores, whose sums alone (one number a range) come to the driver; a
score's documents are few of all, as the Gumbel numbers of different ids spread
them, copies of one text included.

Null texts and texts without words have no features and weight 0.  Repeated rows
each count and are each ranked; the order of rows with equal id and score is free.
A null id has the number of the empty id and comes before all others.  Without documents nothing is
drawn; without a target all gains come from the raw side.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelson.llm.common import cut, shared_table, slices

#: Buckets, words of the longest feature, words that a drawable document has, scale of gains and scores.
BUCKETS, ORDERS, LEAST_WORDS, SCALE = 10_000, 3, 20, 1000
#: The draw: SHARE hundredths of the drawable documents; the seed of their random numbers.
SHARE, SEED = 5, 42
#: Bytes of a text whose words are in memory at once.
STEP = 1 << 20

_word = re.compile(rb"[0-9a-z\x80-\xff]+")
_gap = re.compile(rb"[^0-9a-z\x80-\xff]")


def word_blocks(text: str | None) -> Iterator[list[bytes]]:
    """A text's words in order, about STEP bytes at a time; only A-Z are lowered."""
    data, at = (text or "").encode().lower(), 0
    while at < len(data):
        m = _gap.search(data, at + STEP)
        end = m.start() if m else len(data)
        yield _word.findall(data[at:end])
        at = end


def bucket_blocks(text: str | None, orders: int = ORDERS, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray]]:
    """(new words, buckets of the features that end in them) block by block."""
    tail: list[bytes] = []
    for fresh in word_blocks(text):
        words, found = tail + fresh, []
        for k in range(1, orders + 1):
            first = max(0, len(tail) - k + 1)  # features that end before the block were counted with the last one
            grams = words[first:] if k == 1 else map(b" ".join, zip(*(words[first + i :] for i in range(k)), strict=False))
            found.append(np.fromiter(map(crc32, grams), np.int64))
        yield len(fresh), np.concatenate(found) % buckets
        tail = words[len(words) - orders + 1 :] if len(words) >= orders else words


def bucket_counts(texts: DataFrame, text_col: str = "text", orders: int = ORDERS, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all ``texts`` fall in each bucket; a row a bucket at most leaves each task, and comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for piece in slices(batch):
                for text in piece.column(0).to_pylist():
                    for _, found in bucket_blocks(text, orders, buckets):
                        total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    rows = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains_of(raw: np.ndarray, target: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * ln of the ratio of smoothed shares) of every bucket, in doubles."""
    s, t, buckets = raw.astype(float), target.astype(float), len(raw)
    return np.floor(scale * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text", orders: int = ORDERS) -> DataFrame:
    """id, n_words, n_features, weight of every document: one narrow pass with the array of gains, whose size is fixed."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind, buckets = src.schema["id"].dataType.simpleString(), len(gains)
    sent = docs.sparkSession.sparkContext.broadcast(gains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = sent.value
        for batch in batches:
            for piece in slices(batch):
                rows = []
                for text in piece.column(1).to_pylist():
                    n_words = n_features = weight = 0
                    for fresh, found in bucket_blocks(text, orders, buckets):
                        n_words, n_features, weight = n_words + fresh, n_features + len(found), weight + int(of[found].sum())
                    rows.append((n_words, n_features, weight))
                cols = np.array(rows, np.int64).reshape(-1, 3).T
                yield pa.RecordBatch.from_arrays([piece.column(0), *map(pa.array, cols)], ["id", "n_words", "n_features", "weight"])

    return src.mapInArrow(run, f"id {kind}, n_words bigint, n_features bigint, weight bigint").withColumnRenamed("id", id_col)


def gumbel_score(id_col: str = "doc_id", seed: int = SEED, scale: int = SCALE):
    """weight plus floor(-scale * ln(-ln(u))), u made of the first 32 bits of sha256(seed:id)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.col("weight") + F.floor(F.lit(-float(scale)) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def rank_offsets(scores: DataFrame, draws: int) -> DataFrame:
    """score, before: how many of ``scores`` are higher, for each score at which the first ``draws`` ranks begin or go on."""
    histogram = scores.groupBy("score").agg(F.count("*").alias("n"))
    # the ranges are sampled: what is summed and what is numbered must be the same ones
    ranged = cut(histogram.repartitionByRange(F.desc("score")).withColumn("range", F.spark_partition_id()))
    sums = {r["range"]: r["n"] for r in ranged.groupBy("range").agg(F.sum("n").alias("n")).collect()}
    offsets, higher = [], 0
    for k in range(max(sums, default=-1) + 1):
        offsets.append(higher)
        higher += sums.get(k, 0)
    inside = Window.partitionBy("range").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    reached = [k for k, o in enumerate(offsets) if o < draws]
    before = F.coalesce(F.sum("n").over(inside), F.lit(0)) + F.get(F.lit(np.array(offsets or [0], np.int64)), F.col("range"))
    return ranged.where(F.col("range") <= max(reached, default=-1)).select("score", before.alias("before")).where(F.col("before") < draws)


def draw_highest(scored: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, id_col: str = "doc_id") -> DataFrame:
    """``scored`` (a written table) with ``rank``: 1, 2, 3 ... of the floor(share / 100) drawn, null for all others."""
    able = F.col("n_words") >= least_words
    draws = share * scored.where(able).count() // 100
    none = F.lit(None).cast("long")
    if not draws:
        return scored.withColumn("rank", none)
    offsets = cut(rank_offsets(scored.where(able).select("score"), draws))
    cutoff = offsets.agg(F.min("score")).first()[0]
    over = able & (F.col("score") >= cutoff)
    rank = F.col("before") + F.row_number().over(Window.partitionBy("score").orderBy(F.asc_nulls_first(id_col)))
    drawn = scored.where(over).join(offsets, "score").withColumn("rank", rank.cast("long"))
    drawn = drawn.withColumn("rank", F.when(F.col("rank") <= draws, F.col("rank"))).select(*scored.columns, "rank")
    return drawn.unionByName(scored.where(~over).withColumn("rank", none))


def importance_draw(docs: DataFrame, target: DataFrame, share: int = SHARE, seed: int = SEED, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, orders: int = ORDERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_features, weight, score, rank of every document, drawn towards the texts of ``target``."""
    gains = gains_of(bucket_counts(docs, text_col, orders, buckets), bucket_counts(target, "text", orders, buckets))
    scored = weigh(docs, gains, id_col, text_col, orders).withColumn("score", gumbel_score(id_col, seed).cast("long"))
    return draw_highest(shared_table(scored, "importance"), share, least_words, id_col)


def importance_report(docs: DataFrame, target: DataFrame) -> DataFrame:
    return importance_draw(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
