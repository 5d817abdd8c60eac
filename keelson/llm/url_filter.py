"""URL filter: a Bloom filter cascade with exact answers over the corpus's own keys.

A cascade alternates: level 1 encodes the listed keys, level 2 those unlisted
keys of the corpus that level 1 lets through by mistake, level 3 the listed
keys that level 2 hits by mistake, and so on until no mistake is left.  As the
universe is every key that occurs in the corpus, membership is exact there and
the test is a bit lookup in a small broadcast, not a join.

Keys of a url are its host and every parent domain, each bare and followed by
every path prefix whose length some rule has.  Null urls and urls without
``://`` have empty host and path and fit no rule.  Repeated rows are judged
alike.  The broadcast is checked against ``MAX_BYTES``; beyond it hosts meet
the listed ones in a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import cut

#: The contract's rules (host followed by path -> verdict).
RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
#: Host labels that put a host of the corpus on the block list where no rule fits.
MARKERS = ("spam", "pills", "casino", "viagra", "phish", "malware", "warez", "porn", "payday", "replica")

MAX_BYTES, LATER_RATE, MOST_LEVELS = 64 << 20, 1 / 64, 40

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.nullif(F.instr(url, "://"), F.lit(0)) + 3, F.length(url))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.nullif(F.instr(url, "://"), F.lit(0)) + 3, F.length(url))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def domains(host: Column) -> Column:
    """The host and all its parent domains, the longest first; none for an empty host."""
    parts = F.split(host, r"\.")
    every = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(every)


def rule_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Every ``domain + path prefix`` that could be a rule."""
    prefixes = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda p: p.isNotNull())
    return F.flatten(F.transform(domains(host), lambda d: F.transform(prefixes, lambda p: F.concat(d, p))))


@dataclass(frozen=True)
class Level:
    bits: np.ndarray  # uint64 words
    size: int
    hashes: int


def _positions(h1: np.ndarray, h2: np.ndarray, level: int, size: int, hashes: int) -> np.ndarray:
    """(hashes, n) bit positions; every level mixes anew, else its mistakes would repeat those of the last."""
    with np.errstate(over="ignore"):
        a = h1.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(level + 1)
        b = h2.astype(np.int64).view(np.uint64)
        x = (a ^ (a >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27)) ^ b) * np.uint64(0x94D049BB133111EB)
        y = ((b + a) ^ ((b + a) >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD) | np.uint64(1)
        x = x ^ (x >> np.uint64(31))
        return np.stack([(x + np.uint64(i) * y) % np.uint64(size) for i in range(hashes)])


def _hit(levels: list[Level], h1: np.ndarray, h2: np.ndarray, at: int) -> np.ndarray:
    f = levels[at]
    p = _positions(h1, h2, at, f.size, f.hashes)
    return ((f.bits[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1)).all(axis=0)


def member(levels: list[Level], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Exact membership for keys of the universe: the first level that misses decides."""
    out, open_ = np.zeros(len(h1), bool), np.arange(len(h1))
    for at in range(len(levels)):
        hit = _hit(levels, h1[open_], h2[open_], at)
        out[open_[~hit]] = at % 2 == 1
        open_ = open_[hit]
    out[open_] = len(levels) % 2 == 1
    return out


def _kept(df: DataFrame, levels: list[Level], at: int) -> DataFrame:
    """The keys that level ``at`` lets through."""
    shared = df.sparkSession.sparkContext.broadcast(levels[at])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = _hit([shared.value] * (at + 1), b.column(0).to_numpy(), b.column(1).to_numpy(), at) if b.num_rows else np.zeros(0, bool)
            yield b.filter(pa.array(hit))

    return df.mapInArrow(run, "h1 bigint, h2 bigint")


def _filled(df: DataFrame, at: int, n: int, rate: float) -> Level:
    """One level over ``n`` keys: tasks set bits, an aggregate ors their words, the words come to the driver."""
    size = max(64, math.ceil(n * math.log(1 / rate) / math.log(2) ** 2))
    size, hashes = -(-size // 64) * 64, max(1, round(math.log2(1 / rate)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.unique(_positions(b.column(0).to_numpy(), b.column(1).to_numpy(), at, size, hashes)) if b.num_rows else np.zeros(0, np.uint64)
            word, first = np.unique(p >> np.uint64(6), return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (p & np.uint64(63)), first) if len(p) else p
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(bits.view(np.int64))], ["word", "bits"])

    words = df.mapInArrow(run, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    bits = np.zeros(size // 64, np.uint64)
    bits[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).view(np.uint64)
    return Level(bits, size, hashes)


def build_cascade(universe: DataFrame) -> list[Level] | None:
    """Levels for ``universe(h1, h2, listed)``, distinct keys.  None if they would pass ``MAX_BYTES``."""
    n = {r["listed"]: r["count"] for r in universe.groupBy("listed").count().collect()}
    inside, outside = (universe.where(F.col("listed") == v).select("h1", "h2") for v in (True, False))
    count, against, levels = n.get(True, 0), n.get(False, 0), []
    while count:
        rate = min(0.5, max(2.0**-20, 0.7 * count / max(against, 1))) if not levels else LATER_RATE
        if sum(f.bits.nbytes for f in levels) + count * math.log(1 / rate) / math.log(2) ** 2 / 8 > MAX_BYTES:
            return None
        if len(levels) == MOST_LEVELS:
            raise RuntimeError("two keys of the corpus share 128 hash bits")
        at = len(levels)
        levels.append(_filled(inside, at, count, rate))
        inside, outside, against = _kept(outside, levels, at), inside, count
        count = inside.count()
    return levels


def _tagged(keys: Column, tag: str) -> Column:
    return F.transform(keys, lambda k: F.concat(F.lit(tag), k))


def judge_urls(pages: DataFrame, rules: dict[str, str] = RULES, markers: tuple[str, ...] = MARKERS, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """id, host, path, the longest fitting rule (null if none) and the verdict.

    Listed keys: the rules, by verdict, and the hosts of the corpus one of
    whose labels holds a marker.  Two passes over the urls; the only shuffle is
    the distinct of keys, which combines before it shuffles.
    """
    lengths = sorted({len(r) - r.index("/") for r in rules})
    base = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    own = rule_keys(F.col("host"), F.col("path"), lengths)
    tags = sorted(set(rules.values()))
    base = base.withColumn("keys", F.array_sort(own, lambda a, b: F.length(b) - F.length(a)))
    every = F.concat(*[_tagged(F.col("keys"), f"{t}:") for t in tags], F.array(F.concat(F.lit("host:"), F.col("host"))))
    listed = F.col("key").isin(*[f"{v}:{k}" for k, v in rules.items()])
    if markers:
        listed = listed | (F.col("key").startswith("host:") & F.col("key").rlike(rf"(^host:|[.-])({'|'.join(markers)})"))
    keys = base.select(F.explode(every).alias("key")).distinct()
    universe = cut(keys.select("key", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("second"), "key").alias("h2"), listed.alias("listed")))
    levels = build_cascade(universe)
    if levels is None:
        return _by_join(base, universe, rules, tags, default, id_col)
    shared = pages.sparkSession.sparkContext.broadcast(levels)

    @F.pandas_udf("array<boolean>")
    def known(h1, h2):
        import pandas as pd

        n = [len(x) for x in h1]
        flat = member(shared.value, np.concatenate([*h1, np.zeros(0, np.int64)]).astype(np.int64), np.concatenate([*h2, np.zeros(0, np.int64)]).astype(np.int64))
        ends = np.cumsum([0, *n])
        return pd.Series([flat[a:b] for a, b in zip(ends, ends[1:], strict=False)])

    hashed = base.withColumn("every", every).withColumn("found", known(F.transform("every", lambda k: F.xxhash64(k)), F.transform("every", lambda k: F.xxhash64(F.lit("second"), k))))
    hits = F.filter(F.arrays_zip("every", "found"), lambda x: x["found"])
    return _verdicts(hashed.withColumn("hits", F.transform(hits, lambda x: x["every"])), tags, default, id_col)


def _verdicts(df: DataFrame, tags: list[str], default: str, id_col: str) -> DataFrame:
    """From ``hits``, the tagged listed keys of a url: the longest rule, else the host list, else the default."""
    rules = F.filter("hits", lambda h: ~h.startswith("host:"))
    best = F.element_at(F.array_sort(rules, lambda a, b: F.length(F.substring_index(b, ":", -1)) - F.length(F.substring_index(a, ":", -1))), 1)
    rule = F.col("best").substr(F.instr("best", ":") + 1, F.length("best"))
    verdict = F.when(F.col("best").isNotNull(), F.substring_index("best", ":", 1)).when(F.exists("hits", lambda h: h.startswith("host:")), "block").otherwise(default)
    return df.withColumn("best", F.when(F.size(rules) > 0, best)).select(F.col("id").alias(id_col), "host", "path", rule.alias("rule"), verdict.alias("verdict"))


def _by_join(base: DataFrame, universe: DataFrame, rules: dict[str, str], tags: list[str], default: str, id_col: str) -> DataFrame:
    """The way for lists whose cascade is too large to broadcast: hosts meet the listed hosts in a join; the rules are few and need none.

    Both sides of the join are plain shuffles, the right one with one row a
    host, so adaptive execution splits the rows of a hot host.
    """
    listed = universe.where("listed").where(F.col("key").startswith("host:")).select(F.substring("key", len("host:") + 1, 1 << 30).alias("host"), F.lit(True).alias("bad"))
    own = F.filter(F.concat(*[_tagged(F.col("keys"), f"{t}:") for t in tags]), lambda k: k.isin(*[f"{v}:{k}" for k, v in rules.items()]))
    hosts = F.when(F.col("bad"), F.array(F.concat(F.lit("host:"), F.col("host")))).otherwise(F.array().cast("array<string>"))
    return _verdicts(base.join(listed, "host", "left").withColumn("hits", F.concat(own, hosts)), tags, default, id_col)


#: The same verdicts as SQL.
SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), p AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM u
), r(rule_host, rule_path, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), b AS (
  SELECT *, (SELECT max_by(rule_host || rule_path || ' ' || r.verdict, length(rule_host || rule_path)) FROM r
    WHERE (p.host = rule_host OR ends_with(p.host, '.' || rule_host)) AND starts_with(p.path, rule_path)) AS best FROM p
)
SELECT page_id, host, path, split_part(best, ' ', 1) AS rule,
  CASE WHEN best IS NOT NULL THEN split_part(best, ' ', 2)
    WHEN regexp_matches(host, '(^|[.-])(MARKERS)') THEN 'block' ELSE 'allow' END AS verdict
FROM b
""".replace("MARKERS", "|".join(MARKERS))
