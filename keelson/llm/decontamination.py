"""Benchmark decontamination by a prefix-filtered containment join.

A benchmark item is cut into windows of ``WINDOW`` consecutive words (an item
of fewer words is one window).  Words are ordered by their frequency over all
documents.  For whole containment a window's necessary prefix is its rarest
word alone: a document that holds the window holds that word, at the window's
own offset.  So documents meet windows only through their rarest words; length
and position bounds drop places where the window can't lie, the next-rarest
word must stand at its offset, and what is left is compared word by word.

Items are cut into pieces of ``PIECE_BYTES``, each window in one of them, and
equal pieces of an item become one; pieces are dealt by hash to blocks of
``BLOCK_BYTES`` of text, whatever the rows and the length of one item.  A
block's windows travel to the tasks in a broadcast; larger benchmarks are
joined block by block, each a narrow pass over the documents.  Nothing is shuffled but the word counts,
which are summed per task first.  Null texts have no words.  Null item ids and
items without words are left out.  Repeated rows are judged alike.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import cut, slices

WINDOW, BLOCK_BYTES, PIECE_BYTES, CANDIDATES = 10, 8 << 20, 64 << 10, 1 << 18

#: A-Z to a-z; other ASCII that is no letter or digit to a blank; bytes of other characters stay.
_table = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_table).split()


def pieces_of(text: str | None, window: int = WINDOW, most: int = PIECE_BYTES) -> Iterator[str]:
    """Runs of an item's words that hold each of its windows once: of ``most`` bytes, or of one window where that is longer."""
    words = words_of(text)
    start = 0
    while start < len(words):
        stop = min(len(words), start + window)
        size = sum(map(len, words[start:stop])) + stop - start
        while stop < len(words) and size + len(words[stop]) < most:
            size += len(words[stop]) + 1
            stop += 1
        yield b" ".join(words[start:stop]).decode("utf-8", "surrogatepass")
        if stop == len(words):
            return
        start = stop - window + 1


class Windows:
    """The distinct windows of a block of items, as places in one array of word numbers, and who owns them.

    Some 40 bytes a window while it is built and 15 afterwards, besides the
    block's distinct words.  Items shorter than a window are filled up with -1.
    """

    def __init__(self, items: Iterable[tuple], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.names: list = []
        self.window = window
        flat, starts, owner = array("i"), [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for name, text in items:
            words = words_of(text)
            if not words:
                continue
            many = max(1, len(words) - window + 1)
            starts.append(np.arange(len(flat), len(flat) + many, dtype=np.int32))
            owner.append(np.full(many, len(self.names), np.int32))
            self.names.append(name)
            flat.extend(self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words)
            flat.extend([-1] * (window - len(words)))
        self.flat = np.frombuffer(flat, np.int32) if len(flat) else np.zeros(0, np.int32)
        starts, owner = np.concatenate(starts), np.concatenate(owner)
        first, same = self._distinct(starts)
        self.at = starts[first]
        pairs = np.unique(same.astype(np.int64) * max(1, len(self.names)) + owner)
        self.owner = (pairs % max(1, len(self.names))).astype(np.int32)
        self.owned = np.searchsorted(pairs, np.arange(len(first) + 1) * max(1, len(self.names))).astype(np.int32)
        self.sizes = np.zeros(len(first), np.int8)
        for j in range(window):
            self.sizes += self.word(slice(None), j) >= 0

    def _distinct(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First of equal windows, and each window's number: ranks of runs of words, doubled and then put together, all exact."""
        width, ranks, rest = 1, self.flat.astype(np.int64) + 1, None
        done = 0
        while done < self.window:
            if self.window & width:  # the next binary digit of the window's length
                part = ranks[np.minimum(starts + done, max(0, len(ranks) - 1))] if len(starts) else np.zeros(0, np.int64)
                rest = part if rest is None else np.unique(rest * (int(ranks.max(initial=0)) + 1) + part, return_inverse=True)[1]
                done += width
            if done < self.window:
                ranks = np.unique(ranks[:-width] * (int(ranks.max(initial=0)) + 1) + ranks[width:], return_inverse=True)[1]
                width *= 2
        _, first, same = np.unique(rest, return_index=True, return_inverse=True)
        return first, same

    def __len__(self) -> int:
        return len(self.at)

    def word(self, w, j) -> np.ndarray:
        """The word numbers at place ``j`` of windows ``w``."""
        return self.flat[self.at[w] + j]

    def owners(self, w: int) -> list:
        return [self.names[i] for i in self.owner[self.owned[w] : self.owned[w + 1]]]

    def order(self, counts: np.ndarray) -> None:
        """Index the windows by their rarest word; remember the place of the next-rarest for the positional filter."""
        far = np.iinfo(np.int64).max
        least, next_ = np.full(len(self), far), np.full(len(self), far)
        for j in range(self.window):
            x = self.word(slice(None), j)
            rank = np.where(x >= 0, np.append(counts, 0)[x] * self.window + j, far)
            next_ = np.minimum(next_, np.maximum(least, rank))
            least = np.minimum(least, rank)
        self.prefix = (least % self.window).astype(np.int8)
        self.second = np.where(self.sizes > 1, next_ % self.window, self.prefix).astype(np.int8)
        key = self.word(slice(None), self.prefix)
        self.of = np.argsort(key, kind="stable").astype(np.int32)
        self.first = np.searchsorted(key[self.of], np.arange(len(counts) + 1)).astype(np.int32)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and windows of all occurrences in a document given as word numbers."""
        n = len(x)
        places = np.flatnonzero(x >= 0) if len(self) else np.zeros(0, np.int64)
        many = self.first[x[places] + 1] - self.first[x[places]]
        places, many = places[many > 0], many[many > 0]
        starts, found = [], []
        ends = np.cumsum(many)
        at = 0
        while at < len(places):  # candidates in bounded blocks
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CANDIDATES, "right")))
            p, m = places[at:to], many[at:to]
            k = np.repeat(self.first[x[p]] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())
            w = self.of[k]
            s = np.repeat(p, m) - self.prefix[w]
            ok = (s >= 0) & (s + self.sizes[w] <= n)
            s, w = s[ok], w[ok]
            ok = x[s + self.second[w]] == self.word(w, self.second[w])
            s, w = s[ok], w[ok]
            for j in range(self.window):
                ok = (self.sizes[w] <= j) | (x[np.minimum(s + j, n - 1)] == self.word(w, j))
                s, w = s[ok], w[ok]
            starts.append(s)
            found.append(w)
            at = to
        return np.concatenate([*starts, np.zeros(0, np.int64)]), np.concatenate([*found, np.zeros(0, np.int64)])


def _word_counts(docs: DataFrame, windows) -> dict[int, int]:
    """How often each benchmark word occurs in all documents; one row a word comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = windows.value
        total = np.zeros(len(w.vocabulary), np.int64)
        for batch in batches:
            for piece in slices(batch):
                for text in piece.column(0).to_pylist():
                    x = w.numbers(words_of(text))
                    total += np.bincount(x[x >= 0], minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["word", "n"])

    rows = docs.select("text").mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"]: r["n"] for r in rows.collect()}


SPANS = "array<struct<start:bigint,end:bigint>>"


def _joined(docs: DataFrame, windows) -> DataFrame:
    """Add a block's hits to ``spans`` (maximal runs of hit words, sorted) and ``items``."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind, items_kind = (docs.schema[c].dataType for c in ("id", "items"))
    names = to_arrow_type(items_kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = windows.value
        types = [pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), names]
        for batch in batches:
            for piece in slices(batch):
                texts, before, owned = (piece.column(i).to_pylist() for i in (1, 3, 4))
                out = []
                for text, spans, items in zip(texts, before, owned, strict=True):
                    words = words_of(text)
                    s, k = w.find(w.numbers(words)) if words else (np.zeros(0, int),) * 2
                    if len(s):
                        edge = np.zeros(len(words) + 1, np.int64)
                        np.add.at(edge, s, 1)
                        np.add.at(edge, s + w.sizes[k], -1)
                        for x in spans:
                            edge[x["start"]] += 1
                            edge[x["end"]] -= 1
                        hit = np.diff(np.concatenate([[0], (np.cumsum(edge) > 0).astype(np.int8)]))
                        spans = [{"start": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(hit > 0), np.flatnonzero(hit < 0), strict=True)]
                        items = sorted({*items, *(i for j in np.unique(k) for i in w.owners(j))})
                    out.append((len(words), spans, items))
                cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), *cols], ["id", "text", "n_words", "spans", "items"])

    return docs.mapInArrow(run, f"id {kind.simpleString()}, text string, n_words bigint, spans {SPANS}, items {items_kind.simpleString()}")


def _pieces(items: DataFrame, window: int) -> DataFrame:
    """The distinct pieces of each of ``items(item, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                name = batch.column(0).slice(row, 1)
                for piece in pieces_of(batch.column(1)[row].as_py(), window, PIECE_BYTES):
                    yield pa.RecordBatch.from_arrays([name, pa.array([piece], pa.string())], ["item", "text"])

    return items.mapInArrow(run, f"item {items.schema['item'].dataType.simpleString()}, text string").distinct()


def _blocks(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, window: int) -> Iterator[Windows]:
    """Windows of each block of items, ordered by the word counts over ``docs(text)``."""
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    items = cut(_pieces(items, window))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES) or 1
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        windows = Windows(((r["item"], r["text"]) for r in block.toLocalIterator()), window)
        counts = np.zeros(len(windows.vocabulary), np.int64)
        if len(windows):
            for word, n in _word_counts(docs, docs.sparkSession.sparkContext.broadcast(windows)).items():
                counts[word] = n
        windows.order(counts)
        yield windows


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: id, text, n_words, spans of hit words, items with an occurring window."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = src.select("id", "text", F.lit(0).cast("bigint").alias("n_words"), F.array().cast(SPANS).alias("spans"), F.array().cast(f"array<{benchmark.schema[item_col].dataType.simpleString()}>").alias("items"))
    for k, windows in enumerate(_blocks(src, benchmark, item_col, item_text_col, window)):
        out = _joined(cut(out) if k else out, docs.sparkSession.sparkContext.broadcast(windows))
    return out.withColumnRenamed("id", id_col)


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, unchanged and with all their columns, in which no window of any item occurs."""
    src = docs.select(F.col(text_col).alias("text"))
    for windows in _blocks(src, benchmark, item_col, item_text_col, window):
        docs = docs.where(~_hit_by(docs.sparkSession.sparkContext.broadcast(windows))(text_col))
    return docs


def _hit_by(windows):
    @F.pandas_udf("boolean")
    def hit(texts):
        w = windows.value
        return texts.map(lambda t: bool(len(w.find(w.numbers(words_of(t)))[0])) if t else False)

    return hit


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns."""
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"])
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return find_contamination(docs, benchmark).select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(names.cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )



#: The same results as SQL.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)
), dw AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), h AS (
  SELECT DISTINCT r, i, n, item_id FROM dw JOIN bw USING (n, g)
), c AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM h)) GROUP BY r
), m AS (
  SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN m USING (r)
"""
