"""Byte-pair encoding and decoding by a contiguous rank array per short word.

A word's symbols are kept as an array of part boundaries beside an array of the
ranks of adjacent parts.  The least rank is looked for again and again, the
boundary between its two parts goes, and the ranks of the new part with its two
neighbours are looked up anew.  Of equal ranks the leftmost goes first.  Words of
more than ``SHORT`` symbols, for which such scans would take time in the square
of the length, go through a queue of the same pairs in the same order.

The vocabulary file's own normalizer and word splitter make the words.  Both work
inside runs without blanks, so ids are kept by run; the runs kept are bounded
in bytes.  A null or empty text has no ids, and no ids decode to the empty text.
Ids outside the vocabulary decode to nothing.  Every row is encoded by itself,
repeated ones too; columns other than the two named are not read.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import slices

#: Symbols of a word up to which ranks are scanned, a rank above all others, and bits of an id in a pair's key.
SHORT, NONE, WIDE = 128, 1 << 60, 24
#: Bytes of kept runs after which they are collected anew (each counts ENTRY bytes besides its own), and the longest run kept.
CACHE_BYTES, ENTRY, LONGEST = 96 << 20, 200, 64

#: Letters and then signs, which a splitter parts and a normalizer only lowers.
_plain = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:]*)")

#: What stands for each byte: printable Latin-1 characters for themselves, code points from 256 on for the others in order.
_printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
_stands_for = dict(zip([*_printable, *sorted({*range(256)} - {*_printable})], map(chr, [*_printable, *range(256, 512)]), strict=False))


def scan_merge(parts: list[int], ranks: dict[int, int], made: list[int]) -> list[int]:
    """The parts of a short word: the least adjacent rank is found by a scan and its boundary deleted, until none is left.

    ``parts`` holds the part between each boundary and the next, ``made`` the part that a rank's pair becomes.
    """
    rank = ranks.get
    adjacent = [rank(a << WIDE | b, NONE) for a, b in zip(parts, parts[1:], strict=False)]
    while adjacent:
        least = min(adjacent)
        if least == NONE:
            break
        i = adjacent.index(least)
        part = parts[i] = made[least]
        del parts[i + 1], adjacent[i]
        if i:
            adjacent[i - 1] = rank(parts[i - 1] << WIDE | part, NONE)
        if i < len(adjacent):
            adjacent[i] = rank(part << WIDE | parts[i + 1], NONE)
    return parts


def queue_merge(parts: list[int], ranks: dict[int, int], made: list[int]) -> list[int]:
    """The same parts for words of any length, in time n log n."""
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    queue = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if (r := ranks.get(a << WIDE | b, NONE)) < NONE]
    heapq.heapify(queue)
    while queue:
        r, i, a, b = heapq.heappop(queue)
        j = after[i]
        if parts[i] != a or j >= n or parts[j] != b:
            continue  # one of the two has become part of another
        parts[i], parts[j], after[i] = made[r], -1, after[j]
        if after[i] < n:
            before[after[i]] = i
        for left, right in ((before[i], i), (i, after[i])):
            if left >= 0 and right < n and (r := ranks.get(parts[left] << WIDE | parts[right], NONE)) < NONE:
                heapq.heappush(queue, (r, left, parts[left], parts[right]))
    return [p for p in parts if p >= 0]


class Vocabulary(dict):
    """Run of text without blanks -> its ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            described = json.load(f)
        model, tokenizer = described["model"], Tokenizer.from_file(path)
        self.normalizer, self.splitter = tokenizer.normalizer, tokenizer.pre_tokenizer
        self.ids: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.ranks = {self.ids[a] << WIDE | self.ids[b]: k for k, (a, b) in enumerate(pairs)}
        self.made = [self.ids[a + b] for a, b in pairs]
        self.special = {t["content"]: t["id"] for t in described["added_tokens"]}
        self.marks = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        # whether this file's normalizer and splitter do with plain words what is done here without them
        self.lowers = [w for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str("AbÀß.,"))] == [self.as_bytes("abàß"), ".,"]
        self.words: dict[str, bytes] = {}
        self.held = 0

    @staticmethod
    def as_bytes(word: str) -> str:
        """The characters that stand for a word's UTF-8 bytes in a byte-level vocabulary."""
        return word if word.isascii() else "".join([_stands_for[b] for b in word.encode()])

    def keep(self, where: dict[str, bytes], name: str, got: bytes) -> bytes:
        if len(name) <= LONGEST:
            self.held += ENTRY + 4 * len(name) + len(got)
            if self.held > CACHE_BYTES:
                self.clear()
                self.words.clear()
                self.held = 0
            where[name] = got
        return got

    def word(self, word: str) -> bytes:
        """Ids of one word of the splitter, whose characters stand for bytes."""
        got = self.words.get(word)
        return self.keep(self.words, word, self.merged(word)) if got is None else got

    def merged(self, word: str) -> bytes:
        symbols = [self.ids[s] for s in (*word[:-1], word[-1] + self.end) if s in self.ids]
        return array("I", (scan_merge if len(symbols) <= SHORT else queue_merge)(symbols, self.ranks, self.made)).tobytes()

    def plain(self, text: str) -> Iterator[bytes]:
        if text:
            for word, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text)):
                if word:
                    yield self.word(word)

    def __missing__(self, run: str) -> bytes:
        if self.lowers and (m := _plain.fullmatch(run)):
            low = m[1].lower()
            if m[2] or low != run:
                return self.keep(self, run, self[low] + (self[m[2]] if m[2] else b""))
            return self.keep(self, run, self.merged(self.as_bytes(run)))
        out, at = [], 0
        for m in self.marks.finditer(run) if self.marks else ():
            out += [*self.plain(run[at : m.start()]), array("I", [self.special[m[0]]]).tobytes()]
            at = m.end()
        return self.keep(self, run, b"".join([*out, *self.plain(run[at:])]))

    def encode(self, text: str | None) -> bytes:
        return b"".join(map(self.__getitem__, (text or "").replace("\n", " ").split(" ")))


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One a worker: read once, whatever number of tasks it runs."""
    return Vocabulary(path)


@lru_cache(maxsize=2)
def tokens_of(path: str) -> np.ndarray:
    """Every id's token as it stands in the vocabulary; the empty string where there is none, and behind the last."""
    with open(path, encoding="utf-8") as f:
        described = json.load(f)
    named = described["model"]["vocab"] | {t["content"]: t["id"] for t in described["added_tokens"]}
    out = np.full(2 + max(named.values()), "", object)
    for token, k in named.items():
        out[k] = token
    return out


def decode(ids: np.ndarray, tokens: np.ndarray) -> str:
    """The tokens joined by one space."""
    last = len(tokens) - 1
    if len(ids) and (ids.min() < 0 or ids.max() > last):
        ids = np.where((ids < 0) | (ids > last), last, ids)
    return " ".join(filter(None, tokens[ids].tolist()))


def encode_texts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """id, ids (array of int) of every whole text; one narrow pass, row by row.

    With ``decoded`` the same pass decodes the ids, as ``decode_ids`` does, so that a task has one Python worker and not two.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(tokenizer_path)
        tokens = tokens_of(tokenizer_path) if decoded else None
        for batch in batches:
            for piece in slices(batch):
                coded = [known.encode(t) for t in piece.column(1).to_pylist()]
                ends = np.cumsum([0] + [len(c) // 4 for c in coded])
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(coded), "<u4").astype(np.int32)))
                texts = [pa.array([decode(np.frombuffer(c, "<u4"), tokens) for c in coded], pa.string())] if decoded else []
                yield pa.RecordBatch.from_arrays([piece.column(0), ids, *texts], ["id", "ids", *["decoded"] * decoded])

    return src.mapInArrow(run, f"id {kind}, ids array<int>" + ", decoded string" * decoded).withColumnRenamed("id", id_col)


def decode_ids(encoded: DataFrame, tokenizer_path: str, ids_col: str = "ids", into: str = "decoded") -> DataFrame:
    """``encoded`` with its ids decoded, special tokens kept, as ``into`` in their place."""
    rest = [f for f in encoded.schema if f.name != ids_col]
    made = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), f"`{into}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(tokenizer_path)
        for batch in batches:
            for piece in slices(batch):
                lists = piece.column(0)
                ids = lists.flatten().fill_null(-1).to_numpy()
                ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])
                texts = pa.array([decode(ids[a:b], tokens) for a, b in zip(ends, ends[1:], strict=False)], pa.string())
                yield pa.RecordBatch.from_arrays([*piece.columns[1:], texts], [*piece.schema.names[1:], into])

    return encoded.select(ids_col, *(f.name for f in rest)).mapInArrow(run, made)


def bpe_report(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the text that they decode to."""
    return encode_texts(docs, tokenizer_path, decoded=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
