"""Cost-balanced packing of tokenized documents into fixed-length sequences.

A document costs ``linear * n + quadratic * n**2`` (projection and attention).
A group's tokens fill sequences of the full length and a few of the powers of
two that make up the rest, so that no sequence needs padding.  Documents are
taken in descending cost; each goes to the cheapest sequence that still has room
for it.  Where none has room for the whole, the cheapest one with any room takes
a piece, and the rest is placed by the same rule.  Of equal documents the earlier
row goes first, of equally cheap sequences the one with the least number.

Packing runs task by task over groups of about ``GROUP`` tokens: memory is
bounded by the group, nothing is shuffled, and no source or length can be a
hot spot.  A retried task makes the same sequences, since it reads the same
rows of the same files (cut the lineage first where docs come out of a
shuffle).  Null texts are empty: such a document is its end token.  Repeated
rows are packed once per row.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import slices

#: Tokens of a sequence, the id that ends a document, tokens packed together, costs of a token and of a pair.
LENGTH, END_ID, GROUP = 4096, 2, 1 << 20
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
#: Bytes after which a word cache starts anew (an entry counts ENTRY bytes besides its own), and the longest chunk that it keeps.
CACHE_BYTES, ENTRY, LONGEST = 160 << 20, 200, 64

#: Words whose normal form is their lower case: no composition, no special lowering.
_plain = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:]*)")


class WordCache(dict):
    """Chunk between blanks -> its ids as little-endian uint16.

    The tokenizer drops white space and no piece spans it, so a text's ids are
    its chunks' ids in order.  Plain words go to the model directly, everything
    else through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids need more than 16 bits")
        self.model = self.tokenizer.model
        byte_chars = [chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174 else None for b in range(256)]
        rest = iter(range(256, 512))
        self.table = {b: c or chr(next(rest)) for b, c in enumerate(byte_chars)}
        self.held = 0

    def keep(self, chunk: str, got: bytes) -> None:
        if len(chunk) > LONGEST:
            return
        self.held += ENTRY + 4 * len(chunk) + len(got)
        if self.held > CACHE_BYTES:
            self.clear()
            self.held = 0
        self[chunk] = got

    def __missing__(self, chunk: str) -> bytes:
        if not chunk:
            got = b""
        elif (m := _plain.fullmatch(chunk)) and (m[2] or m[1] != m[1].lower()):
            got = self[m[1].lower()] + (self[m[2]] if m[2] else b"")
        elif m:
            mapped = chunk if chunk.isascii() else chunk.encode().decode("latin-1").translate(self.table)
            got = array("H", [t.id for t in self.model.tokenize(mapped)]).tobytes()
        else:
            got = array("H", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        self.keep(chunk, got)
        return got

    def ids(self, text: str | None) -> np.ndarray:
        text = (text or "").replace("\n", " ")
        return np.frombuffer(b"".join(map(self.__getitem__, text.split(" "))), "<u2")


def layout(lengths: list[int], length: int = LENGTH, linear: float = LINEAR, quadratic: float = QUADRATIC) -> Iterator[tuple[int, int, int, int]]:
    """(document, start, size, sequence) of every piece; sequences are numbered from 0, a sequence's pieces follow in order."""
    whole, rest = divmod(sum(lengths), length)
    room = np.array([length] * whole + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1], np.int64)
    cost = np.zeros(len(room))
    for k in np.argsort(-np.array(lengths, np.int64), kind="stable").tolist():
        n, start = lengths[k], 0
        while n:
            fits = np.flatnonzero(room >= n)
            if not len(fits):
                fits = np.flatnonzero(room)
            s = int(fits[cost[fits].argmin()])
            take = min(n, int(room[s]))
            cost[s] += linear * take + quadratic * take * take
            room[s] -= take
            yield k, start, take, s
            n, start = n - take, start + take


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID, group: int = GROUP) -> DataFrame:
    """One row per piece: id, start, length, ``ids`` (little-endian uint32), doc_tokens, sequence_id, offset.

    ``tokenizer_path`` must be readable on every executor.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordCache(tokenizer_path)
        end = np.array([end_id], "<u2")
        base, made = TaskContext.get().partitionId() << 40, 0
        names, held, total = [], [], 0

        def packed(kind_of_id: pa.DataType) -> Iterator[pa.RecordBatch]:
            nonlocal made
            rows, offsets, most = [], {}, -1
            for k, start, size, s in layout([len(x) for x in held], length):
                at = offsets.get(s, 0)
                offsets[s] = at + size
                most = max(most, s)
                rows.append((names[k], start, size, held[k][start : start + size].astype("<u4").tobytes(), len(held[k]), base + made + s, at))
            made += most + 1
            for i in range(0, len(rows), 1000):
                cols = list(zip(*rows[i : i + 1000], strict=True))
                kinds = [kind_of_id, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            for piece in slices(batch):
                for name, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    names.append(name)
                    held.append(np.concatenate([cache.ids(text), end]))
                    total += len(held[-1])
                    if total >= group:
                        yield from packed(batch.column(0).type)
                        names, held, total = [], [], 0
            last = batch.column(0).type
        if held:
            yield from packed(last)

    schema = f"id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    return src.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def packing_report(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """The contract's columns: every piece with the checksum of its ids."""
    return pack_documents(docs, tokenizer_path).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
