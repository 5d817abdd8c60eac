"""Removal of repeated byte strings through merged Burrows-Wheeler transforms.

A byte goes if a ``LENGTH``-byte string over it also starts earlier: in a
document with a smaller id, or earlier in the same one.

Equal strings must meet without every suffix of the corpus being sorted in one
place.  Each window of LENGTH bytes names one anchor, the leftmost least hash
of the GRAM-byte strings in it, which depends on the window alone.  So equal
windows have equal anchors, and only anchors that occur twice can carry a
repeat.  Around those, the bytes of the anchor's windows travel to a bucket
chosen by the anchor's hash.  Equal contexts of a bucket are merged as one, and
one that is alone with its anchor is not.  The others are cut into shards; each
shard's Burrows-Wheeler transform is built column by column, and the shards
are merged by refining their interleave: from the interleave of suffixes that
begin one column further right, the preceding characters give the next one by
a stable partition.  Common prefixes follow by range minima in the same step,
and intervals of at least LENGTH common bytes are the repeats.  No suffix is
compared twice and none is sorted again.

Skew: copies of a whole text are settled by their hash and never become
candidates.  Anchors that occur more than ``HOT`` times don't go to one bucket;
their windows are aggregated one by one by a 128-bit hash, with minima that
combine before they shuffle, and come back as runs.  Ids must be whole numbers.
Null text is empty; null ids come before all
others.  Rows that share an id are one document with several texts: only an
earlier start counts as earlier, so repeated rows keep the same bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import cut, map_columns, slices

LENGTH, GRAM = 100, 32
#: Buckets of a task; starts of hot windows gathered at once.
BUCKETS, STRETCH = 16, 4096
#: Bytes hashed at once (places take 15 bits), contexts of a bucket and of a shard, occurrences of a hot anchor, hot anchors, bytes of the filter, rows of the broadcast copies and hot windows.
BLOCK, BUCKET, SHARD, HOT, MOST_HOT, FILTER_BYTES, MOST_COPIES, MOST_WINDOWS = (1 << 15) - LENGTH, 16_384, 4_096, 20_000, 1_000_000, 32 << 20, 500_000, 200_000
LEFT = LENGTH - GRAM  # bytes of a window before and after its anchor, at most
WIDTH = LEFT + LENGTH
FIRST_ID = -(1 << 63)


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def gram_hashes(x: np.ndarray, places: np.ndarray) -> np.ndarray:
    """64-bit hashes of the GRAM-byte strings at these places."""
    words = np.lib.stride_tricks.sliding_window_view(x, GRAM)[places].view(np.uint64)
    h = np.full(len(places), 0x9E3779B97F4A7C15, np.uint64)
    for j in range(GRAM // 8):
        h = _mixed((h ^ words[:, j]) * np.uint64(0xD6E8FEB86659FD93))
    return h


#: Numbers of the bytes, and the factors by which halves of a string are told apart.
BYTE_NUMBERS = np.random.default_rng(42).integers(0, 1 << 32, 256, np.uint32)
FACTORS = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)]


def _least_grams(x: np.ndarray) -> np.ndarray:
    """The place of the leftmost least hash of the GRAM-byte strings in each window of LENGTH bytes; 32,768 bytes at most.

    Hashes of 17 bits and places of 15 share a number; arrays of this size stay in the processor's cache.
    """
    h, size = BYTE_NUMBERS.take(x), 1
    for factor in FACTORS:
        h, size = h[:-size] * factor + h[size:], size * 2
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h &= np.uint32(0xFFFF8000)
    h |= np.arange(len(h), dtype=np.uint32)
    span, size, m = LENGTH - GRAM + 1, 1, h
    while size * 2 <= span:
        m, size = np.minimum(m[:-size], m[size:]), size * 2
    return np.minimum(m[: len(h) - span + 1], m[span - size :]) & np.uint32(0x7FFF)


def anchors(x: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of documents laid end to end: hash, place, first and last window start of every anchor, and its document.

    ``ends`` are the documents' ends.  An anchor's windows come in one run, or in two where a block ends.
    """
    out = []
    begins = np.concatenate([[0], ends[:-1]])
    edges = np.unique(np.concatenate([begins, ends - LENGTH + 1]))  # where a document begins, and its first start without a window
    for at in range(0, max(0, len(x) - LENGTH + 1), BLOCK):
        part = x[at : at + BLOCK + LENGTH - 1]
        place = _least_grams(part)
        own = edges[np.searchsorted(edges, at, "right") : np.searchsorted(edges, at + len(place))] - at
        new = np.ones(len(place), bool)
        np.not_equal(place[1:], place[:-1], out=new[1:])
        new[own] = True
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(place)) - 1
        doc = np.searchsorted(ends, first + at, "right")
        some = np.flatnonzero(first + (at + LENGTH) <= ends[doc])
        first, last, doc = first[some], last[some], doc[some]
        if len(first):
            d, found = begins[doc] - at, place[first].astype(np.int64)
            out.append((gram_hashes(part, found), found - d, first - d, last - d, doc))
    if not out:
        return (np.zeros(0, np.uint64),) + (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


class ShardBWT:
    """Per column of aligned contexts: the characters before the suffixes of the next column, and this column's order."""

    def __init__(self, rows: np.ndarray):
        n, width = rows.shape
        order, columns = np.arange(n), np.ascontiguousarray(rows.T)
        self.chars = np.empty((width, n), np.uint8)
        self.order = np.empty((width, n), np.int32)
        for j in range(width - 1, -1, -1):
            self.chars[j] = columns[j][order]
            order = order[np.argsort(self.chars[j], kind="stable")]
            self.order[j] = order


def _range_minima(values: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least of ``values[left:right + 1]`` for each pair, by a sparse table."""
    table = [values]
    size = 1
    while 2 * size <= len(values):
        t = table[-1]
        table.append(np.minimum(t[:-size], t[size:]))
        size *= 2
    # of equal lengths, so that one flat index finds level and place
    flat = np.concatenate([np.pad(t, (0, len(values) - len(t))) for t in table])
    level = np.frexp((right - left + 1).astype(np.float32))[1].astype(np.int64) - 1
    at = level * len(values)
    return np.minimum(flat[at + left], flat[at + right + 1 - (1 << level)])


def merge(shards: list[ShardBWT], upto: int = WIDTH) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Column by column from the right, of those up to ``upto``: (column, rows in suffix order, common prefix with the row before).

    Rows are numbered through the shards.  ``source`` is the interleave: whose suffix stands at each place.
    """
    sizes = [s.order.shape[1] for s in shards]
    base = np.cumsum([0, *sizes[:-1]])
    source = np.repeat(np.arange(len(shards), dtype=np.uint8 if len(shards) < 256 else np.uint16), sizes)
    places = np.arange(len(source))
    prefix = np.full(len(source), 255, np.uint8)  # nothing is known to differ yet: beyond the last column all are equal
    prefix[:1] = 0
    for j in range(shards[0].order.shape[0] - 1, -1, -1):
        chars = np.empty(len(source), np.uint8)
        chars[places] = np.concatenate([s.chars[j] for s in shards])
        moved = np.argsort(chars, kind="stable")
        source, ordered = source[moved], chars[moved]
        common = np.zeros(len(source), np.uint8)
        same = np.flatnonzero(ordered[1:] == ordered[:-1]) + 1
        if len(same):
            least = _range_minima(prefix, moved[same - 1] + 1, moved[same])
            common[same] = np.minimum(least, 254) + 1
        prefix = common
        places = np.argsort(source, kind="stable")
        if j > upto:
            continue
        rows = np.empty(len(source), np.int64)
        rows[places] = np.concatenate([s.order[j] + b for s, b in zip(shards, base, strict=True)])
        yield j, rows, prefix


def repeated_windows(contexts: list[bytes], before: np.ndarray, windows: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """(contexts, LEFT + 1) booleans: whether the window that starts in this column also starts earlier.

    ``before``: bytes of a context before its anchor; ``windows``: how many windows start in it; ``rank``: its place in
    the corpus, equal for equal places.  Columns are aligned at the anchor, which is at LEFT.
    """
    n = len(contexts)
    sizes = np.fromiter(map(len, contexts), np.int64, n)
    rows = np.zeros((n, WIDTH), np.uint8)
    at = np.repeat(np.arange(n) * WIDTH + LEFT - before, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    rows.reshape(-1)[at] = np.frombuffer(b"".join(contexts), np.uint8)
    shards = [ShardBWT(rows[i : i + SHARD]) for i in range(0, n, SHARD)]
    out = np.zeros((n, LEFT + 1), bool)
    low, high = LEFT - before, LEFT - before + windows
    far = np.iinfo(np.int64).max
    for j, order, prefix in merge(shards, LEFT):
        first = np.flatnonzero(prefix < LENGTH)
        inside = (low[order] <= j) & (j < high[order])
        own = np.where(inside, rank[order], far)
        least = np.repeat(np.minimum.reduceat(own, first), np.diff(np.append(first, n)))
        out[order, j] = inside & (own > least)
    return out


def resolved(keys: np.ndarray, contexts: list[bytes], before: np.ndarray, windows: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The same, with as many contexts merged as it takes.

    Of equal contexts those of the least rank are merged, as one; all windows of the others start earlier there.  A context
    alone with its anchor (``keys``: the anchors' hashes) has no window that another one has: equal windows have equal anchors.
    Within it a window is at one column only.
    """
    n = len(contexts)
    codes, _ = pd.factorize(np.fromiter(contexts, object, n))
    same = pd.DataFrame({"code": codes, "before": before, "windows": windows, "rank": rank, "key": keys.view(np.int64)})
    group = same.groupby(["key", "code", "before", "windows"], sort=False)
    number, least = group.ngroup().to_numpy(), group["rank"].transform("min").to_numpy()
    head = np.unique(number, return_index=True)[1]  # of each group of equal contexts
    several = head[same["key"].iloc[head].duplicated(keep=False).to_numpy()]
    out, column = np.zeros((n, LEFT + 1), bool), np.arange(LEFT + 1)
    if len(several):
        made = repeated_windows([contexts[i] for i in several], before[several], windows[several], least[several])
        where = np.full(len(head), -1)
        where[number[several]] = np.arange(len(several))
        some = np.flatnonzero(where[number] >= 0)
        out[some] = made[where[number[some]]]
    later = np.flatnonzero(rank > least)
    low = LEFT - before[later, None]
    out[later] = (low <= column) & (column < low + windows[later, None])
    return out


def _text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of strings without nulls, laid end to end, and where each ends."""
    flat = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    _, offsets, data = flat.buffers()
    at = np.frombuffer(offsets, np.int64)[flat.offset : flat.offset + len(flat) + 1]
    return np.frombuffer(data or b"", np.uint8)[at[0] : at[-1]], at[1:] - at[0]


def _candidates(docs: DataFrame, schema: str, make) -> DataFrame:
    """Run ``make(buffer, ids, keys, *anchors)`` over the texts that aren't copies; it returns columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 4 << 20):
                x, ends = _text_bytes(piece.column(2))
                if len(x) < LENGTH:
                    continue
                begins = np.append(0, ends[:-1])
                found = anchors(x, ends)
                cols = make(x, begins, piece.column(0).to_numpy(), piece.column(1).to_numpy(), *found)
                n = len(cols[0])
                for at in range(0, n, 20_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 20_000], f.type) for c, f in zip(cols, out, strict=True)], schema=out)

    return docs.where("first IS NULL").select("id", "h", "text").mapInArrow(run, schema)


def _with_first(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, h (text hash), text, and ``first``: the least id of an equal text, where that is smaller."""
    if docs.schema[id_col].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError("ids say which text comes first: they must be whole numbers")
    src = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(FIRST_ID)).alias("id"), F.col(id_col).alias("name"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    src = src.withColumn("h", F.xxhash64("text")).withColumn("h2", F.xxhash64(F.lit("second"), "text"))
    copies = src.select("h", "h2", "id").groupBy("h", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").drop("last")
    copies = cut(copies)
    if copies.count() <= MOST_COPIES:
        copies = F.broadcast(copies)
    return src.join(copies, ["h", "h2"], "left").withColumn("first", F.when(F.col("first") < F.col("id"), F.col("first"))).drop("h2")


def _filter_of(keys: DataFrame, count: int) -> tuple[np.ndarray, int]:
    """A Bloom filter of 64-bit hashes with three probes, ored together from the tasks' words."""
    words = max(1, 1 << (count * 12 // 64).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.unique(_probes(b.column(0).to_numpy().view(np.uint64), words))
            word, first = np.unique(p >> np.uint64(6), return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (p & np.uint64(63)), first) if len(p) else p
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(bits.view(np.int64))], ["word", "bits"])

    rows = keys.select("h").mapInArrow(run, "word bigint, bits bigint").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(words, np.uint64)
    out[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
    return out, words


def _probes(h: np.ndarray, words: int) -> np.ndarray:
    bits = np.uint64(words * 64 - 1)
    return np.concatenate([(h >> np.uint64(s)) * np.uint64(0x9E3779B97F4A7C15 + 2 * s) >> np.uint64(20) & bits for s in (0, 9, 17)])


def _maybe(filter_: np.ndarray, h: np.ndarray) -> np.ndarray:
    p = _probes(h, len(filter_))
    return (filter_[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)).reshape(3, -1).all(axis=0)


CONTEXT = "bucket bigint, id bigint, h bigint, place bigint, before int, windows int, context binary"
WINDOWS = "w1 bigint, w2 bigint, id bigint, h bigint, start bigint"


def _spans(docs: DataFrame) -> DataFrame:
    """id, h, start, end of byte runs that are to go, by document; runs may overlap."""
    counted = _candidates(docs, "a bigint", lambda x, begins, ids, keys, h, *rest: (h.view(np.int64),)).groupBy("a").count().where("count > 1").select(F.col("a").alias("h"), "count")
    counted = cut(counted)
    kinds, total = counted.agg(F.count("*"), F.coalesce(F.sum("count"), F.lit(0))).first()
    least_hot = max(HOT, total // MOST_HOT)
    hot = np.sort(np.array([r["h"] for r in counted.where(F.col("count") > least_hot).select("h").toLocalIterator()], np.int64))
    buckets = max(1, total // BUCKET)
    sc = docs.sparkSession.sparkContext
    small = kinds * 12 // 8 <= FILTER_BYTES
    shared = sc.broadcast((_filter_of(counted, kinds)[0] if small else None, hot))

    def contexts(x, begins, ids, keys, h, place, first, last, doc):
        known, hot = shared.value
        keep = np.flatnonzero(~np.isin(h.view(np.int64), hot) & (_maybe(known, h) if known is not None else True))
        h, place, first, last, doc = (c[keep] for c in (h, place, first, last, doc))
        data = x.tobytes()
        cuts = map(slice, (begins[doc] + first).tolist(), (begins[doc] + last + LENGTH).tolist())
        return (h % np.uint64(buckets)).astype(np.int64), ids[doc], keys[doc], place, (place - first).astype(np.int32), (last - first + 1).astype(np.int32), list(map(data.__getitem__, cuts)), h.view(np.int64)

    with_key = CONTEXT + ", a bigint"
    near = _candidates(docs, with_key, contexts)
    if not small:  # the filter would be too large to broadcast: candidates meet the repeated anchors in a join
        near = near.join(counted.select(F.col("h").alias("a")), "a", "left_semi")

    def resolve(group: pd.DataFrame) -> pd.DataFrame:
        ids, place = group["id"].to_numpy(np.int64), group["place"].to_numpy(np.int64)
        by = np.lexsort((place, ids))
        step = np.append(0, (np.diff(ids[by]) != 0) | (np.diff(place[by]) != 0))
        rank = np.empty(len(by), np.int64)
        rank[by] = np.cumsum(step)
        before = group["before"].to_numpy(np.int64)
        again = resolved(group["a"].to_numpy(np.int64), list(group["context"]), before, group["windows"].to_numpy(np.int64), rank)
        edge = np.diff(np.pad(again.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        row, start = np.nonzero(edge > 0)
        _, stop = np.nonzero(edge < 0)
        at = place[row] - LEFT
        return pd.DataFrame({"id": ids[row], "h": group["h"].to_numpy(np.int64)[row], "start": at + start, "end": at + stop - 1 + LENGTH})

    # as many tasks as the contexts need, whatever the session's number of shuffle partitions
    tasks = min(buckets, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), buckets // BUCKETS))
    spans = near.repartition(tasks, "bucket").groupBy("bucket").applyInPandas(resolve, "id bigint, h bigint, start bigint, end bigint")
    if not len(hot):
        return spans

    def windows(x, begins, ids, keys, h, place, first, last, doc):
        import xxhash

        keep = np.flatnonzero(np.isin(h.view(np.int64), shared.value[1]))
        many = (last - first + 1)[keep]
        start = np.repeat(first[keep], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        d = np.repeat(doc[keep], many)
        data, at = x.tobytes(), begins[d] + start
        found = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, map(data.__getitem__, map(slice, at.tolist(), (at + LENGTH).tolist())))), np.int64).reshape(-1, 2)
        return found[:, 0], found[:, 1], ids[d], keys[d], start

    every = _candidates(docs, WINDOWS, windows)
    least = cut(every.groupBy("w1", "w2").agg(F.min(F.struct("id", "start")).alias("least"), F.max(F.struct("id", "start")).alias("most")).where("least < most").select("w1", "w2", "least"))
    few = least.count() <= MOST_WINDOWS
    again = every.join(F.broadcast(least) if few else least, ["w1", "w2"]).where(F.struct("id", "start") > F.col("least")).select("id", "h", "start")
    again = again if few else cut(again)  # by itself, so that skewed windows are split
    # stretches of STRETCH starts are gathered, and leave as runs
    starts = again.groupBy("id", "h", F.floor(F.col("start") / STRETCH).alias("part")).agg(F.collect_set("start").alias("starts"))
    return spans.union(map_columns(starts.select("id", "h", "starts"), "id bigint, h bigint, start bigint, end bigint", _runs))


def _runs(cols: dict) -> dict:
    """Runs of bytes that windows with these starts cover, by document and stretch."""
    out: dict[str, list] = {"id": [], "h": [], "start": [], "end": []}
    for name, h, starts in zip(cols["id"], cols["h"], cols["starts"], strict=True):
        x = np.sort(np.array(starts, np.int64))
        breaks = np.flatnonzero(np.diff(x) > LENGTH)
        begin, end = x[np.append(0, breaks + 1)], x[np.append(breaks, len(x) - 1)] + LENGTH
        out["id"] += [name] * len(begin)
        out["h"] += [h] * len(begin)
        out["start"] += begin.tolist()
        out["end"] += end.tolist()
    return out


KEPT = "n_bytes bigint, n_removed bigint, n_spans bigint, kept binary"


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans (maximal removed runs) and ``kept``, the bytes that stay."""
    src = _with_first(docs, id_col, text_col)
    gone = _spans(src).groupBy("id", "h").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    both = src.join(gone, ["id", "h"], "left").select("name", "text", "first", "spans")
    kind = src.schema["name"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                rows = []
                x, ends = _text_bytes(piece.column(1))
                data, copies, spans = x.tobytes(), piece.column(2).is_valid().to_pylist(), piece.column(3)
                flat = spans.flatten()
                starts, stops = (flat.field(i).to_pylist() for i in (0, 1))
                counts = np.cumsum(np.append(0, pa.compute.fill_null(pa.compute.list_value_length(spans), 0).to_numpy()))
                for begin, end, copy, a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist(), copies, counts[:-1].tolist(), counts[1:].tolist(), strict=True):
                    raw = data[begin:end]
                    own = [(0, len(raw))] if copy and len(raw) >= LENGTH else sorted(zip(starts[a:b], stops[a:b], strict=True))
                    kept, at, n_spans, removed = [], 0, 0, 0
                    for start, stop in own:
                        if start > at or not n_spans:
                            kept.append(raw[at:start])
                            n_spans += 1
                            at = start
                        removed += max(0, stop - at)
                        at = max(at, stop)
                    kept.append(raw[at:])
                    rows.append((len(raw), removed, n_spans, b"".join(kept)))
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column(0), *cols], ["name", "n_bytes", "n_removed", "n_spans", "kept"])

    return both.mapInArrow(run, f"name {kind}, {KEPT}").withColumnRenamed("name", id_col)


def repeats_report(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, int, str]]:
    """The same by a dictionary of all windows; for distinct ids of small corpora."""
    seen: dict[bytes, tuple[int, int]] = {}
    out = {}
    for name, text in sorted(docs):
        raw = (text or "").encode("utf-8", "surrogatepass")
        gone = bytearray(len(raw))
        for i in range(len(raw) - LENGTH + 1):
            w = raw[i : i + LENGTH]
            if w in seen:
                gone[i : i + LENGTH] = b"\1" * LENGTH
            else:
                seen[w] = (name, i)
        edge = np.diff(np.frombuffer(b"\0" + gone + b"\0", np.int8))
        out[name] = (len(raw), sum(gone), int((edge > 0).sum()), hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest())
    return out
