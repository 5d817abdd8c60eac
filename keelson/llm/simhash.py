"""SimHash near-duplicates with BK-trees.

A text's fingerprint has a bit where over half of its shingles' hashes have
it.  Two fingerprints within ``radius`` bits agree on one of ``radius + 1``
blocks of bits (on two of ``radius + 2``, and so on), so distinct fingerprints
are dealt to shards by the value of each block or choice of blocks, and every shard is one BK-tree: a node's children are keyed by
their integer Hamming distance to it, and a search follows only the edges
within the radius of its own distance.  Shards are dealt out instead of being
broadcast whole, since their number grows with the corpus; a shard of more
than ``SPLIT`` fingerprints is cut into chunks whose pairs are tasks of their
own.

Copies are collapsed first.  A shard returns each fingerprint's link to its
shard-local component only, never all pairs; components are then joined
across shards by star contraction.  Texts without words have fingerprint zero
and link like any other; null text is empty.  Null ids take part and get the
component's least known id.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import cut, free_name, join_unique, map_columns, quoted, with_groups
from keelson.llm.components import connected_components, contracted

SEED, BITS = 42, 64
#: Fingerprints of a leaf, of a shard on average, of a shard before it is split, of a shard before more blocks make its key; pairs held before they are united.
LEAF, SHARD, SPLIT, LARGE, HELD = 64, 1000, 25_000, 64_000, 1 << 20
#: MinHash values of a shingle set, and those of a band: two sets of resemblance J share none of the bands with (1 - J**ROWS) ** (BINS / ROWS), 3 in a million at 0.8.
BINS, ROWS = 160, 5
#: How far below the least resemblance an estimate may lie for its pair to be compared exactly (4.7 standard errors at 0.8); bytes of a side of a comparison; rows of the broadcast keys.
SLACK, CHUNK_BYTES, MOST_KEYS = 0.15, 12 << 20, 1_000_000
_MASKS, _FACTORS = np.random.default_rng(42).integers(0, 1 << 64, (2, BINS, 1), np.uint64, endpoint=False)
_FACTORS |= np.uint64(1)


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of every shingle of ``size`` words (of the whole sequence if shorter), in order, repeats included."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(size, len(words))
    cuts = map(slice, starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())
    return np.fromiter(map(xxhash.xxh64_intdigest, map(flat.__getitem__, cuts), repeat(SEED)), np.uint64, len(words) - k + 1)


def fingerprint(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.unpackbits(hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += part.sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << np.flatnonzero(2 * counts > len(hashes)).astype(np.uint64)).sum())


def signature(hashes: np.ndarray) -> tuple[bytes, list[int]]:
    """MinHash of a shingle set: one byte of each of BINS minima, and a key of each band; nothing for an empty set."""
    import xxhash

    if not len(hashes):
        return bytes(BINS), []
    least = np.full(BINS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 1024):
        np.minimum(least, ((hashes[None, at : at + 1024] ^ _MASKS) * _FACTORS).min(axis=1), out=least)
    keys = [xxhash.xxh64_intdigest(least[k : k + ROWS].tobytes(), k) for k in range(0, BINS, ROWS)]
    return ((least >> np.uint64(16)) % np.uint64(255) + np.uint64(1)).astype(np.uint8).tobytes(), keys


def resemblance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard resemblance of rows of sketches."""
    either = np.maximum(((a | b) > 0).sum(axis=1), 1)
    same = ((a == b) & (a > 0)).sum(axis=1) / either
    return (same - 1 / 255) / (1 - 1 / 255)


class BKTree:
    """A BK-tree over distinct fingerprints that is searched with many at once."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        self.nodes: list[tuple] = []  # (pivot, {distance: node}) or (None, members)
        todo = [(np.arange(len(prints)), None, 0)]
        while todo:
            members, parent, distance = todo.pop()
            at = len(self.nodes)
            if parent is not None:
                self.nodes[parent][1].append((distance, at))
            if len(members) <= LEAF:
                self.nodes.append((None, members))
                continue
            pivot, rest = members[0], members[1:]
            d = np.bitwise_count(prints[rest] ^ prints[pivot])
            by = np.argsort(d, kind="stable")
            keys, first = np.unique(d[by], return_index=True)
            self.nodes.append((pivot, []))
            todo += [(part, at, int(k)) for k, part in zip(keys, np.split(rest[by], first[1:]), strict=True)]

    def pairs(self, queries: np.ndarray, radius: int):
        """Yield (query indices, member indices) within the radius, block by block."""
        todo = [(0, np.arange(len(queries)))]
        while todo:
            at, q = todo.pop()
            pivot, below = self.nodes[at]
            if pivot is None:
                step = max(1, HELD // max(1, len(below)))
                for i in range(0, len(q), step):
                    a, b = np.nonzero(np.bitwise_count(queries[q[i : i + step], None] ^ self.prints[None, below]) <= radius)
                    yield q[i : i + step][a], below[b]
                continue
            d = np.bitwise_count(queries[q] ^ self.prints[pivot]).astype(np.int64)
            near = q[d <= radius]
            yield near, np.full(len(near), pivot)
            for k, child in below:
                follow = q[np.abs(d - k) <= radius]
                if len(follow):
                    todo.append((child, follow))


def unite(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge the sets of i and j; ``parent`` holds each element's root before and after."""
    while True:
        a, b = parent[i], parent[j]
        differ = a != b
        if not differ.any():
            return
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up


def shard_links(prints: np.ndarray, radius: int, chunk: np.ndarray | None = None, sketches: np.ndarray | None = None, least: float = 0.0) -> np.ndarray:
    """The root, as an index, of every fingerprint of a shard; with ``sketches``, its first neighbour.

    A first neighbour is a pair to compare, and not yet a link.  With two different values in ``chunk``, only pairs across them are searched.
    """
    parent, first = np.arange(len(prints)), np.arange(len(prints))
    left = right = np.arange(len(prints))
    if chunk is not None and (values := np.unique(chunk)).size == 2:
        left, right = np.flatnonzero(chunk == values[0]), np.flatnonzero(chunk == values[1])
    tree = BKTree(prints[right])
    held, size = [], 0
    for at in range(0, len(left), 4096):
        block = left[at : at + 4096]
        for q, m in tree.pairs(prints[block], radius):
            a, b = block[q], right[m]
            new = parent[a] != parent[b]
            a, b = a[new], b[new]
            if sketches is not None and len(a):
                ok = np.concatenate([resemblance(sketches[a[i : i + 65536]], sketches[b[i : i + 65536]]) >= least for i in range(0, len(a), 65536)])
                a, b = a[ok], b[ok]
            if len(a):
                if sketches is not None:
                    np.minimum.at(first, np.maximum(a, b), np.minimum(a, b))
                held.append((a, b))
                size += len(a)
            if size > HELD:
                unite(parent, *map(np.concatenate, zip(*held, strict=True)))
                held, size = [], 0
    if held:
        unite(parent, *map(np.concatenate, zip(*held, strict=True)))
    return parent if sketches is None else first


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text", sketched: bool = False) -> DataFrame:
    """id, fp (the fingerprint as a signed long); if asked for, node (a hash of the shingle set), size, sketch and bands of the set."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema["id"].dataType.simpleString()

    def run(cols: dict) -> dict:
        import xxhash

        out: dict[str, list] = {"id": cols["id"], "fp": [], "node": [], "size": [], "sketch": [], "bands": []}
        for text in cols["text"]:
            h = shingle_hashes(text, words)
            out["fp"].append(_signed(fingerprint(h)))
            if sketched:
                h = np.unique(h)
                sketch, bands = signature(h)
                out["node"].append(_signed(xxhash.xxh64_intdigest(h.tobytes())))
                out["size"].append(len(h))
                out["sketch"].append(sketch)
                out["bands"].append([_signed(x) for x in bands])
        return out

    return map_columns(src, f"id {kind}, fp bigint" + ", node bigint, size bigint, sketch binary, bands array<bigint>" * sketched, run)


def block_keys(radius: int, count: int) -> list[list[tuple[int, int]]]:
    """Groups of (shift, width) blocks, one of which two fingerprints within ``radius`` bits share whatever bits differ.

    Of ``radius + c`` blocks at least c are equal, so all choices of c blocks
    are keys: c is 1, and more only where single blocks would leave more than
    ``LARGE`` of ``count`` fingerprints in a shard.  Blocks are cut to the bits
    that leave about ``SHARD``.
    """
    need = (max(count, 1) // SHARD).bit_length()
    if not need:
        return [[(0, 0)]]
    c = next((c for c in (1, 2, 3) if count >> (BITS * c // (radius + c)) <= LARGE), 4)
    edges = [round(i * BITS / (radius + c)) for i in range(radius + c + 1)]
    blocks = [(a, min(b - a, -(-need // c))) for a, b in zip(edges, edges[1:], strict=False)]
    return [list(chosen) for chosen in combinations(blocks, c)]


def _value(blocks: list[tuple[int, int]]) -> Column:
    out = F.lit(0).cast("long")
    for shift, width in blocks:
        out = F.shiftleft(out, width).bitwiseOR(F.shiftrightunsigned("fp", shift).bitwiseAND((1 << width) - 1))
    return out


def links(prints: DataFrame, radius: int, least: float = 0.0, sure: int | None = None, count: int | None = None) -> DataFrame:
    """Edges ``u, v`` of signed node numbers that connect what links within shards; with a sketch, pairs to compare.

    ``prints(node, fp[, sketch])``: distinct nodes.  Fingerprints within ``sure``
    bits (``radius`` if not given) are certain to share a shard; those between
    ``sure`` and ``radius`` link where they happen to.
    """
    count = prints.count() if count is None else count
    sketched = "sketch" in prints.columns
    groups = block_keys(radius if sure is None else sure, count)
    keys = [F.struct(F.lit(k).alias("block"), _value(blocks).alias("value")) for k, blocks in enumerate(groups)]
    dealt = prints.withColumn("key", F.explode(F.array(*keys))).select("node", "fp", *["sketch"] * sketched, "key.block", "key.value")
    # shards that are too large for one task: at most blocks * count / SPLIT of them
    large = dealt.groupBy("block", "value").count().where(F.col("count") > SPLIT).select("block", "value", F.ceil(F.col("count") / SPLIT).cast("int").alias("chunks"))
    large = F.broadcast(large) if len(groups) * count // SPLIT <= MOST_KEYS else large
    split = dealt.join(large, ["block", "value"], "left").withColumn("chunk", F.coalesce(F.pmod(F.xxhash64("node"), "chunks").cast("int"), F.lit(0)))
    split = split.withColumn("other", F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1))))
    split = split.select("node", "fp", *["sketch"] * sketched, "block", "value", "chunk", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node")
        sketches = np.frombuffer(b"".join(group["sketch"]), np.uint8).reshape(len(group), -1) if sketched else None
        nodes = group["node"].to_numpy(np.int64)
        parent = shard_links(group["fp"].to_numpy(np.int64).view(np.uint64), radius, group["chunk"].to_numpy(), sketches, least)
        moved = parent != np.arange(len(parent))
        return pd.DataFrame({"u": nodes[moved], "v": nodes[parent[moved]]})

    return split.groupBy("block", "value", "low", "high").applyInPandas(run, "u bigint, v bigint")


def shingle_sets(docs: DataFrame, distinct: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """node, sketch, bands, hashes (its shingle set, sorted) of the ``wanted(node)`` of ``distinct``, from the row of ``docs(key, text)`` with the least key."""
    keys = cut(distinct.join(wanted, "node", "left_semi").select("node", F.col("least").alias("key"), "sketch", "bands"))
    # half a kilobyte a row: up to MOST_KEYS the texts stay where they are
    keys = F.broadcast(keys) if keys.count() <= MOST_KEYS else keys

    def gather(cols: dict) -> dict:
        return cols | {"hashes": [np.unique(shingle_hashes(t, words)).tobytes() for t in cols["text"]]}

    found = docs.join(keys, "key").select("node", "sketch", "bands", "text")
    # rows that share an id and a text give one set
    return cut(map_columns(found, "node bigint, sketch binary, bands array<bigint>, hashes binary", gather).dropDuplicates(["node"]))


def exact_links(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs(u, v)`` whose shingle sets resemble each other by ``least`` or more; ``sets(node, hashes)``."""

    def compare(cols: dict) -> dict:
        out: dict[str, list] = {"u": [], "v": []}
        for u, v, a, b in zip(cols["u"], cols["v"], cols["a"], cols["b"], strict=True):
            a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            if both / max(len(a) + len(b) - both, 1) >= least:
                out["u"].append(u)
                out["v"].append(v)
        return out

    one, other = (sets.select(F.col("node").alias(x), F.col("hashes").alias(h)) for x, h in (("u", "a"), ("v", "b")))
    full = pairs.join(one, "u").join(other, "v")
    return cut(map_columns(full.select("u", "v", "a", "b"), "u bigint, v bigint", compare))


def band_links(nodes: DataFrame, shared: DataFrame, sets: DataFrame, least: float, total: int) -> DataFrame:
    """Links ``u, v`` between different roots, of pairs that share a band and resemble each other by ``least`` or more.

    ``nodes(node, root, size)``; ``shared(key, node)``: the bands that several
    nodes have, ``total`` rows at most.  Of a band's nodes, those of its most frequent root
    are searched by all others, and the others by each other; nodes of one root
    are never compared.  Both sides are cut into chunks of ``CHUNK_BYTES``, so a
    band of any size is many tasks; sets travel once to a task, and only links
    that join two groups leave it.  A pair is compared in its first common band.
    """
    dealt = shared.join(nodes.select("node", "root", (F.col("size") * 8 + 500).alias("bytes")), "node")
    by_root = dealt.groupBy("key", "root").agg(F.count("*").alias("many"), F.sum("bytes").alias("bytes"))
    by_key = by_root.groupBy("key").agg(F.max_by("root", F.struct("many", "root")).alias("main"), F.max(F.struct("many", "root", "bytes"))["bytes"].alias("main_bytes"), F.sum("bytes").alias("bytes"), F.sum("many").alias("n"), F.count("*").alias("roots"))
    open_ = cut(by_key.where("roots > 1").select("key", "n", "main", F.ceil(F.col("main_bytes") / CHUNK_BYTES).cast("int").alias("mains"), F.ceil((F.col("bytes") - F.col("main_bytes")) / CHUNK_BYTES).cast("int").alias("others"), F.col("bytes").alias("all")))
    tasks = (open_.agg(F.coalesce(F.sum("all"), F.lit(0))).first()[0] // (4 * CHUNK_BYTES)) + 1
    dealt = cut(join_unique(dealt, open_.drop("all"), "key", total))
    is_main = F.col("root") == F.col("main")
    own = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    place = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), x.alias("x"), y.alias("y"))
    across = F.transform(upto("others"), lambda j: place(0, own(F.col("mains")), j))
    against = F.transform(upto("mains"), lambda i: place(0, i, own(F.col("others"))))
    among = F.transform(upto("others"), lambda j: place(1, F.least(own(F.col("others")), j), F.greatest(own(F.col("others")), j)))
    rows = dealt.select("key", "node", "root", is_main.alias("main"), F.when(is_main, 0).otherwise(own(F.col("others"))).alias("chunk"), F.explode(F.when(is_main, across).otherwise(F.concat(against, among))).alias("at"))
    rows = rows.select("key", "node", "root", "main", "chunk", "at.*").withColumn("task", F.pmod(F.xxhash64("key", "x", "y"), F.lit(tasks)))
    heavy = rows.select("task", "node").distinct().join(sets, "node")
    heavy = heavy.select(F.col("task").alias("at_task"), F.col("node").alias("name"), "sketch", "bands", "hashes")

    def run(light: pd.DataFrame, heavy: pd.DataFrame) -> pd.DataFrame:
        if not len(light) or not len(heavy):
            return pd.DataFrame({"u": np.zeros(0, np.int64), "v": np.zeros(0, np.int64)})
        heavy = heavy.sort_values("name")
        found = LinkFinder(heavy["name"].to_numpy(np.int64), heavy["sketch"], heavy["bands"], heavy["hashes"], least)
        for (key, kind, _, _), group in light.sort_values(["key", "kind", "x", "y", "node"]).groupby(["key", "kind", "x", "y"], sort=True):
            found.search(int(key), group["node"].to_numpy(np.int64), group["root"].to_numpy(np.int64), group["main"].to_numpy(bool), group["chunk"].to_numpy(np.int64), kind == 0)
        return pd.DataFrame({"u": [max(p) for p in found.links], "v": [min(p) for p in found.links]}, dtype=np.int64)

    # as many partitions as there are tasks, whatever the session's number
    light, heavy = rows.repartition(tasks, "task"), heavy.repartition(tasks, "at_task")
    return light.groupBy("task").cogroup(heavy.groupBy("at_task")).applyInPandas(run, "u bigint, v bigint")


class LinkFinder:
    """Compares the nodes of a task's bands, and remembers which of them are already joined."""

    def __init__(self, nodes: np.ndarray, sketches, bands, hashes, least: float):
        self.nodes, self.least, self.links = nodes, least, []
        self.sketches = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(nodes), -1)
        self.bands = np.array(bands.tolist(), np.int64).reshape(len(nodes), -1)
        self.sets = [np.frombuffer(h, np.uint64) for h in hashes]
        self.sizes = np.fromiter(map(len, self.sets), np.int64, len(nodes))
        self.group: dict[int, int] = {}  # root -> root that it was joined to

    def root(self, r: int) -> int:
        while (up := self.group.get(r, r)) != r:
            r = up
        return r

    def search(self, key: int, node: np.ndarray, root: np.ndarray, main: np.ndarray, chunk: np.ndarray, across: bool) -> None:
        at = np.searchsorted(self.nodes, node)
        band = int(np.flatnonzero(self.bands[at[0]] == key)[0])
        others = np.flatnonzero(~main)
        apart = chunk[others].min(initial=0) != chunk[others].max(initial=0)  # two different chunks: only pairs across them
        for k, i in enumerate(others.tolist()):
            if across:
                near = np.flatnonzero(main)
            else:
                near = others[k + 1 :]
                near = near[chunk[near] != chunk[i]] if apart else near
            near = near[root[near] != root[i]]
            x, y = at[i], at[near]
            low, high = np.minimum(self.sizes[x], self.sizes[y]), np.maximum(self.sizes[x], self.sizes[y])
            keep = low >= self.least * high * (1 - 1e-9)
            keep[keep] = (self.bands[y[keep]] == self.bands[x]).argmax(axis=1) == band
            near, y = near[keep], y[keep]
            if not len(y):
                continue
            like = resemblance(self.sketches[x][None], self.sketches[y])
            by = np.argsort(-like, kind="stable")
            self.compare(x, i, near[by[: int((like >= self.least - SLACK).sum())]], at, root)

    def compare(self, x: int, i: int, near: np.ndarray, at: np.ndarray, root: np.ndarray) -> None:
        """Join node ``x`` to every other group that one of ``near``, the likeliest first, links it to."""
        own = self.sets[x]
        for start in range(0, len(near), 32):
            block = [j for j in near[start : start + 32].tolist() if self.root(int(root[j])) != self.root(int(root[i]))]
            if not block:
                continue
            flat = np.concatenate([self.sets[at[j]] for j in block])
            place = np.minimum(np.searchsorted(own, flat), len(own) - 1)
            sizes = self.sizes[at[block]]
            both = np.add.reduceat((own[place] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
            for j, n, size in zip(block, both.tolist(), sizes.tolist(), strict=True):
                a, b = self.root(int(root[i])), self.root(int(root[j]))
                if a != b and n / (len(own) + size - n) >= self.least:
                    self.links.append((int(self.nodes[x]), int(self.nodes[at[j]])))
                    self.group[max(a, b)] = min(a, b)


def simhash_groups(docs: DataFrame, words: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp and component_id (the least id reachable over links of at most ``radius`` bits) of every row."""
    prints = cut(fingerprints(docs, words, id_col, text_col))
    distinct = cut(prints.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")))
    nodes = distinct.select(F.col("fp").alias("node"), "fp")
    roots = connected_components(links(nodes, radius))
    # one row a fingerprint, then the least id of each component, then back to the documents
    named = cut(distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    texts, groups = named.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    known = join_unique(named.withColumnRenamed("n", "copies"), cut(least), "root", groups).select("fp", F.col("copies").alias("n"), "component_id")
    return join_unique(prints, cut(known), "fp", texts).select(F.col("id").alias(id_col), "fp", "component_id")


def simhash_report(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return simhash_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame, words: int = 5, radius: int = 12, least: float = 0.8, sure: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that are the first of their near-duplicate group.

    Texts link if the sets of their ``words``-word shingles have a resemblance
    of ``least`` or more, compared exactly.  Compared are first neighbours
    within ``radius`` bits in SimHash shards (found for certain within ``sure``
    bits) whose estimate is that high, and then what is still apart and shares
    a MinHash band, which misses 3 in a million at 0.8, whatever the size.  Of a
    group the row with the least id stays (null ids come last, then the least
    text hash); of repeated rows, one.
    """
    last = F.lit((1 << 63) - 1)
    keys = [F.coalesce(F.col(id_col), last).alias("k1"), F.coalesce(F.xxhash64(text_col), F.lit(0)).alias("k2")]
    own = docs.select(F.struct(*keys).alias("key"), F.col(text_col).alias("text"))
    prints = cut(fingerprints(own, words, "key", "text", sketched=True))
    distinct = cut(prints.groupBy("node").agg(F.min("id").alias("least"), *[F.min(c).alias(c) for c in ("fp", "size", "sketch", "bands")]))
    count = distinct.count()
    near = links(distinct.select("node", "fp", "sketch"), radius, least, sure, count)
    near = cut(near.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct())
    total = BINS // ROWS * count
    shared = cut(with_groups(distinct.select("node", F.explode("bands").alias("key")), "key", {"several": F.count("*")}, total).where("several > 1").select("key", "node"))
    sets = shingle_sets(own, distinct, near.select(F.col("u").alias("node")).union(near.select("v")).union(shared.select("node")), words)

    # groups that are known to belong together, not yet all that do
    certain = contracted(exact_links(near, sets, least), 2, settle=False)
    known = certain.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    rooted = distinct.select("node", "size").join(known, "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = band_links(rooted, shared, sets, least, total)
    roots = connected_components(certain.union(apart))
    named = distinct.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = named.groupBy("root").agg(F.min("least").alias("least")).select("least.k1", "least.k2")
    k1, k2 = free_name(docs, "k1"), free_name(docs, "k2")
    kept = docs.withColumns({k1: keys[0], k2: keys[1]}).join(first.toDF(k1, k2), [k1, k2], "left_semi")
    if not prints.groupBy("id").count().where("count > 1").isEmpty():  # repeated rows
        kept = kept.dropDuplicates([k1, k2])
    return kept.select(*map(quoted, docs.columns))
