"""Decode-time state as Structured Streaming operators.

Arrivals have ``head, pos, key``.  The buffer flushes when it is full; a search
sees the published index and every buffered row at all times.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def chance(pos: int, seed: int = 42) -> int:
    """A fixed pseudo-random number of a position, so that replays decide alike."""
    x = (pos + seed * 0x9E3779B97F4A7C15) & (1 << 64) - 1
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    x = (x ^ x >> 27) * 0x94D049BB133111EB & (1 << 64) - 1
    return x ^ x >> 31


def flushes(arrivals: DataFrame, size: int = 256) -> DataFrame:
    """head, batch, pos, key of full buffers: each head's arrivals in order, ``size`` at a time; the rest stays in state.

    A head's arrivals of one trigger are in memory at once: bound them by the source's rate.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        batch, pos, rows = state.get if state.exists else (0, [], [])
        # a key's frames of one trigger come in any order: they are put in order before the buffer is cut
        f = pd.concat(list(frames)).sort_values("pos", kind="stable")
        pos = [*pos, *f["pos"].tolist()]
        rows = [*map(list, rows), *(list(map(float, k)) for k in f["key"])]
        full = len(pos) // size * size
        for at in range(0, full, size):
            yield pd.DataFrame({"head": key[0], "batch": batch, "pos": pos[at : at + size], "key": rows[at : at + size]})
            batch += 1
        state.update((batch, pos[full:], rows[full:]))

    return arrivals.groupBy("head").applyInPandasWithState(
        step, "head int, batch long, pos long, key array<double>", "batch long, pos array<long>, keys array<array<double>>", "append", "NoTimeout"
    )


def reservoir(arrivals: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """head, seen, sample (positions): Algorithm R with a fixed number per position; the same for all heads."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seen, sample = state.get if state.exists else (0, [])
        sample = list(sample)
        for p in sorted(p for f in frames for p in f["pos"]):
            if len(sample) < size:
                sample.append(int(p))
            elif (j := chance(int(p), seed) % (seen + 1)) < size:
                sample[j] = int(p)
            seen += 1
        state.update((seen, sample))
        yield pd.DataFrame({"head": [key[0]], "seen": [seen], "sample": [sample]})

    return arrivals.groupBy("head").applyInPandasWithState(step, "head int, seen long, sample array<long>", "seen long, sample array<long>", "update", "NoTimeout")


def heavy_hitter_cache(weights: DataFrame, heavy: int, recent: int) -> DataFrame:
    """head, step, kept: the path-dependent cache over ``weights(head, step, pos, p)``.

    Each step adds its weights to the positions still cached (dropped ones are
    gone for good), then keeps the recent and the heaviest of the older ones.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        pos, mass, last = state.get if state.exists else ([], [], -1)
        cache, gone_below = dict(zip(pos, mass, strict=True)), last
        rows = pd.concat(list(frames))
        for s, f in sorted(rows.groupby("step"), key=lambda x: x[0]):
            for p, w in zip(f["pos"], f["p"], strict=True):
                if p in cache or p > gone_below:
                    cache[int(p)] = cache.get(int(p), 0.0) + float(w)
            gone_below = max(gone_below, *cache) if cache else gone_below
            edge = gone_below - recent
            old = sorted((p for p in cache if p <= edge), key=lambda p: (-cache[p], p))
            cache = {p: w for p, w in cache.items() if p > edge} | {p: cache[p] for p in old[:heavy]}
            yield pd.DataFrame({"head": [key[0]], "step": [int(s)], "kept": [sorted(cache)]})
        state.update((list(cache), list(cache.values()), gone_below))

    return weights.groupBy("head").applyInPandasWithState(step, "head int, step long, kept array<long>", "pos array<long>, mass array<double>, last long", "append", "NoTimeout")


class HeavyHitters(StatefulProcessor):
    """The path-dependent cache with one state entry a position: a step rewrites only the entries that it changes.

    Input rows are (head, step, pos, p), several of a position add up; a step's rows arrive in one
    trigger, and later steps in later triggers.  Yields (head, step, kept, mass).  A head's state
    has ``heavy + recent`` entries at most, and the newest position seen.
    """

    def __init__(self, heavy: int, recent: int):
        self.heavy, self.recent = heavy, recent

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.mass = handle.getMapState("mass", "pos long", "mass double")
        self.last = handle.getValueState("last", "pos long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = int(self.last.get()[0]) if self.last.exists() else -1
        stored = {int(k[0]): float(v[0]) for k, v in self.mass.iterator()}
        cache, made = dict(stored), []
        frame = pd.concat(list(rows)).groupby(["step", "pos"], as_index=False)["p"].sum()
        for step, f in frame.groupby("step"):
            for p, w in zip(f["pos"].tolist(), f["p"].tolist(), strict=True):
                if p in cache or p > last:  # what was dropped is gone for good
                    cache[p] = cache.get(p, 0.0) + w
            last = max([last, *cache])
            old = sorted((p for p in cache if p <= last - self.recent), key=lambda p: (-cache[p], p))
            for p in old[self.heavy :]:
                del cache[p]
            made.append((int(key[0]), int(step), sorted(cache), float(sum(cache.values()))))
        for p in stored.keys() - cache.keys():
            self.mass.removeKey((p,))
        for p, w in cache.items():
            if stored.get(p) != w:
                self.mass.updateValue((p,), (w,))
        self.last.update((last,))
        yield pd.DataFrame(made, columns=["head", "step", "kept", "mass"])

    def close(self) -> None:
        pass


#: Where map state by key lives: the default store holds whole values only.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def heavy_hitters(weights: DataFrame, heavy: int, recent: int) -> DataFrame:
    """head, step, kept, mass of a stream ``weights(head, step, pos, p)``; the session's state store must be ``STORE``."""
    return weights.groupBy("head").transformWithStateInPandas(HeavyHitters(heavy, recent), "head int, step long, kept array<long>, mass double", "append", "none")


class VersionedIndex:
    """Index rows in a table of versions; readers see what was published when they opened it, writers add without touching it.

    ``publish`` writes a version's rows first and its entry in the log last, so that a
    failed write leaves an unpublished version that no reader sees, and a repeated one
    changes nothing.  ``compact`` publishes all rows so far as one folder, so that a reader opens
    few; readers that opened the log before go on reading the folders that it
    named, until ``vacuum`` removes those that no longer count.
    """

    LOG = "version long, first long, folder string"

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path

    def log(self) -> list[tuple[int, int, str]]:
        """(version, first version that its folder covers, folder) of all that was published."""
        try:
            rows = self.spark.read.schema(self.LOG).json(f"{self.path}/published").collect()
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise
        return sorted((r["version"], r["version"] if r["first"] is None else r["first"], r["folder"] or f"rows/{r['version']}") for r in rows)

    def versions(self) -> list[int]:
        return sorted({v for v, first, _ in self.log() if v == first})

    def folders(self, upto: int | None = None) -> list[str]:
        """The fewest folders that hold every version (up to one): the last compaction, and what came after."""
        seen = [e for e in self.log() if upto is None or e[0] <= upto]
        whole = max((e for e in seen if e[1] < e[0]), default=None)
        return ([whole[2]] if whole else []) + [f for v, first, f in seen if v == first and (whole is None or v > whole[0])]

    def publish(self, rows: DataFrame, version: int) -> None:
        if version in self.versions():  # a replayed micro-batch
            return
        rows.withColumn("version", F.lit(version)).write.mode("overwrite").parquet(f"{self.path}/rows/{version}")
        self._enter(version, version, f"rows/{version}")

    def _enter(self, version: int, first: int, folder: str) -> None:
        self.spark.createDataFrame([(version, first, folder)], self.LOG).write.mode("append").json(f"{self.path}/published")

    def read(self, upto: int | None = None) -> DataFrame | None:
        """A snapshot: what is published now (up to a version), whatever is published before it is evaluated."""
        seen = self.folders(upto)
        return self.spark.read.parquet(*[f"{self.path}/{f}" for f in seen]) if seen else None

    def compact(self) -> None:
        """One folder for all versions so far, published as an entry of the last one; its rows keep their versions."""
        seen = self.versions()
        if len(self.folders()) < 2:
            return
        folder = f"compact/{seen[-1]}"
        self.read(seen[-1]).write.mode("overwrite").parquet(f"{self.path}/{folder}")
        self._enter(seen[-1], seen[0] - 1, folder)

    def vacuum(self) -> list[str]:
        """Remove the folders that a reader who opens the log now would not read; returns them."""
        keep, jvm = set(self.folders()), self.spark.sparkContext._jvm
        gone = [f for _, _, f in self.log() if f not in keep]
        for f in gone:
            at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{f}")
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        return gone

    def search_view(self, buffer: DataFrame) -> DataFrame:
        """Everything published together with the rows still buffered."""
        own = self.read()
        return buffer if own is None else own.select(*buffer.columns).unionByName(buffer)


def index_stream(arrivals: DataFrame, index: VersionedIndex, size: int, checkpoint: str):
    """Start a query that publishes every full buffer as a version of the index."""

    def write(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            index.publish(batch, number)

    return flushes(arrivals, size).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write)


def arrivals_of(events: DataFrame) -> DataFrame:
    """``events`` as arrivals: head is the user mod 4, pos the event, key two numbers of it."""
    return events.select((F.col("user_id") % 4).cast("int").alias("head"), F.col("event_id").alias("pos"), F.array(F.col("value"), F.lit(1.0)).alias("key"))


