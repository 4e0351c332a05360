"""Small helpers that several of these operators share."""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from litmill.scale import stage

# A word: a run of anything but blank, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
find_words = re.compile(WORD).findall

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Array of words; empty for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def running_total(
    df: DataFrame, order: Sequence[str], value: Column, name: str, label: str
) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows that sort before each row.

    The rows are dealt by range on the whole order, summed within each range,
    and the ranges' totals (one row each) are carried forward, so no task sees
    more than its range.  Nulls sort first; rows equal in every order column
    come in any order.
    """
    ranged = df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order])
    kept = stage(ranged.withColumn("_v", value.cast("long")).withColumn("_part", F.spark_partition_id()), label)
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    parts = kept.groupBy("_part").agg(F.sum("_v").alias("_t")).select(
        "_part", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_base")
    )
    within = (
        W.partitionBy("_part")
        .orderBy(*[F.col(c).asc_nulls_first() for c in order])
        .rowsBetween(W.unboundedPreceding, -1)
    )
    out = kept.withColumn("_run", F.coalesce(F.sum("_v").over(within), F.lit(0)))
    return out.join(parts, "_part").withColumn(name, F.col("_run") + F.col("_base")).drop("_part", "_v", "_run", "_base")


def worker_cache(name: str, make: Callable[[], object]) -> object:
    """An object kept for the life of a Python worker, over the tasks it runs; the last one asked for only.

    A job that runs several operators so holds the memory of one at a time.
    """
    kept = getattr(sys, "_litmill_cache", None)
    if kept is None or kept[0] != name:
        sys._litmill_cache = None
        kept = (name, make())
        sys._litmill_cache = kept
    return kept[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A strong bit mixer on unsigned 64-bit integers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """64-bit hash of each word, remembered for frequent words up to a memory bound."""

    LIMIT = 400_000

    def __init__(self) -> None:
        self.seen: dict[str, int] = {}

    def __call__(self, words: list[str]) -> np.ndarray:
        import xxhash

        seen = self.seen
        if len(seen) > self.LIMIT:
            seen.clear()
        try:
            return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
        except KeyError:
            for w in words:
                if w not in seen:
                    seen[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
            return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` consecutive word hashes, by doubling run lengths."""
    if len(h) < n:
        return h[:0]
    done, out, step, run = 0, np.zeros(len(h) - n + 1, np.uint64), 1, h
    while True:
        if n & step:
            out = mixed(out * np.uint64(3) + run[done : done + len(out)] + np.uint64(step))
            done += step
        if done == n:
            return out
        run = mixed(run[:-step] * np.uint64(0x9E3779B97F4A7C15) + run[step:])
        step *= 2


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """Texts of a batch, null as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def list_array(lengths: Sequence[int] | np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, type=kind))


Batches = Iterator[pa.RecordBatch]


class IdPool:
    """Key to a list of ids, for frequent keys of a worker; a bounded table of its own, emptied when full."""

    LIMIT = 1_100_000

    def __init__(self, extra: int = 0) -> None:
        self.extra = extra
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.ids = np.zeros(1 << 16, np.int32)
        self.start = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)
        self.more = np.zeros((1 << 14, self.extra))
        self.n_ids = 0

    @staticmethod
    def _room(a: np.ndarray, need: int) -> np.ndarray:
        if need <= len(a):
            return a
        out = np.zeros((max(need, 2 * len(a)), *a.shape[1:]), a.dtype)
        out[: len(a)] = a
        return out

    def add(self, keys: list[str], lists: list[list[int]], more: list[tuple] | None = None) -> None:
        n, size = len(self.at), np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter(chain.from_iterable(lists), np.int32, int(size.sum()))
        self.ids = self._room(self.ids, self.n_ids + len(flat))
        self.ids[self.n_ids : self.n_ids + len(flat)] = flat
        for name in ("start", "size", "more"):
            setattr(self, name, self._room(getattr(self, name), n + len(keys)))
        self.start[n : n + len(keys)] = self.n_ids + np.cumsum(size) - size
        self.size[n : n + len(keys)] = size
        if more is not None:
            self.more[n : n + len(keys)] = more
        self.n_ids += len(flat)
        self.at.update(zip(keys, range(n, n + len(keys))))

    def take(self, rows: np.ndarray) -> np.ndarray:
        """Ids of the rows, one after another."""
        size = self.size[rows]
        ends = np.cumsum(size)
        if not len(ends):
            return self.ids[:0]
        return self.ids[np.repeat(self.start[rows] - (ends - size), size) + np.arange(ends[-1])]
