"""Structured Streaming jobs over lifecycle events.

Every function takes a streaming frame (or a batch frame, where plain
DataFrame semantics allow) and returns one; the caller starts the query.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from litmill.operators import logstore

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES = "task string, event_id long, at long, stage string, previous string"
TERMINAL = ("completed", "failed")


def read_events(spark: SparkSession, folder: str, pattern: str, schema) -> DataFrame:
    """Stream of event files in a folder, with a proper timestamp for watermarks."""
    raw = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def progress(events: DataFrame, by: str, kind: str, kinds: tuple[str, ...]) -> DataFrame:
    """Running counts per execution: planned and one per kind."""
    return events.groupBy(by).agg(
        F.count("*").alias("planned"),
        *[F.count_if(F.col(kind) == k).alias(k) for k in kinds],
    )


class InOrder(StatefulProcessor):
    """Hands a key's rows on in event order, however they arrive within the watermark.

    Arriving rows are sorted, up to ``SORTED`` at a time, and wait in state in
    blocks of ``BLOCK``.  A key has one timer, at the end of the slice of event
    time that holds its earliest row; when the watermark has passed it, the
    rows of all slices that are over come out, merged.  A block is read when
    the merge reaches its first row, so a task holds a block or two of each
    sorted lot, however many rows a key has, and a key costs a few calls of the
    state store for each arrival and each firing, not some for each row.
    """

    SORTED, BLOCK = 65_536, 1_024

    def __init__(self, width_ms: int) -> None:
        self.width = width_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "first long, number long", "rows string")
        self.book = handle.getValueState("book", "number long, timer long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        number, timer = self.book.get() if self.book.exists() else (0, None)
        earliest = None
        arriving = ([r["at"], r["event_id"], r["value"]] for r in rows)
        while lot := sorted(islice(arriving, self.SORTED), key=_in_time):
            number = self._put(lot, number)
            earliest = lot[0][0] if earliest is None else min(earliest, lot[0][0])
        if earliest is not None:
            self.book.update((number, self._timer(timer, self._over(earliest))))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        number, timer = self.book.get() if self.book.exists() else (0, None)
        if timer != expiredTimerInfo.getExpiryTimeInMs():
            return
        mark = timerValues.getCurrentWatermarkInMs()
        until = 1000 * self.width * (mark // self.width)  # slices up to here are over
        blocks = sorted((int(first), int(n)) for first, n in self.waiting.keys())
        due, later = [b for b in blocks if b[0] < until], [b[0] for b in blocks if b[0] >= until]
        rest: list[list] = []
        for row in self.ordered(self._merged(due, until, rest)):
            yield self.row(key, row)
        for lot in rest:
            number = self._put(lot, number)
            later.append(lot[0][0])
        after = self._over(min(later)) if later else self.idle(mark)
        if after is None:
            self.book.clear()
        else:
            self.book.update((number, self._timer(None, after)))

    def _over(self, at: int) -> int:
        """When the slice of a time is over."""
        return (at // (1000 * self.width) + 1) * self.width

    def _timer(self, old: int | None, new: int) -> int:
        if old is not None and old <= new:
            return old
        if old is not None:
            self.handle.deleteTimer(old)
        self.handle.registerTimer(new)
        return new

    def _put(self, rows: list, number: int) -> int:
        for i in range(0, len(rows), self.BLOCK):
            self.waiting.updateValue((rows[i][0], number), (json.dumps(rows[i : i + self.BLOCK]),))
            number += 1
        return number

    def _merged(self, blocks: list, until: int, rest: list[list]) -> Iterator[list]:
        """The rows of sorted blocks before a time, in order; ``rest`` takes what is later."""
        heap: list = []
        blocks = blocks[::-1]
        while blocks or heap:
            while blocks and (not heap or blocks[-1][0] <= heap[0][0][0]):
                at = blocks.pop()
                rows = json.loads(self.waiting.getValue(at)[0])
                self.waiting.removeKey(at)
                heapq.heappush(heap, ((*_in_time(rows[0]), at[1]), 0, rows))
            (_, _, n), i, rows = heap[0]
            yield rows[i]
            i += 1
            if i < len(rows) and rows[i][0] < until:
                heapq.heapreplace(heap, ((*_in_time(rows[i]), n), i, rows))
                continue
            heapq.heappop(heap)
            if i < len(rows):
                rest.append(rows[i:])

    def idle(self, mark: int) -> int | None:
        """Timer of a key without waiting rows; without one the key needs none."""
        return None

    def close(self) -> None:
        pass


def _in_time(row: list) -> tuple:
    return row[0], row[1]


class _Changes(InOrder):
    """Remembers the last stage of a task and emits only changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", "stage string")

    def ordered(self, rows: Iterator[list]) -> Iterator[tuple]:
        known = self.last.exists()
        seen = self.last.get()[0] if known else None
        for at, event_id, stage in rows:
            if stage != seen or not known:
                yield at, event_id, stage, seen
            known, seen = True, stage
        if known:
            self.last.update((seen,))

    def row(self, key, out: tuple) -> Row:
        at, event_id, stage, previous = out
        return Row(task=key[0], event_id=event_id, at=at, stage=stage, previous=previous)


def _rows_in_order(rows: DataFrame, late: str, processor: InOrder, schema: str) -> DataFrame:
    """``processor`` over rows of key, event_id, ts and value; its ``at`` becomes ``ts``."""
    names = ["ts" if c == "at" else c for c in T.StructType.fromDDL(schema).fieldNames()]
    made = rows.withColumn("at", F.unix_micros("ts")).withWatermark("ts", late).groupBy("key").transformWithState(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")
    return made.withColumn("ts", F.timestamp_micros("at")).select(*names)


def stage_changes(events: DataFrame, task: str = "task", late: str = "1 day", slice_ms: int = 3_600_000) -> DataFrame:
    """Rows whose stage differs from the task's previous one in event order, whatever order they arrive in.

    Rows may be late by ``late``; a row comes out once the watermark has passed
    its slice of event time.  State holds what waits and one value per task.
    Needs the RocksDB state store.
    """
    rows = events.select(F.col(task).cast("string").alias("key"), "event_id", "ts", F.col("stage").alias("value"))
    return _rows_in_order(rows, late, _Changes(slice_ms), CHANGES)


def terminal(events: DataFrame, task: str = "task") -> DataFrame:
    """Latest terminal event per task; a later start clears it."""
    order = F.struct("ts", "event_id")
    done = F.col("stage").isin(*TERMINAL)
    rows = events.groupBy(task).agg(
        F.max(F.when(done, order)).alias("_done"),
        F.max_by("stage", F.when(done, order)).alias("terminal"),
        F.max(F.when(F.col("stage") == "started", order)).alias("_start"),
    )
    keep = F.col("_done").isNotNull() & (F.col("_start").isNull() | (F.col("_start") < F.col("_done")))
    return rows.filter(keep).select(task, "terminal", F.col("_done.event_id").alias("event_id"))


class _Lives(InOrder):
    """Lets a key in, then no more until its lifetime is over."""

    def __init__(self, width_ms: int, life_ms: int) -> None:
        super().__init__(width_ms)
        self.life = 1000 * life_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.until = handle.getValueState("until", "at long")

    def ordered(self, rows: Iterator[list]) -> Iterator[tuple]:
        until = self.until.get()[0] if self.until.exists() else None
        before = until
        for at, event_id, _ in rows:
            if until is None or at >= until:
                yield at, event_id
                until = at + self.life
        if until != before:
            self.until.update((until,))

    def idle(self, mark: int) -> int | None:
        if not self.until.exists():
            return None
        end = self._over(self.until.get()[0])  # the rows of this slice still need it
        if end > mark:
            return end
        self.until.clear()
        return None

    def row(self, key, out: tuple) -> Row:
        return Row(key=key[0], event_id=out[1], at=out[0])


def ttl_ids(events: DataFrame, key: str, ttl_ms: int, late: str = "1 day", slice_ms: int = 3_600_000) -> DataFrame:
    """(key, event_id, ts) of the events that let their key in: the first one, and the first after each lifetime.

    Lifetimes are in event time, so a replay gives the same answer; a key is
    dropped from state when its lifetime is over.  Needs the RocksDB state store.
    """
    rows = events.select(F.col(key).cast("string").alias("key"), "event_id", "ts", F.lit("").alias("value"))
    return _rows_in_order(rows, late, _Lives(slice_ms, ttl_ms), "key string, event_id long, at long")


class _Stale(StatefulProcessor):
    """Last event, attempts and lease end per work item; a timer reports leases that ran out.

    The last event is the greatest of (time, id), so rows may come in any order and frame by frame.
    """

    def __init__(self, lease_ms: int, max_attempts: int) -> None:
        self.lease_ms, self.max_attempts = lease_ms, max_attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "ts long, event_id long, open boolean, attempts int, until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ts, event_id, opened, attempts, before = self.state.get() if self.state.exists() else (None, 0, False, 0, 0)
        for frame in rows:
            attempts += int((frame["stage"] == "processing").sum())
            at = frame["ts"].astype("datetime64[us]").astype("int64")
            last = frame.assign(at=at).sort_values(["at", "event_id"]).iloc[-1]
            if ts is None or (int(last["at"]), int(last["event_id"])) > (ts, event_id):
                ts, event_id, opened = int(last["at"]), int(last["event_id"]), bool(last["stage"] == "processing")
        if ts is not None:
            until = ts // 1000 + self.lease_ms if opened else 0
            if until != before:
                if before:
                    self.handle.deleteTimer(before)
                if until:
                    self.handle.registerTimer(until)
            self.state.update((ts, event_id, opened, attempts, until))
        return
        yield  # a generator without rows

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, _, _, attempts, until = self.state.get()
        status = "failed" if attempts >= self.max_attempts else "stale"
        yield pd.DataFrame(
            {"item": [str(key[0])], "attempts": [attempts], "lease_end_ms": [until], "status": [status]}
        )

    def close(self) -> None:
        pass


def stale_stream(events: DataFrame, item: str, lease_ms: int, max_attempts: int = 2) -> DataFrame:
    """Items still in processing when event time passes their lease; attempts used up = failed."""
    rows = events.select(F.col(item).cast("string").alias("item"), "event_id", "ts", "stage")
    rows = rows.withWatermark("ts", "0 seconds")
    return rows.groupBy("item").transformWithStateInPandas(
        statefulProcessor=_Stale(lease_ms, max_attempts),
        outputStructType="item string, attempts int, lease_end_ms long, status string",
        outputMode="Append",
        timeMode="EventTime",
    )


def stale_batch(events: DataFrame, item: str, lease_ms: int, max_attempts: int = 2) -> DataFrame:
    """The same question over a finished table: open items whose lease ended before the last event."""
    order = F.struct("ts", "event_id")
    per = events.groupBy(item).agg(
        F.max_by("stage", order).alias("_last"),
        F.max("ts").alias("_ts"),
        F.count_if(F.col("stage") == "processing").alias("attempts"),
    )
    now = events.agg(F.max("ts").alias("t")).scalar()
    open_ms = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("_ts").cast("timestamp"))) / 1000
    late = per.filter(F.col("_last") == "processing").filter(open_ms > lease_ms)
    status = F.when(F.col("attempts") >= max_attempts, F.lit("failed")).otherwise(F.lit("stale"))
    return late.select(item, "attempts", status.alias("status"))


def windowed_latency(events: DataFrame, stage: str, ms: str, width: str, late: str) -> DataFrame:
    """Stage timings per tumbling window of event time."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", width), stage)
        .agg(F.count("*").alias("n"), F.sum(ms).alias("total_ms"), F.max(ms).alias("max_ms"))
        .select(F.col("window.start").alias("window_start"), stage, "n", "total_ms", "max_ms")
    )


def ingest(records: DataFrame, root: str, schema: T.StructType, buckets: int = logstore.BUCKETS):
    """Start a query that merges arriving records into the article store at ``root``.

    A micro-batch is matched by the stored key index and writes only the
    articles it changes (see :mod:`litmill.operators.logstore`); a retried
    batch starts from the manifest before it, so retries change nothing.
    ``schema`` is that of the articles; batch numbers go on over restarts.
    """
    kept = logstore.ArticleStore(root, schema, buckets)
    return (
        records.writeStream.foreachBatch(kept.upsert)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def ingest_clusters(keys: DataFrame, root: str, ids: T.DataType, buckets: int = logstore.BUCKETS):
    """Start a query that keeps clusters of records up to date as (record_id, kind, value) rows arrive."""
    kept = logstore.ClusterForest(root, ids, buckets)
    return (
        keys.writeStream.foreachBatch(kept.add)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
