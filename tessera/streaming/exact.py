"""Admissions, sessions and failure limits over a stream, exact under events that come late or in any order.

Events of a key are held back until the watermark has passed them: no earlier one can come after that, so they are
folded in the order of (time, id), as the batch forms do. What a fold keeps ends at a known time; a timer there
drops it, so a key that falls silent leaves no state.

Keys are dealt into buckets, and state is a bucket's: events between watermark and newest event lie there as Arrow tables of
many, and so does what folds keep. So a batch asks the state store a few times a bucket, however many keys and events
there are; asked for each key or event, it would take nearly all of the time.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tessera.streaming import usage

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NEVER = 1 << 62
#: Buckets that keys are dealt into. A bucket's waiting events are in memory together, as numbers.
BUCKETS = 256
#: Events of one row of state, and results that are given out together.
ROWS = 1 << 14


class Fold(ABC):
    """What is kept of a key, as times, and what an event makes of it."""

    #: Columns that an event's result has besides key, event_id and ms.
    schema: str

    @abstractmethod
    def step(self, held: list[int], at: int, what: str | None) -> tuple[list[int], tuple | None]:
        """(kept, result) after an event at a time; no result: the event only counts."""

    @abstractmethod
    def ends(self, held: list[int]) -> int:
        """When what is kept no longer matters to any event."""


class Admissions(Fold):
    """At most `limit` grants in a width."""

    schema = "granted boolean"

    def __init__(self, limit: int, width_ms: int):
        self.limit, self.width = limit, width_ms

    def step(self, held: list[int], at: int, what: str | None) -> tuple[list[int], tuple | None]:
        granted, held = usage.admit([at], held, self.limit, self.width)
        return held, (granted[0],)

    def ends(self, held: list[int]) -> int:
        return held[-1] + self.width


class Sessions(Fold):
    """Sessions that last so long and are refreshed by use."""

    schema = "valid boolean, expires long"

    def __init__(self, lasts_ms: int, refresh_ms: int, forget_ms: int | None = None):
        self.lasts, self.refresh, self.forget = lasts_ms, refresh_ms, forget_ms

    def step(self, held: list[int], at: int, what: str | None) -> tuple[list[int], tuple | None]:
        valid, expires, held = usage.use_session(at, held, self.lasts, self.refresh)
        return held, (valid, expires)

    def ends(self, held: list[int]) -> int:
        """A session that has ended still refuses the use that finds it so: it is kept, or for forget_ms if that is given."""
        return NEVER if self.forget is None else held[0] + self.forget


class Failures(Fold):
    """Failures in a width before an attempt; events whose `what` is the failure's word are failures, others attempts.

    Failures of an attempt's own time count, so these sort first.
    """

    schema = "failures long, limited boolean"

    def __init__(self, failure: str, most: int, width_ms: int):
        self.failure, self.most, self.width = failure, most, width_ms

    def step(self, held: list[int], at: int, what: str | None) -> tuple[list[int], tuple | None]:
        gone = bisect_right(held, at - self.width)
        if 2 * gone > len(held):  # now and then, so that an event costs the same however many are held
            del held[:gone]
            gone = 0
        if what == self.failure:
            held.append(at)
            return held, None
        n = len(held) - gone
        return held, (n, n >= self.most)

    def ends(self, held: list[int]) -> int:
        return held[-1] + self.width


def _packed(table: pa.Table) -> list[tuple[bytes]]:
    """A table as rows of state."""
    out = []
    for at in range(0, table.num_rows, ROWS):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table.slice(at, ROWS).combine_chunks())
        out.append((sink.getvalue().to_pybytes(),))
    return out


def _unpacked(rows: Iterator[tuple]) -> pa.Table | None:
    tables = [pa.ipc.open_stream(r[0]).read_all() for r in rows]
    return pa.concat_tables(tables).combine_chunks() if tables else None


class Ordered(StatefulProcessor):
    """Holds a bucket's events back until the watermark passes, then folds those of each key in order."""

    def __init__(self, fold: Fold, key: str, first: str | None):
        self.fold, self.key, self.first = fold, key, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "events binary")
        self.held = handle.getListState("held", "kept binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = NEVER
        for frame in rows:
            columns = {"key": pa.array(frame["key"]), "ms": pa.array(frame["ms"], pa.int64()), "event": pa.array(frame["event"], pa.int64()), "what": pa.array(frame["what"], pa.string())}
            self.waiting.appendList(_packed(pa.table(columns)))
            first = min(first, int(frame["ms"].min()))
        self._wake(first)
        return iter(())

    def _wake(self, at: int) -> None:
        """Sees that the bucket's timer, of which it has one, is not later."""
        timers = list(self.handle.listTimers())
        if at < min(timers, default=NEVER):
            for old in timers:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        waiting = _unpacked(self.waiting.get()) if self.waiting.exists() else None
        kept = _unpacked(self.held.get()) if self.held.exists() else None
        due, next_at = None, NEVER
        if waiting is not None:
            now = pc.less_equal(waiting["ms"], passed)
            due, rest = waiting.filter(now), waiting.filter(pc.invert(now))
            if rest.num_rows:
                next_at = pc.min(rest["ms"]).as_py()
            if due.num_rows:
                if rest.num_rows:
                    self.waiting.put(_packed(rest))
                else:
                    self.waiting.clear()
        if kept is not None or due is not None and due.num_rows:
            left: list[tuple[pa.Array, list, list]] = []
            if due is not None and due.num_rows:
                yield from self._folded(due, kept, passed, left)
            if kept is not None:  # of keys without an event, what has not come to its end
                stays = pc.greater(kept["ends"], passed)
                if due is not None and due.num_rows:
                    stays = pc.and_(stays, pc.invert(pc.is_in(kept["key"], pc.unique(due["key"]))))
                kept = kept.filter(stays)
            new = [pa.table({"key": keys, "at": pa.array(at, pa.list_(pa.int64())), "ends": pa.array(ends, pa.int64())}) for keys, at, ends in left]
            kept = pa.concat_tables([*([] if kept is None else [kept]), *new])
            if kept.num_rows:
                self.held.put(_packed(kept))
                next_at = min(next_at, pc.min(kept["ends"]).as_py())
            elif self.held.exists():
                self.held.clear()
        if next_at < NEVER:
            self.handle.registerTimer(next_at)

    def _folded(self, due: pa.Table, kept: pa.Table | None, passed: int, left: list) -> Iterator[pd.DataFrame]:
        """Results of the events, by key in order; what is to be kept of their keys goes to `left`."""
        keys = due["key"].combine_chunks().dictionary_encode()
        codes, distinct = keys.indices.to_numpy(), keys.dictionary
        ms, event, what = due["ms"].to_numpy(), due["event"].to_numpy(), due["what"].to_pylist()
        order = np.lexsort((event, [w != self.first for w in what], ms, codes))
        of: dict[int, list[int]] = {}
        if kept is not None:
            at = pc.index_in(kept["key"], distinct)
            there = pc.is_valid(at)
            of = dict(zip(at.filter(there).to_pylist(), kept["at"].filter(there).to_pylist()))
        names = [c.split()[0] for c in self.fold.schema.split(", ")]
        step, at_end, before, held = self.fold.step, [], -1, []
        for begin in range(0, len(order), ROWS):
            part = order[begin : begin + ROWS]
            results, asks = [], []
            for k, code, at in zip(part.tolist(), codes[part].tolist(), ms[part].tolist()):
                if code != before:
                    if before >= 0:
                        at_end.append((before, held))
                    before, held = code, of.get(code, [])
                held, result = step(held, at, what[k])
                if result is not None:
                    results.append(result)
                    asks.append(k)
            if asks:
                given = due.take(pa.array(asks)).select(["key", "event", "ms"]).rename_columns([self.key, "event_id", "ms"]).to_pandas()
                yield pd.concat([given, pd.DataFrame(results, columns=names)], axis=1)
        at_end.append((before, held))
        ends = [(code, held, end) for code, held in at_end if held and (end := self.fold.ends(held)) > passed]
        left.append((distinct.take(pa.array([e[0] for e in ends], pa.int64())), [e[1] for e in ends], [e[2] for e in ends]))

    def close(self) -> None:
        pass


def folded(events: DataFrame, fold: Fold, key: str, ms: str, event_id: str, late: str, what: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """(key, event_id, ms, ...) of a stream's events with a key and a time, once the watermark has passed them.

    Events may come in any order as long as none is later than `late`; those that are later, or not after the epoch, are left out. An event
    is told from others by its id, a whole number.
    """
    kind = dict(events.dtypes)[key]
    rows = events.where(F.col(key).isNotNull() & F.col(ms).isNotNull()).select(
        F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias("bucket"), F.col(key).alias("key"), F.col(ms).cast("long").alias("ms"), F.col(event_id).cast("long").alias("event"), (F.col(what) if what else F.lit(None)).cast("string").alias("what"), F.timestamp_millis(ms).alias("_at")
    )
    first = fold.failure if isinstance(fold, Failures) else None
    schema = f"{key} {kind}, event_id long, ms long, {fold.schema}"
    return rows.withWatermark("_at", late).groupBy("bucket").transformWithStateInPandas(Ordered(fold, key, first), schema, "Append", "EventTime")


def run_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes what is there of a stream to a Parquet table. State is in RocksDB, which folded() needs and which holds it on disk.

    A store is opened and committed for each partition in every batch, however few rows that has, and takes some MB of local disk for each
    start of the stream, so a new checkpoint gets a partition a core at most; one that exists keeps its own.
    """
    spark = stream.sparkSession
    conf, provider, partitions = spark.conf, "spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions"
    before = {name: conf.get(name) for name in (provider, partitions)}
    conf.set(provider, ROCKS)
    conf.set(partitions, str(min(int(before[partitions]), spark.sparkContext.defaultParallelism)))
    try:
        return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for name, value in before.items():
            conf.set(name, value)
