"""Stateful scans over streams whose rows come out of order: `transformWithState` with an ordered buffer and event-time timers.

Rows wait in a buffer until the watermark has passed them, so none earlier can come any more, and then go through their key's scan in
order. Keys share a number of buckets by hash, and a bucket's rows of a batch are one value of its state: calls of the state store are as
many as buckets and batches, whatever the number of keys. One timer a bucket is set, at the earliest row that waits or state that ends. After a pause of more than
`idle_sec` a key's scan begins anew, and its state is deleted once the watermark has passed that. State is a few numbers a key and the
rows within the allowed lateness, and lives in the checkpointed state store: a query that stops goes on where it was.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor


def _millis(ts: pd.Series) -> pd.Series:
    return ts.astype("datetime64[ns]").astype("int64") // 1_000_000


def _packed(rows: pd.DataFrame) -> bytes:
    batch = pa.RecordBatch.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(part: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(part).read_pandas()


class OrderedScan(StatefulProcessor):
    """`step(state, row)` takes a key's state (a tuple, or None at first) and a row's values in order; it gives the next state and the rows to put out.

    `columns` are the key, the time and the values."""

    def __init__(self, columns: Sequence[str], order: Sequence[str], step: Callable, out: Sequence[str], idle_sec: float | None):
        self.columns, self.order, self.step, self.out, self.idle = list(columns), list(order), step, list(out), idle_sec

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "part binary")
        self.scans = handle.getValueState("scans", "held binary")
        self.timer = handle.getValueState("timer", "ms long")

    def _wake(self, ms: int) -> None:
        due = self.timer.get()[0] if self.timer.exists() else None
        if due is None or ms < due:
            if due is not None:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(ms)
            self.timer.update((ms,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [part[self.columns] for part in rows if len(part)]
        if parts:
            held = pd.concat(parts, ignore_index=True)
            self.waiting.appendValue((_packed(held),))
            self._wake(int(_millis(held[self.columns[1]]).min()))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out, ends = timerValues.getCurrentWatermarkInMs(), [], []
        self.timer.clear()
        scans = pickle.loads(self.scans.get()[0]) if self.scans.exists() else {}  # key: time of the last row, state
        if self.waiting.exists():
            rows = pd.concat([_unpacked(part) for (part,) in self.waiting.get()], ignore_index=True).sort_values(self.order, kind="stable")
            at = _millis(rows[self.columns[1]])
            due, rest = rows[at <= now], rows[at > now]
            for one, ms, *values in zip(due[self.columns[0]], at[at <= now], *[due[c] for c in self.columns[2:]]):
                last, state = scans.get(one, (None, None))
                if self.idle is not None and last is not None and ms - last > 1000 * self.idle:
                    state = None
                state, made = self.step(state, *values)
                out += [(one, *m) for m in made]
                scans[one] = (ms, state)
            if len(rest):
                self.waiting.put([(_packed(rest),)])
                ends.append(int(at[at > now].min()))
            else:
                self.waiting.clear()
        if self.idle is not None:
            scans = {one: held for one, held in scans.items() if held[0] + int(1000 * self.idle) + 1 > now}
            ends += [held[0] + int(1000 * self.idle) + 1 for held in scans.values()]
        if scans:
            self.scans.update((pickle.dumps(scans),))
        else:
            self.scans.clear()
        if ends:
            self._wake(min(ends))
        yield pd.DataFrame(out, columns=self.out)

    def close(self) -> None:
        pass


def ordered_scan(events: DataFrame, key: str, ts: str, columns: Sequence[str], order: Sequence[str], late: str, step: Callable, schema: str, idle_sec: float | None = None, buckets: int = 512) -> DataFrame:
    """Rows that `step` puts out, each after its key, for a stream or a table of events; rows later than `late` are dropped.

    `schema` describes the key and what is put out. Rows of equal `ts` go by `order`, names among `ts` and `columns`. Keys go by `buckets`, whose number stays
    as it is for the life of a checkpoint; they travel as strings, since a null among numbers would make a batch's numbers doubles.
    """
    kind = dict(events.dtypes)[key]
    names = [part.split()[0] for part in schema.split(",")]
    rows = events.select(F.pmod(F.xxhash64(key), F.lit(buckets)).alias("key_bucket"), F.col(key).cast("string").alias("own_key"), ts, *columns).withWatermark(ts, late)
    processor = OrderedScan(["own_key", ts, *columns], [ts, *order], step, names, idle_sec)
    found = rows.groupBy("key_bucket").transformWithStateInPandas(processor, ", ".join([f"{key} string", *schema.split(",")[1:]]), "Append", "EventTime")
    return found.withColumn(key, F.col(key).cast(kind))


def boundary_scan(events: DataFrame, key: str, ts: str, at: str, kind: str, starts: Sequence[str], ends: Sequence[str], late: str, skip_sec: float = 180.0, least_sec: float = 300.0, idle_sec: float | None = None, buckets: int = 512) -> DataFrame:
    """(key, episode, start_sec, end_sec): the two-state scan of `folds.boundary_scan`, over rows in any order within `late`."""
    starts, ends = set(starts), set(ends)

    def step(state, t, what):
        opened, ready, count = state or (None, float("-inf"), 0)
        if t < ready:
            return (opened, ready, count), []
        if opened is None and what in starts:
            return (float(t), ready, count), []
        if opened is not None and what in ends and t - opened >= least_sec:
            return (None, float(t + skip_sec), count + 1), [(count, opened, float(t))]
        return (opened, ready, count), []

    return ordered_scan(events.withColumn(at, F.col(at).cast("double")), key, ts, [at, kind], [at, kind], late, step, f"{key} {dict(events.dtypes)[key]}, episode long, start_sec double, end_sec double", idle_sec, buckets)


def carry_forward(events: DataFrame, key: str, ts: str, value: str, late: str, idle_sec: float | None = None, buckets: int = 512) -> DataFrame:
    """(key, ts, value, seen_before, last_before): each row with the number of its key's rows before it and the last value among them."""
    kinds = dict(events.dtypes)

    def step(state, own, v):
        seen, last = state or (0, None)
        return (seen + 1, float(v)), [(own, float(v), seen, last)]

    again = f"{ts}_2"
    rows = events.withColumn(again, F.col(ts)).withColumn(value, F.col(value).cast("double"))
    found = ordered_scan(rows, key, ts, [again, value], [value], late, step, f"{key} {kinds[key]}, {ts} timestamp, {value} double, seen_before long, last_before double", idle_sec, buckets)
    return found
