"""Keyed state machines over event time.

The logic of a stream operator is a pure pair of functions on a small state: ``step`` for a row
and ``tick`` for the passing of time. ``OrderedProcessor`` runs it in a stream: rows wait in
keyed state, in buckets of time, until the watermark passes them; then they run in time order, so
neither the order of micro-batches nor the order inside one matters. ``fold_sorted`` runs the same
functions on a table, one pass over sorted partitions; give it keys that restart the state (a message, a
response) where there are such, so a hot stream spreads.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

PACKED, PACKED_ROWS = "_rows", 4096
State = dict[str, Any]
Rows = list[tuple]


@dataclass
class Machine:
    """``step(state, row) -> rows``, ``tick(state, now_us) -> rows``; both change the state.

    ``columns`` are the row columns the step reads, first the time in microseconds, then an id.
    ``deadline(state)`` is the next time at which ``tick`` has something to do.
    """

    step: Callable[[State, tuple], Rows]
    columns: Sequence[str]
    output: str
    tick: Callable[[State, int], Rows] = lambda state, now: []
    deadline: Callable[[State], int | None] = lambda state: None
    initial: State = field(default_factory=dict)

    def run(self, state: State, row: tuple) -> Rows:
        return self.tick(state, row[0]) + self.step(state, row)


class OrderedProcessor(StatefulProcessor):
    """Runs a machine per key on rows in event-time order.

    Rows wait in map state under their bucket (``bucket_ms`` of event time). A timer at the latest row
    of a bucket reads that bucket alone and removes it, or what of it the watermark has passed; a
    deadline of the machine has a timer of its own. Timers of a key fire in the order of their times.
    """

    def __init__(self, machine: Machine, key: str, row_schema: StructType, out_columns: list[str], bucket_ms: int):
        self.machine, self.key, self.row_schema, self.out_columns, self.bucket_ms = machine, key, row_schema, out_columns, bucket_ms

    def init(self, handle) -> None:
        self.handle = handle
        rows = StructType([StructField("rows", ArrayType(self.row_schema))])
        self.waiting = handle.getMapState("waiting", StructType([StructField("bucket", LongType())]), rows)
        self.state = handle.getValueState("state", "done long, json string")  # all rows up to ``done`` (ms) have run

    def _held(self, bucket: int) -> list[tuple]:
        return [tuple(r) for r in self.waiting.getValue((bucket,))[0]] if self.waiting.containsKey((bucket,)) else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if key[0] is None or key[0] != key[0]:  # the mark of the end of input, which only moves the watermark
            return iter([])
        arrived: dict[int, list[tuple]] = {}
        for pdf in rows:
            for row in zip(*(pdf[c].tolist() for c in self.row_schema.names)):
                arrived.setdefault(row[0] // 1000 // self.bucket_ms, []).append(row)
        for bucket, more in arrived.items():
            self.waiting.updateValue((bucket,), (self._held(bucket) + more,))
            self.handle.registerTimer(max(row[0] for row in more) // 1000)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, watermark = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        watermark = max(now, watermark)
        bucket = now // self.bucket_ms
        done, state = None, dict(self.machine.initial)
        if self.state.exists():
            done, held = self.state.get()
            state = json.loads(held)
        rows, out = self._held(bucket), []
        # everything up to the watermark has arrived, so one firing takes all of the bucket that it has passed
        now = max(now, min((bucket + 1) * self.bucket_ms - 1, watermark))
        due = sorted(row for row in rows if row[0] // 1000 <= now)
        left = [row for row in rows if row[0] // 1000 > now]
        if due:
            if done is not None and due[0][0] // 1000 <= done:
                raise RuntimeError(f"rows of key {key[0]} at {due[0][0]} are due after {done}")
            for row in due:
                out += self.machine.run(state, row)
            if left:
                self.waiting.updateValue((bucket,), (left,))
            else:
                self.waiting.removeKey((bucket,))
        done = now if done is None else max(done, now)
        out += self.machine.tick(state, done * 1000)
        while (wake := self.machine.deadline(state)) is not None:
            at = -(-wake // 1000)
            if at > watermark:
                self.handle.registerTimer(at)
                break
            # met at once, unless rows wait before it, whose own timers come first
            buckets = range(done // self.bucket_ms, at // self.bucket_ms + 1)
            if any(row[0] // 1000 <= at for b in buckets for row in (left if b == bucket else self._held(b))):
                break
            done = max(done, at)
            out += self.machine.tick(state, at * 1000)
        self.state.update((done, json.dumps(state)))
        if out:
            yield self._frame(key[0], out)

    def _frame(self, key: Any, out: Rows) -> pd.DataFrame:
        pdf = pd.DataFrame(out, columns=self.out_columns)
        pdf.insert(0, self.key, key)
        return pdf

    def close(self) -> None:
        pass


class PackedProcessor(OrderedProcessor):
    """The same with the rows of a firing as JSON, ``PACKED_ROWS`` to a row: short frames cost Spark a conversion per column."""

    def _frame(self, key: Any, out: Rows) -> pd.DataFrame:
        parts = [out[i : i + PACKED_ROWS] for i in range(0, len(out), PACKED_ROWS)]
        texts = [json.dumps([dict(zip(self.out_columns, row)) for row in part]) for part in parts]
        return pd.DataFrame({self.key: [key] * len(texts), PACKED: texts})


def run_stream(events: DataFrame, machine: Machine, key: str, watermark: str = "0 seconds", ts: str = "ts", bucket_ms: int = 1000) -> DataFrame:
    """Apply a machine to a stream with a timestamp column ``ts``.

    Rows of a key wait in state and are read ``bucket_ms`` of event time at a time; those of a bucket
    should be few, and a bucket should not be much shorter than the time between rows.
    """
    rows = events.select(key, ts, *machine.columns).withWatermark(ts, watermark)
    schema = StructType([f for f in rows.schema if f.name in machine.columns])
    schema = StructType([schema[c] for c in machine.columns])
    kind = dict(rows.dtypes)[key]
    names = [c.split()[0] for c in machine.output.split(", ")]
    packed = rows.groupBy(key).transformWithStateInPandas(
        statefulProcessor=PackedProcessor(machine, key, schema, names, bucket_ms),
        outputStructType=f"{key} {kind}, {PACKED} string", outputMode="Append", timeMode="EventTime",
    )
    # a value that does not fit its type is an error, and a text may have any length
    fields = ", ".join(f"{n}: {c.split()[1]}" for n, c in zip(names, machine.output.split(", ")))
    found = F.from_json(PACKED, f"array<struct<{fields}>>", {"mode": "FAILFAST", "maxStringLen": str((1 << 31) - 1)})
    return packed.select(key, F.inline(found))


def fold_sorted(events: DataFrame, machine: Machine, keys: Sequence[str], until: int | None = None) -> DataFrame:
    """Apply a machine to a table, the keys' rows in time order.

    Partitions are sorted by Spark and stream through Arrow batches; the fold keeps one state, not
    a group. ``until`` is the time up to which the last rows of a key are known to be complete.
    """
    keys = list(keys)
    kinds = dict(events.dtypes)
    names = [c.split()[0] for c in machine.output.split(", ")]
    rows = events.select(*keys, *machine.columns).repartition(*keys).sortWithinPartitions(*keys, *machine.columns[:2])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, {}
        for pdf in batches:
            out: Rows = []
            for rec in pdf.itertuples(index=False, name=None):
                k, row = rec[: len(keys)], rec[len(keys):]
                if k != current:
                    if current is not None and until is not None:
                        out += [current + o for o in machine.tick(state, until)]
                    current, state = k, dict(machine.initial)
                out += [k + o for o in machine.run(state, row)]
            if out:
                yield pd.DataFrame(out, columns=[*keys, *names])
        if current is not None and until is not None:
            last = [current + o for o in machine.tick(state, until)]
            if last:
                yield pd.DataFrame(last, columns=[*keys, *names])

    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + [machine.output])
    return rows.mapInPandas(fold, schema)


def latest_time(events: DataFrame, col: str = "ts_us") -> int:
    return events.agg(F.max(col)).first()[0]
