"""Streams whose rows come late and out of order, folded key by key in the order of their time.

A key's rows wait in a list until the watermark has passed them, as no earlier row can come then; timers in event time wake
the keys, a group at a time. What is kept of a key is thus bounded by how late rows may be and by what happens within that, not by how long the
key lives; a key that is silent for long enough is ended by the watermark, without a row of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def streaming_session(spark: SparkSession) -> SparkSession:
    """A session of its own, for streams with timers: they need a state store that keeps lists; other streams keep theirs."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return own


def plain(value: Any) -> Any:
    if isinstance(value, np.ndarray):
        return [plain(x) for x in value]
    if value is None or value is pd.NA or (isinstance(value, float | np.floating) and np.isnan(value)):
        return None
    return value.item() if isinstance(value, np.generic) else value


#: Keys are dealt into so many groups, each of which has its state and its timer: a call for each key would cost more than its rows.
GROUPS = 1024


def packed(columns: list[list]) -> bytes:
    """Columns of plain values as one value of a state, and as rows again."""
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [f"c{k}" for k in range(len(columns))])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(value: bytes) -> Iterator[tuple]:
    return zip(*[c.to_pylist() for c in pa.ipc.open_stream(value).read_all().columns], strict=True)


class InOrder(StatefulProcessor):
    """A fold: `step(state, row)` gives the next state (None: the key is done with) and a row or None; `end(state, at)` a key's last row or None.

    A row is a tuple (at, ...) of microseconds and what else is waiting for it; rows of one time are ordered by the rest. What
    is called is a group of keys: each key has its state in a map, and rows wait in one list. They come to it by way of another,
    in which a batch's rows are one value until the group wakes, as most of them then wait no longer.
    """

    def __init__(self, columns: list[str], whole: list[bool], key: str, waiting: str, state: str, out: list[tuple[str, str]], step: Callable, end: Callable | None = None, idle: int | None = None):
        self.columns, self.whole, self.key_type, self.waiting_schema, self.state_schema, self.out, self.step, self.end, self.idle = columns, whole, key, waiting, state, out, step, end, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.come = handle.getListState("come", "rows binary")
        self.waiting = handle.getListState("waiting", f"key {self.key_type}, at long, {self.waiting_schema}")
        self.state = handle.getMapState("state", f"key {self.key_type}", f"seen long, {self.state_schema}")
        self.timer = handle.getValueState("timer", "at long")

    def wake(self, micros: int) -> None:
        """A timer for when the watermark has reached a time; a group has one, the earliest that it needs."""
        at, now = -(-micros // 1000), self.timer.get()
        if now is not None:
            if now[0] <= at:
                return
            self.handle.deleteTimer(now[0])
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        first = None
        for pdf in rows:
            values = [[int(v) if whole and v is not None else plain(v) for v in pdf[c].tolist()] for c, whole in zip(self.columns, self.whole, strict=True)]
            self.come.appendValue((packed(values),))
            first = min(values[1] + ([] if first is None else [first]))
        if first is not None:
            self.wake(first)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # A timer that has fired is gone; the one that is noted may be a later one only if it has been replaced.
        now = timerValues.getCurrentWatermarkInMs() * 1000
        self.timer.clear()
        due, left = {}, []
        come = [row for chunk in self.come.get() for row in unpacked(chunk[0])]
        for own, *row in chain(self.waiting.get(), come):
            due.setdefault(own, []).append(row) if row[0] <= now else left.append((own, *row))
        if due or come:
            self.come.clear()
            self.waiting.put(left) if left else self.waiting.clear()
        held = {own[0]: (value[0], tuple(value[1:])) for own, value in self.state.iterator()}
        told, following = [], [row[1] for row in left]
        for own in {**held, **due}:
            seen, state = before = held.get(own, (None, None))
            out = []
            for row in sorted(due.get(own, ()), key=lambda r: [(x is not None, x) for x in r]):
                if state is not None and self.idle is not None and row[0] > seen + self.idle:
                    out.append(self.end(state, seen + self.idle) if self.end else None)
                    state = None
                state, said = self.step(state, tuple(row))
                out.append(said)
                seen = row[0]
            if state is not None and self.idle is not None and seen + self.idle <= now:
                out.append(self.end(state, seen + self.idle) if self.end else None)
                state = None
            if state is None:
                if own in held:
                    self.state.removeKey((own,))
            else:
                if (seen, state) != before:
                    self.state.updateValue((own,), (seen, *state))
                if self.idle is not None:
                    following.append(seen + self.idle)
            told += [(own, *r) for r in out if r is not None]
        if following:
            self.wake(min(following))
        if told:
            yield pd.DataFrame(told, columns=["key", *[c for c, _ in self.out]]).astype({c: kind for c, kind in self.out if kind == "Int64"})

    def close(self) -> None:
        pass


def in_order(rows: DataFrame, key: str, ts: str, late: str, waiting: dict[str, str], state: str, out: dict[str, str], step: Callable, end: Callable | None = None, idle: int | None = None) -> DataFrame:
    """A stream's rows folded in the order of `ts`, for each key: (key, out...).

    waiting: the columns that a step needs, with their types; out: the columns that steps and ends give; `late`: how far
    behind the newest row one may come and still count; `idle`: microseconds after which a silent key ends. Rows without a
    key or a time are left out. The stream must belong to a `streaming_session`.
    """
    marked = rows.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withWatermark(ts, late)
    taken = marked.select(F.pmod(F.xxhash64(key), F.lit(GROUPS)).alias("_group"), F.col(key).alias("key"), F.col(ts).alias("ts"), F.unix_micros(ts).alias("at"), *[F.col(c).cast("string" if kind == "long" else kind).alias(f"w{k}") for k, (c, kind) in enumerate(waiting.items())])
    # Whole numbers travel as digits: beside a null, pandas would make them doubles.
    whole = [False, True, *[kind == "long" for kind in waiting.values()]]
    kinds = [(c, "Int64" if kind in ("long", "bigint") else "object") for c, kind in out.items()]
    key_type = rows.schema[key].dataType.simpleString()
    fold = InOrder(["key", "at", *[f"w{k}" for k in range(len(waiting))]], whole, key_type, ", ".join(f"w{k} {kind}" for k, kind in enumerate(waiting.values())), state, kinds, step, end, idle)
    schema = f"key {key_type}, " + ", ".join(f"{c} {kind}" for c, kind in out.items())
    return taken.groupBy("_group").transformWithStateInPandas(fold, schema, "append", "eventTime")


def presence(beats: DataFrame, node: str, ts: str, every: int, misses: int, late: str) -> DataFrame:
    """Nodes that fell silent: (key, joined, last_seen, dropped, beats), times in microseconds.

    A node is dropped once it has missed `misses` pings in a row, `every` microseconds apart, by the time of the others' beats;
    it needs no further row of its own. One that comes back has joined anew.
    """
    end = lambda state, at: (state[0], state[1], at, state[2])
    step = lambda state, row: ((row[0], row[0], 1) if state is None else (state[0], row[0], state[2] + 1), None)
    out = {"joined": "long", "last_seen": "long", "dropped": "long", "beats": "long"}
    return in_order(beats.withColumn("_beat", F.lit(1)), node, ts, late, {"_beat": "long"}, "joined long, last long, beats long", out, step, end, every * misses)
