"""Rules that depend on what they decided before: limits on admissions, lock-outs, suppressed replays.

A rule keeps the times that still matter for a key. In the batch form a key is cut wherever nothing happened for as long as
the rule looks back: there the state is empty, or starts anew, so what lies between two cuts is decided by itself and one
hot key is many tasks' work. Only a run without such a gap is walked in order. Gaps are found on a small table of the first and
last time of each slot of a key. The streaming forms keep the times as state, with grouped state or with typed list state, and
are tested against the batch form.

Defined results: rows of one time go by id; a null key is a key; ``t`` is not null. On a stream, rows later than the
watermark allows take no part, nor do rows before 1970.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

LATE = "10 minutes"
SHIFT = 1.0  # seconds added to times, because a stream's watermark starts at 0 and shuts out the rows at it
State = list[float]
DECIDED = "key string, id long, t double, flag boolean, admitted boolean"


@dataclass(frozen=True)
class Rule:
    """``step``: the state and the answer after a row; ``seconds``: how far back the state can matter."""

    seconds: float
    step: Callable[[State, float, bool], tuple[State, bool]]


def sliding_limit(limit: int = 30, seconds: float = 60.0) -> Rule:
    """Admit if fewer than ``limit`` were admitted in the last ``seconds``; refusals do not count."""

    def step(state: State, t: float, flag: bool) -> tuple[State, bool]:
        state = [x for x in state if x > t - seconds]
        admitted = len(state) < limit
        return ([*state, t] if admitted else state), admitted

    return Rule(seconds, step)


def lockout(limit: int = 10, seconds: float = 900.0) -> Rule:
    """A try is let through while fewer than ``limit`` failures lie in the window; locked tries count, a success clears."""

    def step(state: State, t: float, success: bool) -> tuple[State, bool]:
        state = [x for x in state if x > t - seconds][-limit:]
        open_ = len(state) < limit
        return ([] if open_ and success else [*state, t]), open_

    return Rule(seconds, step)


def replay_window(seconds: float = 900.0) -> Rule:
    """The first sighting of a key passes; repeats in the window after it do not, and do not extend it."""

    def step(state: State, t: float, flag: bool) -> tuple[State, bool]:
        passes = not state or t - state[0] >= seconds
        return ([t] if passes else state), passes

    return Rule(seconds, step)


def walk(pdf: pd.DataFrame, rule: Rule, state: State) -> tuple[pd.DataFrame, State]:
    pdf = pdf.sort_values(["t", "id"], kind="stable")
    out = []
    for t, flag in zip(pdf["t"].tolist(), pdf["flag"].tolist(), strict=True):
        state, passes = rule.step(state, float(t), bool(flag))
        out.append(passes)
    return pdf.assign(admitted=out), state


def stretches(events: DataFrame, seconds: float) -> DataFrame:
    """``events`` with ``stretch``: 0, 1, ... of a key, parted wherever no row came for ``seconds`` or more.

    A gap so long leaves the slots on its two sides apart, and rows of one slot are never parted, so the table of slots
    (one row for each that a key uses, whatever the rows in it) tells all cuts.
    """
    spot = F.floor(F.col("t") / seconds)
    slots = events.groupBy(F.struct("key").alias("_k"), spot.alias("_slot")).agg(F.min("t").alias("_low"), F.max("t").alias("_high"))
    order = Window.partitionBy("_k").orderBy("_slot")
    cut = F.coalesce((F.col("_low") - F.lag("_high").over(order) >= seconds).cast("long"), F.lit(0))
    found = slots.withColumn("_cut", cut).select("_k", "_slot", F.sum("_cut").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("stretch"))
    return events.withColumns({"_k": F.struct("key"), "_slot": spot}).join(found, ["_k", "_slot"]).select(*events.columns, "stretch")


def _walked(events: DataFrame, rule: Rule, schema: str, last: bool = False) -> DataFrame:
    """Walks each stretch in order, row by row as they stream in sorted: each row with its decision, or (``last``) the end of each slice
    of a stretch with the state there.

    Batches become plain lists once, so a short stretch costs no more than its rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, []
        for batch in batches:
            keys, stretch, times, flags = (batch.column(c).to_pylist() for c in ("key", "stretch", "t", "flag"))
            admitted, ends, states = [], [], []
            for k, own in enumerate(zip(keys, stretch, strict=True)):
                if own != current:
                    if last and k:
                        ends.append(k - 1)
                        states.append(state)
                    current, state = own, []
                state, passes = rule.step(state, times[k], bool(flags[k]))
                admitted.append(passes)
            if last and len(batch):
                at = pa.array([*ends, len(batch) - 1], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in ("key", "t", "id")] + [pa.array([*states, state], pa.list_(pa.float64()))], names=["key", "at", "id", "times"])
            elif not last:
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("key", "id", "t", "flag")] + [pa.array(admitted, pa.bool_())], names=["key", "id", "t", "flag", "admitted"])

    ordered = stretches(events.select("key", "id", "t", "flag"), rule.seconds).repartition("key", "stretch").sortWithinPartitions("key", "stretch", "t", "id")
    return ordered.mapInArrow(run, schema)


def decide_batch(events: DataFrame, rule: Rule) -> DataFrame:
    """Add ``admitted``. Input: key string, id long, t double (epoch seconds), flag boolean."""
    return _walked(events, rule, DECIDED)


def states_after(events: DataFrame, rule: Rule) -> DataFrame:
    """(key, t): the times that are the state of each key after these rows, to start a stream from."""
    slices = _walked(events, rule, "key string, at double, id long, times array<double>", last=True)
    newest = slices.groupBy("key").agg(F.max_by("times", F.struct("at", "id")).alias("times"))
    return newest.select("key", F.explode("times").alias("t"))


def decide_stream(events: DataFrame, rule: Rule, late: str = LATE) -> DataFrame:
    """The same decision on a stream, by grouped state.

    A key's state goes once the watermark is past the last time at which it matters.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        done, kept = walk(pd.concat(list(batches)), rule, kept)
        state.update((kept,))
        last = max(kept, default=0.0) + rule.seconds + SHIFT
        state.setTimeoutTimestamp(max(int(last * 1000), state.getCurrentWatermarkMs()) + 1)
        yield done[["key", "id", "t", "flag", "admitted"]]

    return _timed(events, late).groupBy("key").applyInPandasWithState(run, DECIDED, "times array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def _timed(events: DataFrame, late: str) -> DataFrame:
    return events.withColumn("_at", F.timestamp_seconds(F.col("t") + SHIFT)).withWatermark("_at", late)


class Keeper(StatefulProcessor):
    """Keeps a rule's times for each key as a typed list.

    In event time a timer clears them once they cannot matter; in processing time the store drops them ``ttl`` seconds
    after they were written.
    """

    def __init__(self, rule: Rule, ttl: float | None = None) -> None:
        self.rule, self.ttl = rule, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "t double", None if self.ttl is None else int(self.ttl * 1000))

    def _store(self, kept: State) -> None:
        if kept:
            self.times.put([(t,) for t in kept])
        elif self.times.exists():
            self.times.clear()

    def _remind(self, kept: State) -> None:
        if self.ttl is None and kept:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(int((max(kept) + self.rule.seconds + SHIFT) * 1000) + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept = sorted(t for (t,) in self.times.get()) if self.times.exists() else []
        done, kept = walk(pd.concat(list(rows)), self.rule, kept)
        self._store(kept)
        self._remind(kept)
        yield done[["key", "id", "t", "flag", "admitted"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.times.clear()
        yield pd.DataFrame({"key": pd.Series(dtype=str), "id": pd.Series(dtype="int64"), "t": pd.Series(dtype="float64"), "flag": pd.Series(dtype=bool), "admitted": pd.Series(dtype=bool)})

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        kept = sorted(initialState["t"].tolist())
        self._store(kept)
        self._remind(kept)

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """Typed state needs the store that keeps state off the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def decide_with_state(events: DataFrame, rule: Rule, late: str = LATE, start: DataFrame | None = None, ttl: float | None = None) -> DataFrame:
    """The same decision by typed list state with timers, or with ``ttl`` seconds in processing time.

    ``start``: (key, t) from ``states_after``, the state that keys begin with.
    """
    grouped = (_timed(events, late) if ttl is None else events).groupBy("key")
    begin = None if start is None else start.groupBy("key")
    return grouped.transformWithStateInPandas(Keeper(rule, ttl), DECIDED, "Append", "EventTime" if ttl is None else "ProcessingTime", begin)
