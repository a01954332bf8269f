"""Frame-skip policies and live-loop rules as replays over ordered tick tables, and as stateful streaming operators.

Each policy folds the ticks of one session in order; sessions run in parallel. The same folds serve a batch replay
(a sorted stream of rows) and a stream (applyInPandasWithState), where the state is a small tuple per session.
"""

from __future__ import annotations

import math
from collections import deque, namedtuple
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..functions import scalars as S
from ..plans.groups import folded

TICK = ["seq", "target", "last_submitted", "last_completed", "read_latency_ms", "process_fps", "workers", "outstanding"]
Tick = namedtuple("Tick", TICK)
#: (reading in sequence, least lag since that began, given up, anything completed yet): how a session starts.
START = (False, 0, False, False)
#: How a session reads: at the present frame, in sequence, or at the present frame after sequence brought nothing.
PRESENT, SEQUENCE, GIVEN_UP = (False, False), (True, False), (False, True)
#: What ends each way of reading, the first that holds, and the way that follows.
CHANGES = {
    PRESENT: (("behind on slow reads", SEQUENCE),),
    SEQUENCE: (("caught up", PRESENT), ("falling further behind", GIVEN_UP)),
    GIVEN_UP: (("caught up", PRESENT),),
}


def _after(state: tuple, t, max_lag: int, recover_lag: int, slow_ms: float) -> tuple:
    """A session's state once a tick's lag is known. All limits but `recover_lag` must be passed to count."""
    sequence, least, given_up, ever = state
    lag = t.target - t.last_completed
    least = min(least, lag) if sequence else lag
    holds = {
        "caught up": lag <= recover_lag,
        "behind on slow reads": lag > max_lag and (t.read_latency_ms or 0) > slow_ms,
        "falling further behind": lag > least + max_lag,
    }
    way = (sequence, given_up)
    sequence, given_up = next((then for what, then in CHANGES[way] if holds[what]), way)
    return sequence, least, given_up, ever


def _full(t, factor: int) -> bool:
    return t.outstanding >= max(1, t.workers) * factor


def _known(rate) -> bool:
    return rate is not None and rate > 0


def _policy(lead: Callable, full: Callable, max_lag: int, recover_lag: int | None, ahead: int, slow_ms: float) -> Callable:
    """decide(state, tick) -> (state, frame or None): idle while `full`, in order until anything is done, then by the
    session's way of reading; `lead(tick)` frames are added to the present one, and none is taken over `ahead` of it."""
    low = min(max_lag // 2 if recover_lag is None else recover_lag, max_lag)

    def decide(state: tuple, t) -> tuple[tuple, int | None]:
        state = (*state[:3], state[3] or t.last_completed >= 0)
        following = t.last_submitted + 1
        if full(t):
            return state, None
        if not state[3]:
            return (False, *state[1:]), following
        state = _after(state, t, max_lag, low, slow_ms)
        if state[0]:
            return state, following
        frame = max(following, t.target + lead(t))
        return state, frame if frame <= t.target + ahead else None

    return decide


def synced(max_lag: int = 60, recover_lag: int | None = None, ahead: int = 120, slow_ms: float = 50.0) -> Callable:
    """Skip to the present frame, sequential while reads can't follow; None once the look-ahead is full."""
    return _policy(lambda t: 0, lambda t: False, max_lag, recover_lag, ahead, slow_ms)


def predictive(max_lag: int = 60, recover_lag: int | None = None, ahead: int = 120, slow_ms: float = 50.0, factor: int = 2, fps: float = 30.0, max_lead_seconds: float | None = None) -> Callable:
    """As `synced`, but idle while enough is in flight, and aimed at the frame that is due when this one is done."""
    bound = ahead if max_lead_seconds is None else min(ahead, int(max_lead_seconds * fps))

    def lead(t) -> int:
        passed = math.ceil(max(1, t.workers) * factor * fps / t.process_fps) if _known(t.process_fps) else 0
        return max(0, min(passed, bound))

    return _policy(lead, lambda t: _full(t, factor), max_lag, recover_lag, ahead, slow_ms)


def buffering(ahead: int = 600, factor: int = 2, fps: float = 30.0) -> Callable:
    """A ladder of every k-th frame ahead of a frozen target, k being what processing can keep up with."""

    def decide(state: tuple, t) -> tuple[tuple, int | None]:
        step = max(1, math.ceil(fps / t.process_fps)) if _known(t.process_fps) and fps > 0 else 1
        frame = t.last_submitted + step
        return state, None if _full(t, factor) or frame > t.target + ahead else frame

    return decide


def buffering_frame(ahead: int = 600, factor: int = 2, fps: float = 30.0) -> Column:
    """`buffering` as a column of a tick table: it needs no state."""
    frame = F.col("last_submitted") + S.stride(F.lit(fps), F.coalesce("process_fps", F.lit(0.0)))
    full = F.col("outstanding") >= F.greatest(F.lit(1), F.col("workers")) * factor
    return F.when(~full & (frame <= F.col("target") + ahead), frame).cast("long")


def best_effort() -> Callable:
    return lambda state, t: (state, t.last_submitted + 1)


def replay(ticks: DataFrame, key: str, decide: Callable) -> DataFrame:
    """key, seq, next_frame, mode of each tick of each session; a session's state is all that a task keeps of it."""

    def step(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        state, frame = decide(state, Tick._make(row))
        return state, [(row[0], frame, "lagging" if state[0] else "normal")]

    return folded(ticks.select(key, *TICK), [key], ["seq"], lambda: START, step, "seq long, next_frame long, mode string")


def replay_stream(ticks: DataFrame, key: str, decide: Callable) -> DataFrame:
    """`replay` over a stream of ticks; each micro-batch's ticks of a session are put in order first."""
    schema = f"{key} {ticks.schema[key].dataType.simpleString()}, seq long, next_frame long, mode string"

    def run(k: tuple, parts: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        x = pd.concat(list(parts)).sort_values("seq")
        state = tuple(held.get) if held.exists else START
        frames, modes = [], []
        for t in x.itertuples(index=False):
            state, frame = decide(state, t)
            frames.append(frame), modes.append("lagging" if state[0] else "normal")
        held.update(state)
        yield pd.DataFrame({key: k[0], "seq": x["seq"], "next_frame": pd.array(frames, "Int64"), "mode": modes})

    return ticks.select(key, *TICK).groupBy(key).applyInPandasWithState(
        run, schema, "back boolean, best long, given_up boolean, ever boolean", "append", "NoTimeout")


def latest_wins(done: DataFrame, key: str, order: str, seq: str, generation: str) -> DataFrame:
    """Results in order of completion that are newer than all shown before them, by generation, then sequence."""
    at = F.struct(generation, seq)
    top = F.max(at).over(W.partitionBy(key).orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    return done.withColumn("_top", top).where(F.col("_top").isNull() | (at > F.col("_top"))).drop("_top")


def latest_wins_stream(done: DataFrame, key: str, order: str, seq: str, generation: str) -> DataFrame:
    """`latest_wins` over a stream: the state of a key is the generation and sequence of what was shown last."""
    kinds = {c: done.schema[c].dataType.simpleString() for c in (key, order, seq, generation)}
    schema = ", ".join(f"{c} {k}" for c, k in kinds.items())

    def run(k: tuple, parts: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        x = pd.concat(list(parts)).sort_values(order)
        top, keep = tuple(held.get) if held.exists else (-(2**63), -(2**63)), []
        for at in zip(x[generation].tolist(), x[seq].tolist()):
            keep.append(at > top)
            top = max(top, at)
        held.update(top)
        out = x[keep]
        yield pd.DataFrame({key: k[0], order: out[order], seq: out[seq], generation: out[generation]})

    return done.select(*kinds).groupBy(key).applyInPandasWithState(run, schema, "generation long, seq long", "append", "NoTimeout")


def drop_oldest(events: DataFrame, key: str, seq: str, op: str, item: str, capacity: int) -> DataFrame:
    """key, seq, item, fate of every put into a bounded queue: taken, dropped (the oldest gives way) or waiting."""

    def step(queue: deque, row: tuple) -> tuple[deque, list[tuple]]:
        at, what, thing = row
        if what == "put":
            out = [(*queue.popleft(), "dropped")] if len(queue) == capacity else []
            queue.append((at, thing))
            return queue, out
        return queue, [(*queue.popleft(), "taken")] if queue else []

    return folded(events.select(key, seq, op, item), [key], [seq], deque, step, f"{seq} long, {item} long, fate string",
                  lambda queue: [(*x, "waiting") for x in queue])


def drop_newest(events: DataFrame, key: str, seq: str, op: str, capacity: int) -> DataFrame:
    """key, accepted, dropped, written of a bounded writer: a put while full is dropped."""

    def step(state: tuple, row: tuple) -> tuple[tuple, list]:
        waiting, accepted, dropped, written = state
        if row[1] != "put":
            return (waiting - 1, accepted, dropped, written + 1) if waiting else state, []
        if waiting >= capacity:
            return (waiting, accepted, dropped + 1, written), []
        return (waiting + 1, accepted + 1, dropped, written), []

    return folded(events.select(key, seq, op), [key], [seq], lambda: (0, 0, 0, 0), step, "accepted long, dropped long, written long", lambda s: [s[1:]])


def throttle(events: DataFrame, key: str, micros: str, seconds: float) -> DataFrame:
    """key, time of events that are passed on: the first, then each that lies the seconds or more after the last passed."""
    least = round(seconds * 1e6)

    def step(last: int | None, row: tuple) -> tuple[int, list[tuple]]:
        return (row[0], [row]) if last is None or row[0] >= last + least else (last, [])

    return folded(events.select(key, micros), [key], [micros], lambda: None, step, f"{micros} long")


class _Throttle(StatefulProcessor):
    """The time of what was passed on last, kept until nothing that may still come depends on it."""

    def __init__(self, time: str, least: int):
        self.time, self.least = time, least

    def init(self, handle) -> None:
        self.handle, self.last = handle, handle.getValueState("last", "us long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        x = pd.concat(list(rows)).sort_values(self.time)
        last, keep = self.last.get()[0] if self.last.exists() else None, []
        for us in (x[self.time].astype("int64") // (1000 if x[self.time].dtype.str.endswith("ns]") else 1)).tolist():
            keep.append(last is None or us >= last + self.least)
            last = us if keep[-1] else last
        self.last.update((last,))
        for t in self.handle.listTimers():
            self.handle.deleteTimer(t)
        self.handle.registerTimer(-(-(last + self.least) // 1000))
        yield x[keep]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        self.last.clear()  # whatever comes now lies far enough behind
        return iter([])

    def close(self) -> None:
        pass


def throttle_stream(events: DataFrame, key: str, time: str, seconds: float, late: str = "0 seconds") -> DataFrame:
    """`throttle` over a stream by its event time: the events (key, time) that are passed on.

    Events of a micro-batch are put in order first; those more than `late` behind the newest are dropped by Spark. A key's
    state goes by a timer once no event that may still come depends on it, so that only recent keys have any.
    """
    store = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", store)
    e = events.select(key, time).withWatermark(time, late)
    schema = f"{key} {e.schema[key].dataType.simpleString()}, {time} timestamp"
    return e.groupBy(key).transformWithStateInPandas(_Throttle(time, round(seconds * 1e6)), schema, "append", "eventTime")


def pace(elapsed: Column, fps: Column) -> Column:
    """Seconds to wait so that a loop makes no more than `fps` rounds a second; none without a rate."""
    return F.when(fps > 0, F.greatest(F.lit(0.0), 1 / F.nullif(fps, F.lit(0.0)) - elapsed)).otherwise(0.0)


def newest_per_batch(stream: DataFrame, key: str, order: str, show: Callable[[DataFrame], None]):
    """A writer that hands the newest row of each key of a micro-batch to `show`."""

    def each(batch: DataFrame, _: int) -> None:
        rest = [c for c in batch.columns if c != key]
        show(batch.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, *[f"r.{c}" for c in rest]))

    return stream.writeStream.foreachBatch(each)
