"""Frame states on a timeline: latest state, histograms by pixel column, generations, read-through of a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_state(log: DataFrame, key: list[str], state: str, seq: str) -> DataFrame:
    """key, state: the last transition of each frame."""
    return log.groupBy(*key).agg(F.max_by(state, seq).alias(state))


def state_columns(states: DataFrame, frame: str, state: str, n: int, width: int, absent: str | None = None) -> DataFrame:
    """cx, state, share, any_absent: shares of states among the frames of each pixel column.

    Column cx shows frames cx*n//width to max(that + 1, (cx+1)*n//width) - 1. Each frame names its columns itself, so
    there is no range join: with fewer columns than frames one or two candidates, else the columns it spans.
    """
    f, w = F.col(frame), F.lit(width)
    low, high = F.floor(f * w / n).cast("int") - 1, F.floor((f + 1) * w / n).cast("int") + 1
    cand = states.where((f >= 0) & (f < n)).withColumn("cx", F.explode(F.sequence(F.greatest(F.lit(0), low), F.least(w - 1, high))))
    lo = F.expr(f"cast(cx as bigint) * {n} div {width}")
    hi = F.greatest(lo + 1, F.expr(f"(cast(cx as bigint) + 1) * {n} div {width}"))
    rows = cand.where((f >= lo) & (f < hi))
    flag = F.lit(False) if absent is None else F.coalesce(F.col(absent), F.lit(False))
    counts = rows.groupBy("cx", state).agg(F.count("*").alias("c"), F.bool_or(flag).alias("a"))
    total = counts.groupBy("cx").agg(F.sum("c").alias("t"), F.bool_or("a").alias("any_absent"))
    return counts.join(total, "cx").select("cx", state, (F.col("c").cast("double") / F.col("t")).alias("share"), "any_absent")


def range_transitions(changes: DataFrame, start: str = "start", end: str = "end", frame: str = "frame") -> DataFrame:
    """Changes of ranges (end excluded) as one change for each frame."""
    return changes.where(F.col(start) < F.col(end)).withColumn(frame, F.explode(F.sequence(F.col(start), F.col(end) - 1))).drop(start, end)


def current_generation(results: DataFrame, control: DataFrame) -> DataFrame:
    """Results of the current generation, the largest that the control table names."""
    return results.join(F.broadcast(control.agg(F.max("generation").alias("generation"))), "generation")


def read_through(wanted: DataFrame, memory: DataFrame, disk: DataFrame, tombstones: DataFrame, frame: str, payload: str) -> DataFrame:
    """`wanted` with the payload and where it came from: a tombstone is a miss, then memory, then disk."""
    m = memory.select(frame, F.col(payload).alias("_m"))
    d = disk.select(frame, F.col(payload).alias("_d"))
    t = tombstones.select(frame, F.lit(True).alias("_t")).distinct()
    j = wanted.join(t, frame, "left").join(m, frame, "left").join(d, frame, "left")
    gone = F.col("_t").isNotNull()
    return j.withColumn(payload, F.when(~gone, F.coalesce("_m", "_d"))).withColumn(
        "origin", F.when(gone, "miss").when(F.col("_m").isNotNull(), "memory").when(F.col("_d").isNotNull(), "disk").otherwise("miss")).drop("_t", "_m", "_d")


def upsert(store: DataFrame, puts: DataFrame, frame: str, seq: str) -> DataFrame:
    """The store after puts: the newest row of each frame by sequence. Marks are no part of it: see `cleared`."""
    both = store.unionByName(puts)
    rest = [c for c in both.columns if c != frame]
    return both.groupBy(frame).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(frame, *[f"r.{c}" for c in rest])


def cleared(marks: DataFrame, puts: DataFrame, frame: str, seq: str) -> DataFrame:
    """Marks of invalid frames that no later put took back."""
    last = puts.groupBy(frame).agg(F.max(seq).alias("_put"))
    return marks.join(last, frame, "left").where(F.col("_put").isNull() | (F.col("_put") < F.col(seq))).drop("_put")


def invalidate(store: DataFrame, frame: str, at: int | None = None, start: int | None = None, before: int | None = None) -> DataFrame:
    """The store without one frame, without all from a frame on, without all before one, or (none given) empty."""
    if at is not None:
        return store.where(F.col(frame) != at)
    if before is not None:
        return store.where(F.col(frame) >= before)
    return store.where(F.col(frame) < start) if start is not None else store.limit(0)


def buffer_metrics(ticks: DataFrame, key: list[str], hit: str, target: str, completed: str, displayed: str) -> DataFrame:
    """key, hit_ratio, frame_lag, display_lag at the last tick, lags never below 0."""
    last = lambda c: F.max_by(c, target)
    return ticks.groupBy(*key).agg(
        F.coalesce(F.try_divide(F.count_if(F.col(hit)), F.count("*")), F.lit(0.0)).alias("hit_ratio"),
        F.greatest(F.lit(0), F.max(target) - last(completed)).alias("frame_lag"), F.greatest(F.lit(0), F.max(target) - last(displayed)).alias("display_lag"))
