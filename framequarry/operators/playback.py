"""Playback over tables of ticks: clocks, what is shown, what is submitted within a selection, when buffering ends."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..plans.groups import folded
from ..plans.prefix import numbered
from . import sections as X

#: Frames ahead before rates are trusted, and the seconds that sparse playback holds in hand (fixed values).
WARMUP_FRAMES, CUSHION_SECONDS = 3, 2.5


def timeline(log: DataFrame, key: str, fps: float, last: int | None = None, micros: str = "us", op: str = "op", frame: str = "frame") -> DataFrame:
    """key, us, current, elapsed of each `tick` of a log of start, pause, seek and tick.

    start plays from a frame, pause keeps the frame reached, seek goes on from another; none passes the last frame.
    """

    def now(state: tuple, us: int) -> int:
        anchor, since, playing = state
        at = anchor + int((us - since) / 1e6 * fps) if playing else anchor
        return at if last is None else min(at, last)

    def step(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        us, what, to = row
        if what == "start":
            return (to, us, True), []
        if what == "seek":
            return (to, us, state[2]), []
        if what == "pause":
            return ((now(state, us), state[1], False) if state[2] else state), []
        return state, [(us, now(state, us), (us - state[1]) / 1e6 if state[2] else 0.0)]

    return folded(log.select(key, micros, op, frame), [key], [micros], lambda: (0, 0, False), step, f"{micros} long, current long, elapsed double")


def ticks_shown(ticks: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """key, seq, shown of the ticks (target, hit, fallback, paused, seek) that put another frame on the display.

    A hit shows its target. Otherwise, unless paused, the fallback is shown if it is no earlier than what is on the
    display. The same frame isn't shown twice running; a seek forgets what was shown.
    """

    def step(shown: int | None, row: tuple) -> tuple[int | None, list[tuple]]:
        at, target, hit, fallback, paused, seek = row
        shown = None if seek else shown
        new = target if hit else None
        if not hit and not paused and fallback is not None and (shown is None or fallback >= shown):
            new = fallback
        return (new, [(at, new)]) if new is not None and new != shown else (shown, [])

    columns = ["target", "hit", "fallback", "paused", "seek"]
    return folded(ticks.select(key, seq, *columns), [key], [seq], lambda: None, step, f"{seq} long, shown long")


def submission(ranges: Column, current: Column, decided: Column, last_frame: Column, submitted: Column, completed: Column, in_flight: Column) -> Column:
    """(action, frame, skipped) of a tick: what a policy's decision becomes within a selection (an empty one is everything).

    end: the selection or the target is over, all of it shown, or its tail can't complete; jump: the clock stands in a
    gap and goes on to the next selected frame; submit: the frame, moved over a gap if it lies in one; else idle.
    """
    chosen = F.size(ranges) > 0
    off = chosen & ~X.contains(ranges, current)
    to = X.next_included(ranges, current)
    end = F.least(last_frame, F.array_max(F.transform(ranges, lambda r: r["end"])))
    over = (current >= end) & ((completed >= end) | ((submitted >= end) & (in_flight == 0)))
    frame = F.when(chosen, X.next_included(ranges, decided)).otherwise(decided)
    action = (F.when(off & to.isNull(), "end").when(off, "jump").when(decided.isNull(), "idle").when(over, "end")
              .when(frame.isNull() | (frame > end), "idle").otherwise("submit"))
    gap = F.when(chosen, X.included_between(ranges, submitted, frame)).otherwise(frame - submitted - 1)
    return F.struct(
        action.alias("action"), F.when(action == "jump", to).when(action == "submit", frame).cast("long").alias("frame"),
        F.when((action == "submit") & (frame > submitted + 1), gap).otherwise(0).cast("long").alias("skipped"))


def ahead(completed: Column, playhead: Column, frames: Column) -> Column:
    """(done_ahead, remaining): frames rendered from the playhead on, and frames left from it, one at least."""
    return F.struct(F.greatest(F.lit(0), completed - playhead + 1).cast("long").alias("done_ahead"), F.greatest(F.lit(1), frames - playhead).cast("long").alias("remaining"))


def buffered(progress: DataFrame, key: str, seq: str, fps: float, sparse: bool = False) -> DataFrame:
    """key, seq, head_start, shown, goal, release of a table of progress (done_ahead, remaining, face_rate, rate) by tick.

    The head start is sized anew whenever a rate is known (that of frames with faces first) and the first few frames are
    done; until then it is what it was. Playback is released once it is reached or all is done; later ticks are absent.
    """
    rate = F.when(F.col("face_rate") > 0, F.col("face_rate")).otherwise(F.col("rate"))
    ready = (rate > 0) & (F.col("done_ahead") >= F.least(F.lit(WARMUP_FRAMES), F.col("remaining")))
    size = S.sparse_prefill(F.lit(fps), rate, F.lit(CUSHION_SECONDS)) if sparse else S.required_prefill(F.col("remaining"), rate, F.lit(fps))
    line = W.partitionBy(key).orderBy(seq).rowsBetween(W.unboundedPreceding, 0)
    d = progress.withColumn("head_start", F.last(F.when(ready, size), True).over(line))
    goal = F.coalesce("head_start", "remaining")
    release = F.coalesce(F.col("done_ahead") >= F.col("head_start"), F.lit(False)) | (F.col("done_ahead") >= F.col("remaining"))
    d = d.withColumn("release", release)
    before = F.max("release").over(W.partitionBy(key).orderBy(seq).rowsBetween(W.unboundedPreceding, -1))
    d = d.withColumn("_over", F.coalesce(before, F.lit(False))).where(~F.col("_over"))
    return d.select(key, seq, "head_start", F.least(F.col("done_ahead"), goal).alias("shown"), F.greatest(F.lit(1), goal).alias("goal"), "release")


def after_control(kind: Column, at: Column, completed: Column) -> Column:
    """(submitted, completed) after a control: work goes on from a frame; a seek sets what is complete, others lower it."""
    return F.struct((at - 1).alias("submitted"), F.when(kind == "seek", at - 1).otherwise(F.least(completed, at - 1)).alias("completed"))


def sync_lag(target: Column, shown: Column, video_s: Column, audio_s: Column) -> Column:
    """(offset, lag): seconds that audio is ahead of video, frames that the display is behind."""
    return F.struct((audio_s - video_s).alias("offset"), (target - shown).alias("lag"))


def recent_values(df: DataFrame, key: list[str], value: str, micros: str, seconds: float, most: int = 1024) -> DataFrame:
    """`df` with n and median of the values of the last seconds, of at most so many rows; 0 without any. Nulls are no values.

    A fold over the rows of each key: the last ones in a ring, their values sorted beside it.
    """
    rest = [c for c in df.columns if c not in key]
    t, v, span = rest.index(micros), rest.index(value), round(seconds * 1e6)
    out = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest) + ", n long, median double"

    def step(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        ring, ordered = state
        ring.append((row[t], row[v]))
        if row[v] is not None:
            insort(ordered, (row[v] != row[v], row[v]))  # what isn't a number comes last
        while len(ring) > most or ring[0][0] < row[t] - span:
            x = ring.popleft()[1]
            if x is not None:
                del ordered[bisect_left(ordered, (x != x, x))]
        n = len(ordered)
        return state, [(*row, n, (ordered[(n - 1) // 2][1] + ordered[n // 2][1]) / 2 if n else 0.0)]

    return folded(df, key, [micros], lambda: (deque(), []), step, out).select(*df.columns, "n", "median")


def history(df: DataFrame, key: list[str], micros: str, seconds: float = 30.0) -> DataFrame:
    """Rows of the last seconds of each series."""
    newest = F.max(micros).over(W.partitionBy(*key))
    return df.withColumn("_end", newest).where(F.col(micros) >= F.col("_end") - round(seconds * 1e6)).drop("_end")


def first_seen_numbers(df: DataFrame, value: str, order: list[str]) -> DataFrame:
    """value, number: distinct values numbered from 0 by first appearance, those that appear together by value.

    Only one row a value is put in order, in ranges.
    """
    first = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.min(F.struct(*order)).alias("_at"))
    return numbered(first, [F.col("_at"), F.col(value)], "number").select(value, (F.col("number") - 1).alias("number"))
