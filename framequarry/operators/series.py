"""Time series of ticks, completions and latencies: rates, counters, percentiles, change points, as-of values, smoothing.

All windows are partitioned by a series key; a series is one session's or target's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RATE_SECONDS, STALL_SECONDS, PERCENTILE_ROWS = 3.0, 30.0, 200


def recent(df: DataFrame, key: list[str], micros: str, seconds: float, at: Column | None = None, value: str | None = None) -> DataFrame:
    """`df` with _n, _first and _last: number, least and largest of the times `at` (null: none; by default all of
    `micros`) in the last seconds up to a row's time; with a column `value` also _value, the least one at _first.

    A window that slides over rows costs, for each row, all rows in it. Here times are counted once for each series, and
    lie with those of the step before in steps as long as the window, so that a row's window ends within its step and
    the one before; both ends are found by running sums over a step's times, which Spark's windows add up in one pass.
    Rows without a time get what a window over nulls gives: what the other such rows of their series hold.
    """
    span, us = round(seconds * 1e6), F.col(micros)
    step = lambda t: F.floor(t / F.lit(max(span, 1))).cast("long")
    times = df.groupBy(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(key)], us.alias("_us")).agg(F.count("*" if at is None else at).alias("_c"), (F.min(value) if value else F.lit(None)).alias("_v"))
    by = [f"_k{i}" for i in range(len(key))]
    known = times.where("_us is not null")
    cell = step(F.col("_us"))
    # a time's place as the end of its own window, as an event in this step and the next, and as the start of its window
    rows = known.select(*by, F.col("_us"), "_c", "_v", F.explode(F.array(
        F.struct(cell.alias("step"), F.col("_us").alias("at"), F.lit(1).alias("kind")),
        F.struct((cell + 1).alias("step"), F.col("_us").alias("at"), F.lit(2).alias("kind")),
        F.struct(cell.alias("step"), (F.col("_us") - span).alias("at"), F.lit(0).alias("kind")))).alias("_p"))
    rows = rows.select(*by, "_us", F.col("_p.step").alias("_step"), F.col("_p.at").alias("_at"), F.col("_p.kind").alias("_kind"), F.when(F.col("_p.kind") > 0, F.col("_c")).otherwise(0).alias("_c"), "_v")
    event = F.when(F.col("_c") > 0, F.col("_at"))
    up = W.partitionBy(*by, "_step").orderBy("_at", "_kind").rowsBetween(W.unboundedPreceding, 0)
    down = W.partitionBy(*by, "_step").orderBy(F.desc("_at"), F.desc("_kind")).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("_upto", F.sum("_c").over(up)).withColumn("_newest", F.max(event).over(up)).withColumn("_next", F.min(F.when(event.isNotNull(), F.struct("_at", "_v"))).over(down))
    end, start = F.col("_kind") == 1, F.col("_kind") == 0
    ends = rows.where("_kind < 2").groupBy(*by, "_us").agg(
        F.max(F.when(end, F.col("_upto"))).alias("_upto"), F.max(F.when(start, F.col("_upto"))).alias("_before"),
        F.max(F.when(end, F.col("_newest"))).alias("_newest"), F.max(F.when(start, F.col("_next"))).alias("_next"))
    n = F.col("_upto") - F.col("_before")
    ends = ends.select(*by, "_us", n.alias("_n"), F.when(n > 0, F.col("_next._at")).alias("_first"), F.when(n > 0, F.col("_newest")).alias("_last"), F.when(n > 0, F.col("_next._v")).alias("_value"))
    none = times.where("_us is null").select(*by, "_us", F.col("_c").alias("_n"), F.lit(None).cast("long").alias("_first"), F.lit(None).cast("long").alias("_last"), F.col("_v").alias("_value"))
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(key)] + [us.eqNullSafe(F.col("_us"))]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return df.join(ends.unionByName(none), on, "left").drop(*by, "_us", *([] if value else ["_value"]))


def window_rate(df: DataFrame, key: list[str], micros: str = "us", seconds: float = RATE_SECONDS) -> DataFrame:
    """`df` with `rate`: (n - 1) by the time between the first and last of the last seconds; 0 with under two or no time."""
    d = recent(df, key, micros, seconds)
    span = (F.col(micros) - F.col("_first")) / 1e6
    rate = F.when((F.col("_n") < 2) | (span == 0), 0.0).otherwise((F.col("_n") - 1) / F.nullif(span, F.lit(0.0)))
    return d.withColumn("rate", rate).drop("_n", "_first", "_last")


def rate_with_decay(df: DataFrame, key: list[str], micros: str = "us", event: str = "is_event", cap: float = 120.0, seconds: float = RATE_SECONDS, stall: float = STALL_SECONDS) -> DataFrame:
    """For ticks among events: the window rate, 0 if its events have no time between them; once it has under two events,
    1 by the time since the last, held down by the last window rate (the cap if that is 0 or there is none), until the
    stall limit, then 0. Adds `rate`."""
    n, first, last = F.col("_n"), F.col("_first"), F.col("_last")
    d = recent(df, key, micros, seconds, F.when(F.col(event), F.col(micros)))
    d = d.withColumn("_live", F.when((n >= 2) & (last == first), 0.0).when(n >= 2, (n - 1) / F.nullif((last - first) / 1e6, F.lit(0.0)))).drop("_n", "_first", "_last")
    past = W.partitionBy(*key).orderBy(micros).rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("_known", F.last("_live", True).over(past)).withColumn("_last", F.max(F.when(F.col(event), F.col(micros))).over(past))
    idle = (F.col(micros) - F.col("_last")) / 1e6
    known = F.coalesce("_known", F.lit(0.0))
    slow = F.least(F.when(known > 0, known).otherwise(cap), F.when(idle > 0, 1 / F.nullif(idle, F.lit(0.0))).otherwise(known))
    slow = F.when(F.col("_last").isNull() | (idle > stall), 0.0).otherwise(slow)
    return d.withColumn("rate", F.coalesce("_live", slow)).drop("_live", "_known", "_last")


def counter_rate(df: DataFrame, key: list[str], count: str, micros: str = "us") -> DataFrame:
    """`df` with `rate` of a growing counter; 0 at a series' start, without time passed or after a reset."""
    w = W.partitionBy(*key).orderBy(micros)
    dc, dt = F.col(count) - F.lag(count).over(w), (F.col(micros) - F.lag(micros).over(w)) / 1e6
    return df.withColumn("rate", F.when(dc.isNull() | (dt <= 0) | (dc < 0), 0.0).otherwise(dc / F.nullif(dt, F.lit(0.0))))


def step_rate(df: DataFrame, key: list[str], stage: str, done: str, micros: str = "us", seconds: float = RATE_SECONDS, total: str | None = None) -> DataFrame:
    """Rate and elapsed time within a stage; the window has the last seconds, but two samples at least.

    With a column `total`, also the expected time of the whole stage: null without a rate or with nothing left to do.
    """
    by = [*key, stage]
    df, line = recent(df, by, micros, seconds, value=done), W.partitionBy(*by).orderBy(micros)
    alone = F.col("_first") == F.col(micros)
    t0 = F.when(alone, F.lag(micros).over(line)).otherwise(F.col("_first"))
    d0 = F.when(alone, F.lag(done).over(line)).otherwise(F.col("_value"))
    dt = (F.col(micros) - t0) / 1e6
    rate = F.when(dt > 0, (F.col(done) - d0) / F.nullif(dt, F.lit(0.0))).otherwise(0.0)
    start = F.min(micros).over(W.partitionBy(*by))
    d = df.withColumn("rate", F.coalesce(rate, F.lit(0.0))).withColumn("elapsed", (F.col(micros) - start) / 1e6).drop("_n", "_first", "_last", "_value")
    if total is None:
        return d
    left = F.col(total) - F.col(done)
    return d.withColumn("expected", F.when((F.col("rate") > 0) & (left > 0), F.col("elapsed") + left / F.nullif(F.col("rate"), F.lit(0.0))))


def recent_percentiles(df: DataFrame, key: list[str], value: str, order: list[str], last: int = PERCENTILE_ROWS) -> DataFrame:
    """key, n, p50, p95 of the last rows of each series; 0 with under two."""
    newest = W.partitionBy(*key).orderBy(*[F.col(c).desc() for c in order])
    r = df.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= last)
    p = lambda q: F.when(F.count(value) < 2, 0.0).otherwise(F.percentile(value, q))
    return r.groupBy(*key).agg(F.count(value).alias("n"), p(0.5).alias("p50"), p(0.95).alias("p95"))


def mean_by(df: DataFrame, key: list[str], value: str, micros: str, until: Column, seconds: float) -> DataFrame:
    """key, mean of what lies within the seconds up to a time."""
    return df.where((F.col(micros) <= until) & (F.col(micros) >= until - round(seconds * 1e6))).groupBy(*key).agg(F.avg(value).alias("mean"))


def changes(df: DataFrame, key: list[str], value: str, order: str) -> DataFrame:
    """Rows whose value differs from the one before (nulls are equal); the first of a series always."""
    w = W.partitionBy(*key).orderBy(order)
    return df.withColumn("_first", F.row_number().over(w) == 1).withColumn("_before", F.lag(value).over(w)).where(
        F.col("_first") | ~F.col(value).eqNullSafe(F.col("_before"))).drop("_first", "_before")


def never_back(df: DataFrame, key: list[str], shown: str, order: str) -> DataFrame:
    """Rows that show no earlier frame than any before them."""
    top = F.max(shown).over(W.partitionBy(*key).orderBy(order).rowsBetween(W.unboundedPreceding, -1))
    return df.withColumn("_top", top).where(F.col("_top").isNull() | (F.col(shown) >= F.col("_top"))).drop("_top")


def skipped(df: DataFrame, key: list[str], frame: str, order: str) -> DataFrame:
    """`df` with `skipped`: frames between this submission and the one before."""
    before = F.lag(frame).over(W.partitionBy(*key).orderBy(order))
    return df.withColumn("skipped", F.greatest(F.lit(0), F.coalesce(F.col(frame) - before - 1, F.lit(0))).cast("long"))


def carry_forward(df: DataFrame, key: list[str], value: str, n: str, interval: int, out: str) -> DataFrame:
    """`df` with the value of the last row whose number is a multiple of the interval."""
    at = F.when(F.col(n) % interval == 0, F.col(value))
    return df.withColumn(out, F.last(at, True).over(W.partitionBy(*key).orderBy(n).rowsBetween(W.unboundedPreceding, 0)))


def next_previous(df: DataFrame, key: list[str], frame: str, bad: Column) -> DataFrame:
    """`df` with next_bad and previous_bad: nearest marked frames after and before each."""
    at, w = F.when(bad, F.col(frame)), W.partitionBy(*key).orderBy(frame)
    return df.withColumn("next_bad", F.first(at, True).over(w.rowsBetween(1, W.unboundedFollowing))).withColumn(
        "previous_bad", F.last(at, True).over(w.rowsBetween(W.unboundedPreceding, -1)))


def as_of(ticks: DataFrame, done: DataFrame, key: list[str], tick: str, frame: str, out: str = "shown") -> DataFrame:
    """`ticks` with the newest frame of `done` at or below each tick's, in one sort of both, without a range join."""
    a = ticks.withColumn("_at", F.col(tick)).withColumn("_f", F.lit(None).cast(done.schema[frame].dataType)).withColumn("_tick", F.lit(1))
    b = done.select(*key, F.col(frame).alias("_at"), F.col(frame).alias("_f")).withColumn("_tick", F.lit(0))
    w = W.partitionBy(*key).orderBy("_at", "_tick").rowsBetween(W.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn(out, F.last("_f", True).over(w))
    return both.where("_tick = 1").drop("_at", "_f", "_tick")


def smooth(df: DataFrame, key: list[str], frame: str, values: list[str], window: int, strength: float) -> DataFrame:
    """Centred Gaussian smoothing of tracks, apart for runs of consecutive frames.

    The kernel is the largest odd length within the window (made odd) and the run; runs under three frames, and tracks
    with two rows in a frame, stay as they are. At a run's ends weights are normalized again; `strength` blends.
    """
    if window <= 1 or strength <= 0:
        return df
    window += window % 2 == 0
    by = W.partitionBy(*key)
    same = F.count("*").over(W.partitionBy(*key, frame))
    d = df.withColumn("_same", same).withColumn("_twice", F.max("_same").over(by) > 1)
    d = d.withColumn("_run", F.col(frame) - F.row_number().over(by.orderBy(frame)))
    run = W.partitionBy(*key, "_run")
    n = F.count("*").over(run)
    d = d.withColumn("_n", n)
    length = F.least(F.lit(window), F.col("_n") - (1 - F.col("_n") % 2))
    d = d.withColumn("_len", F.when(F.col("_twice") | (length < 3), 1).otherwise(length))
    radius = (F.col("_len") - 1) / 2
    line = run.orderBy(frame).rowsBetween(-(window // 2), window // 2)
    d = d.withColumn("_near", F.when(F.col("_len") > 1, F.collect_list(F.struct(F.col(frame).alias("f"), *values)).over(line)))
    out = d
    sigma = radius / 3
    weight = lambda r: F.when(F.abs(r["f"] - F.col(frame)) <= radius, F.exp(-((r["f"] - F.col(frame)) * (r["f"] - F.col(frame))) / (2 * sigma * sigma))).otherwise(0.0)
    total = F.aggregate("_near", F.lit(0.0), lambda s, r: s + weight(r))
    moment = lambda v: F.aggregate("_near", F.lit(0.0), lambda s, r: s + weight(r) * r[v])
    for v in values:
        mean = moment(v) / total
        out = out.withColumn(v, F.when(F.col("_len") > 1, F.col(v) + strength * (mean - F.col(v))).otherwise(F.col(v)))
    return out.drop("_same", "_twice", "_run", "_n", "_len", "_near")
