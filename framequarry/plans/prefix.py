"""Running sums and numbers over a global order without putting all rows into one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows that a range holds as a rule, ranges at most, and rows of the sample for each range.
RANGE_ROWS, MOST_RANGES, SAMPLED = 100_000, 4096, 60


def in_ranges(df: DataFrame, order: list[Column], out: str, rows: int | None = None) -> DataFrame:
    """`df` with `out`: the number of the range of the ascending `order` in which a row lies, from 0.

    The ranges' bounds are chosen once, from a sample, and from then on are constants of the plan: the number is a plain
    column, which every use of the result agrees on, however Spark deals out the rows for each.
    """
    rows = RANGE_ROWS if rows is None else rows
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    n = min(MOST_RANGES, -(-(total := df.count()) // rows))
    if n < 2:
        return df.withColumn(out, F.lit(0))
    some = df.select(key.alias("k")).sample(min(1.0, SAMPLED * n / total), seed=1).orderBy("k").collect()
    bounds = [some[i * len(some) // n].k for i in range(1, n)] if some else []
    step = max(1, math.isqrt(len(bounds)))
    chunks = [bounds[i : i + step] for i in range(0, len(bounds), step)] or [[]]
    kind = df.select(key.alias("k")).schema["k"].dataType.simpleString()
    one = df.sparkSession.createDataFrame([([c[0] for c in chunks[1:]], chunks)], f"_firsts array<{kind}>, _chunks array<array<{kind}>>")
    below = lambda some: F.size(F.filter(some, lambda b: b <= F.col("_key")))
    d = df.crossJoin(F.broadcast(one)).withColumn("_key", key).withColumn("_chunk", below("_firsts"))
    return d.withColumn(out, F.col("_chunk") * step + below(F.get("_chunks", F.col("_chunk")))).drop("_firsts", "_chunks", "_key", "_chunk")


def running_sum(df: DataFrame, value: str | Column, order: list[Column], out: str, rows: int | None = None) -> DataFrame:
    """`df` with `out`: the sum of `value` over this row and all before it in the ascending `order` (must be a total one).

    Rows are summed within ranges of the order; the ranges' totals, one row for each, are summed on their own and added.
    Only these few rows meet in one task. `df` is read several times, so it must give the same rows each time.
    """
    value = F.col(value) if isinstance(value, str) else value
    d = in_ranges(df, order, "_range", rows)
    within = d.withColumn("_run", F.sum(value).over(W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    totals = d.groupBy("_range").agg(F.sum(value).alias("_total"))
    before = F.coalesce(F.sum("_total").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    before = totals.select("_range", before.alias("_before"))
    return within.join(F.broadcast(before), "_range").withColumn(out, F.col("_run") + F.col("_before")).drop("_range", "_run", "_before")


def numbered(df: DataFrame, order: list[Column], out: str, rows: int | None = None) -> DataFrame:
    """`df` with `out`: the place of each row in the ascending `order` (must be a total one), from 1."""
    return running_sum(df, F.lit(1).cast("long"), order, out, rows)
