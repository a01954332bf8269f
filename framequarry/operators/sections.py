"""Interval sets: canonical sorted, merged, inclusive ranges of frames, and what is asked of them.

A set may belong to a target: `key` columns keep sets apart, so that all windows are partitioned. Without keys a set is
the selection of one target, a small table by its nature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranges that are turned into a literal predicate, so that it is pushed into the scan.
MAX_LITERAL_RANGES = 200


def canonical(pairs: DataFrame, *key: str) -> DataFrame:
    """key, start, end: ends swapped where needed, below 0 cut off or dropped, ranges that overlap or touch merged."""
    p = pairs.where("start is not null and end is not null").select(*key, F.least("start", "end").alias("start"), F.greatest("start", "end").alias("end")).where("end >= 0")
    p = p.withColumn("start", F.greatest("start", F.lit(0)))
    by = W.partitionBy(*key).orderBy("start", "end")
    p = p.withColumn("_reach", F.max("end").over(by.rowsBetween(W.unboundedPreceding, -1)))
    p = p.withColumn("_new", (F.col("_reach").isNull() | (F.col("start") > F.col("_reach") + 1)).cast("int"))
    p = p.withColumn("_run", F.sum("_new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return p.groupBy(*key, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")


def union(a: DataFrame, b: DataFrame, *key: str) -> DataFrame:
    return canonical(a.select(*key, "start", "end").unionByName(b.select(*key, "start", "end")), *key)


def without(sections: DataFrame, index: int, *key: str) -> DataFrame:
    """The set without its range of that ordinal, counted from 0."""
    return numbered(sections, *key).where(F.col("ordinal") != index).drop("ordinal")


def replaced(sections: DataFrame, index: int, start: int, end: int, *key: str) -> DataFrame:
    """The set with another range in the place of one; sets without that ordinal gain the range all the same."""
    new = sections.select(*key).distinct() if key else sections.sparkSession.range(1).select()
    new = new.select(*key, F.lit(start).cast("long").alias("start"), F.lit(end).cast("long").alias("end"))
    return union(without(sections, index, *key), new, *key)


def numbered(sections: DataFrame, *key: str) -> DataFrame:
    return sections.withColumn("ordinal", (F.row_number().over(W.partitionBy(*key).orderBy("start")) - 1).cast("long"))


def clamp(sections: DataFrame, last: int | Column, *key: str) -> DataFrame:
    """The part of the set up to a frame."""
    last = F.lit(last) if isinstance(last, int) else last
    return canonical(sections.where(F.col("start") <= last).withColumn("end", F.least(F.col("end"), last)), *key)


def totals(sections: DataFrame, *key: str) -> DataFrame:
    """key, frames, first, last: size and ends of a set."""
    size = F.coalesce(F.sum(F.col("end") - F.col("start") + 1), F.lit(0)).cast("long")
    return sections.groupBy(*key).agg(size.alias("frames"), F.min("start").alias("first"), F.max("end").alias("last"))


def as_array(sections: DataFrame, *key: str) -> DataFrame:
    """key, ranges: a set as a sorted array, one row for each target."""
    return sections.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("ranges"))


def contains(ranges: Column, frame: Column) -> Column:
    return F.exists(ranges, lambda r: (frame >= r["start"]) & (frame <= r["end"]))


def index_of(ranges: Column, frame: Column) -> Column:
    """Ordinal of the range that holds the frame, null if none does."""
    hit = F.filter(F.transform(ranges, lambda r, i: F.struct(r["start"].alias("s"), r["end"].alias("e"), i.alias("i"))), lambda r: (frame >= r["s"]) & (frame <= r["e"]))
    return F.get(hit, 0)["i"].cast("long")


def next_included(ranges: Column, frame: Column) -> Column:
    """The first frame of the set at or after a frame, null beyond the last."""
    return F.array_min(F.transform(F.filter(ranges, lambda r: r["end"] >= frame), lambda r: F.greatest(r["start"], frame)))


def included_between(ranges: Column, a: Column, b: Column) -> Column:
    """Frames of the set strictly between two frames."""
    return F.aggregate(ranges, F.lit(0).cast("long"), lambda s, r: s + F.greatest(
        F.lit(0), F.least(r["end"], b - 1) - F.greatest(r["start"], a + 1) + 1).cast("long"))


def frame_plan(sections: DataFrame, totals: int | DataFrame, *key: str) -> DataFrame:
    """key, frame_index, position: the frames that are read, in order, with their output places; an empty set means all.

    `totals` is the number of frames, or a table (key, total) of the targets, each of which gets a plan. Places come from
    the sizes of the ranges before, so frames need no order of their own.
    """
    if isinstance(totals, int):
        totals = sections.sparkSession.createDataFrame([(totals,)], "total long")
    pick = sections.select(*key, F.struct("start", "end").alias("r"))
    both = totals.where("total > 0").join(pick, [*key], "left") if key else totals.where("total > 0").join(pick, F.lit(True), "left")
    one = both.select(*key, "total", F.coalesce("r.start", F.lit(0)).alias("start"), F.coalesce("r.end", F.col("total") - 1).alias("end"))
    some = clamp(one.select(*key, "start", "end", "total"), F.col("total") - 1, *key)
    before = W.partitionBy(*key).orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    some = some.withColumn("_before", F.coalesce(F.sum(F.col("end") - F.col("start") + 1).over(before), F.lit(0)))
    return some.select(*key, F.explode(F.sequence("start", "end")).alias("frame_index"), "start", "_before").select(
        *key, "frame_index", (F.col("_before") + F.col("frame_index") - F.col("start")).alias("position"))


def strided(plan: DataFrame, stride: int, skip: int = 0) -> DataFrame:
    """Every stride-th place of a plan, without the first `skip` of these; of a plan with frames one is left at least."""
    return plan.where((F.col("position") % stride == 0) & (F.col("position") >= skip * stride))


def gaps(sections: DataFrame, total: int, *key: str) -> DataFrame:
    """key, start, end: the ranges of 0 to total - 1 that each set leaves out."""
    s = clamp(sections, total - 1, *key).select(*key, "start", "end")
    last = s.select(*key).distinct() if key else sections.sparkSession.range(1).select()
    ends = s.unionByName(last.select(*key, F.lit(total).cast("long").alias("start"), F.lit(total).cast("long").alias("end")))
    left = ends.withColumn("_from", F.coalesce(F.lag("end").over(W.partitionBy(*key).orderBy("start")) + 1, F.lit(0)))
    return left.where("_from < start").select(*key, F.col("_from").alias("start"), (F.col("start") - 1).alias("end"))


def selected(frames: DataFrame, sections: DataFrame, frame: str = "frame_index") -> DataFrame:
    """Rows of `frames` within the set; all if it is empty.

    Few ranges become BETWEEN literals that reach the scan; many are joined on the frame number, as equal keys.
    """
    some = sections.orderBy("start").limit(MAX_LITERAL_RANGES + 1).collect()
    if not some:
        return frames
    if len(some) <= MAX_LITERAL_RANGES:
        cond = F.lit(False)
        for r in some:
            cond = cond | F.col(frame).between(r.start, r.end)
        return frames.where(cond)
    wanted = sections.select(F.explode(F.sequence("start", "end")).alias(frame))
    return frames.join(wanted, frame, "left_semi")
