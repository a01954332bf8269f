"""Staged, resumable jobs over frames: what is missing, how far a stage is, packaging rules, the queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from .stages import CLEANUP


def present(files: DataFrame, idx: str = "idx", size: str = "size_bytes") -> DataFrame:
    """Indices of frames that exist and aren't empty."""
    return files.where(F.col(size) > 0).select(idx).distinct()


def missing(spark, total: int, done: DataFrame, idx: str = "idx") -> DataFrame:
    return spark.range(total).select(F.col("id").alias(idx)).join(done.select(idx), idx, "left_anti")


def missing_by(stages: DataFrame, done: DataFrame, key: str, total: str, idx: str = "idx") -> DataFrame:
    """key, idx of all frames that stages (key, total) lack."""
    want = stages.where(F.col(total) > 0).select(key, F.explode(F.sequence(F.lit(0).cast("long"), F.col(total).cast("long") - 1)).alias(idx))
    return want.join(done.select(key, idx), [key, idx], "left_anti")


def high_water(stages: DataFrame, done: DataFrame, key: str, total: str, idx: str = "idx") -> DataFrame:
    """key, contiguous: how many frames from 0 on are done without a gap.

    Done frames are ranked within their stage; the gapless ones are those whose rank is their index.
    """
    d = done.select(key, idx).distinct().join(stages.select(key, total), key).where((F.col(idx) >= 0) & (F.col(idx) < F.col(total)))
    r = d.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(idx)) - 1).where(F.col("_n") == F.col(idx))
    n = r.groupBy(key).agg(F.count("*").alias("contiguous"))
    return stages.select(key).join(n, key, "left").select(key, F.coalesce("contiguous", F.lit(0)).cast("long").alias("contiguous"))


def complete(stages: DataFrame, done: DataFrame, key: str, total: str, idx: str = "idx") -> DataFrame:
    """key, complete: whether all frames 0 to total - 1 are done."""
    n = done.select(key, idx).distinct().join(stages.select(key, total), key).where((F.col(idx) >= 0) & (F.col(idx) < F.col(total)))
    n = n.groupBy(key).agg(F.count("*").alias("_n"))
    return stages.join(n, key, "left").select(key, (F.coalesce("_n", F.lit(0)) == F.greatest(F.col(total), F.lit(0))).alias("complete"))


def first_error(errors: DataFrame, key: str, order: str, error: str) -> DataFrame:
    return errors.groupBy(key).agg(F.min_by(error, order).alias("first_error"), F.count("*").alias("errors"))


def missing_preview(gone: DataFrame, key: str, idx: str = "idx", n: int = 8) -> DataFrame:
    """key, n_missing, preview: the first missing frames as text. Only the first `n` of a key are gathered."""
    w = W.partitionBy(key).orderBy(idx)
    some = gone.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)
    text = some.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(idx)), lambda x: x.cast("string")), ", ").alias("preview"))
    return gone.groupBy(key).agg(F.count("*").alias("n_missing")).join(text, key)


def accept_shortfall(tasks: DataFrame, claimed: str, decoded: str, fps: str) -> DataFrame:
    """`tasks` with status and total: a source that ends early within tolerance completes with what it has."""
    bad = S.shortfall_fails(F.col(claimed), F.col(decoded), F.col(fps))
    return tasks.withColumn("status", F.when(bad, "failed").otherwise("completed")).withColumn("total", F.col(decoded))


def next_task(tasks: DataFrame, order: str = "order", name: str = "file", status: str = "status") -> DataFrame:
    """The first runnable task: pending or paused, by order, then by name."""
    return tasks.where(F.col(status).isin("PENDING", "PAUSED")).orderBy(order, name).limit(1)


def queue_states(tasks: DataFrame, status: str = "status", ended: str = "ended", continues: str = "continue_on_error") -> DataFrame:
    """`tasks` with `runnable`: pending or paused ones, unless the queue was halted.

    It is halted, for all tasks, by one that `ended` in this run paused or cancelled, or failed without a wish of its own to
    go on.
    """
    s = F.col(status)
    halts = F.col(ended) & (s.isin("PAUSED", "CANCELLED") | ((s == "FAILED") & ~F.col(continues)))
    halted = tasks.agg(F.coalesce(F.bool_or(halts), F.lit(False)).alias("_halted"))
    return tasks.crossJoin(F.broadcast(halted)).withColumn("runnable", s.isin("PENDING", "PAUSED") & ~F.col("_halted")).drop("_halted")


def overall_fraction(done: Column, total: Column, stage: Column, stages: Column) -> Column:
    """Progress over all stages, each an equal share."""
    return F.when(stages <= 0, 0.0).otherwise((stage + F.coalesce(F.try_divide(done.cast("double"), total), F.lit(0.0))) / F.nullif(stages, F.lit(0)))


def minted(templates: DataFrame, pairs: DataFrame, key: list[str]) -> DataFrame:
    """A task for each (source, target) with the template's other fields and an id from both."""
    rest = [c for c in templates.columns if c not in ("source", "target", "task_id")]
    return pairs.crossJoin(F.broadcast(templates.select(*rest).limit(1))).withColumn("task_id", S.short_hash("sha1", 12, *[F.col(c) for c in key]))


def renumbered(plan: DataFrame, frames: DataFrame, frame: str = "frame_index") -> DataFrame:
    """Frames of a plan with their output place; the original index stays, by which geometry is looked up."""
    return frames.join(plan.select(frame, "position"), frame)


def summary(stages: DataFrame, done: DataFrame, errors: DataFrame, key: str, total: str, idx: str = "idx") -> DataFrame:
    """key, n_missing, total, first_error, status of each stage: failed while frames are missing."""
    gone = missing_by(stages, done, key, total, idx).groupBy(key).agg(F.count("*").alias("n_missing"))
    d = stages.select(key, F.col(total).alias("total")).join(gone, key, "left").join(first_error(errors, key, idx, "error"), key, "left")
    n = F.coalesce("n_missing", F.lit(0))
    return d.select(key, n.alias("n_missing"), "total", "first_error", F.when(n > 0, "failed").otherwise("completed").alias("status"))


def packaged(tasks: DataFrame, encoder: bool) -> DataFrame:
    """`tasks` (video, output) with form and note: a video becomes frames in a folder of its name where there is no encoder."""
    fall = F.col("video") & F.lit(not encoder)
    return tasks.withColumn("form", F.when(F.col("video") & ~fall, "video").otherwise("frames")).withColumn(
        "output", F.when(fall, F.regexp_replace("output", r"\.[^./]*$", "")).otherwise(F.col("output"))).withColumn("note", F.when(fall, "no encoder: frames instead"))


def kept_stages(stages: DataFrame, cleanup: str, key: str = "task", place: str = "place", done: str = "complete", packaged: str = "packaged") -> DataFrame:
    """`stages` with `keep`: KEEP all; AUTO what a running job still reads, which is the last complete stage and all after
    it; DROP_AT_END all; of a task whose output is packaged these two keep none."""
    if cleanup not in CLEANUP:
        raise ValueError(cleanup)
    running = ~F.col(packaged)
    if cleanup == "KEEP":
        keep = F.lit(True)
    elif cleanup == "AUTO":
        keep = running & (F.col(place) >= F.coalesce(F.max(F.when(F.col(done), F.col(place))).over(W.partitionBy(key)), F.lit(-1)))
    else:
        keep = running
    return stages.withColumn("keep", keep)


def fingerprints(tasks: DataFrame, now: Column) -> DataFrame:
    """`tasks` (saved, completed_stages, last_frame, total) after a look at what they depend on: marks of another
    fingerprint are reset, none saved yet is fine."""
    other = F.col("saved").isNotNull() & (F.col("saved") != "") & (F.col("saved") != now)
    reset = {"completed_stages": 0, "last_frame": -1, "total": -1}
    return tasks.withColumns({c: F.when(other, F.lit(v)).otherwise(F.col(c)) for c, v in reset.items()} | {"reset": other, "saved": now})
