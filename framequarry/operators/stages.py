"""Stages and jobs that survive frames that fail, and drivers that are stopped.

A stage's table holds frames that were done and, beside them, what others failed with. A job keeps a journal of events in
its folder; what is done, and what is still to do after a stop, is folded from it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .versions import Files, Table

#: What a captured row failed with; null for rows that were done.
ERROR = "_error"
#: Missing frames that a message names (fixed value).
NAMED = 8
CLEANUP = ("KEEP", "AUTO", "DROP_AT_END")


def tried(x: pd.DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, Exception | None]]:
    """What `work` makes of `x`; if it raises, what it makes of each half of `x`, and so on down to rows and their errors."""
    todo = [x]
    while todo:
        part = todo.pop()
        if part.empty:
            continue
        try:
            yield work(part.copy()), None
        except Exception as e:  # noqa: BLE001
            if len(part) == 1:
                yield part, e
            else:
                half = len(part) // 2
                todo += [part.iloc[half:], part.iloc[:half]]


def captured(frames: DataFrame, processors: list, schema: str | StructType | None = None, idx: str = "idx") -> DataFrame:
    """Frames through a chain of processors (see `apply_chain`), with what failed: rows of `schema` and `_error`.

    A batch that raises is cut in halves until only the rows that fail are left; these have their `idx`, the error and
    nulls. So no row takes others with it, and good batches cost nothing more. A processor sees rows of a batch that
    failed several times. What raises in setup() isn't a frame's fault and ends the job.
    """
    spark = frames.sparkSession
    kind = frames.schema if schema is None else schema if isinstance(schema, StructType) else spark.createDataFrame([], schema).schema
    out = StructType([*[StructField(f.name, f.dataType, True) for f in kind.fields], StructField(ERROR, StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def chain(x: pd.DataFrame) -> pd.DataFrame:
            for p in processors:
                x = p.process(x)
            return x

        for p in processors:
            p.setup()
        try:
            for x in batches:
                failed: list[tuple] = []
                for y, e in tried(x, chain):
                    if e is None:
                        yield y.assign(**{ERROR: None})
                    else:
                        failed.append((y[idx].iloc[0], f"{type(e).__name__}: {e}"))
                if failed:
                    none = pd.DataFrame({f.name: [None] * len(failed) for f in kind.fields}, dtype=object)
                    yield none.assign(**{idx: pd.Series([i for i, _ in failed], dtype=x[idx].dtype), ERROR: [e for _, e in failed]})
        finally:
            for p in processors:
                p.release()

    return frames.mapInPandas(run, out)


class Stage(NamedTuple):
    """How a stage ended: COMPLETED or FAILED; the frames that are done, those missing, errors (idx, attempt, error) of this
    run, and the first of them if frames are missing."""

    status: str
    rows: DataFrame
    missing: DataFrame
    errors: DataFrame
    first_error: str | None


def stage_rows(spark: SparkSession, out: str) -> DataFrame:
    """The frames that a stage has done."""
    return Table(spark, out).read().where("not failed").drop(ERROR, "attempt", "failed")


def run_stage(frames: DataFrame, out: str, process: Callable[[DataFrame], DataFrame], idx: str = "idx", retries: int = 1) -> Stage:
    """Frames of a stage processed into the table at `out`; what is there already is not done again.

    `process` gives the frames that are done and, if it is made by `captured`, those that failed: both are written in one
    pass. What is missing then, failed or left out, is tried anew up to `retries` times, and nothing else. Passes add
    versions, so that whatever stops one costs no finished pass.
    """
    spark, table = frames.sparkSession, Table(frames.sparkSession, out, partition_by=("failed",))
    before = table.latest()

    def left() -> DataFrame:
        # what is done is nearly everything: by size on disk it may look small enough for the driver to send it to all tasks
        return frames.join(stage_rows(spark, out).select(idx).distinct().hint("merge"), idx, "left_anti") if table.exists() else frames

    for attempt in range(1 + retries):
        todo = left()
        if attempt and todo.isEmpty():
            break
        rows = process(todo)
        rows = rows if ERROR in rows.columns else rows.withColumn(ERROR, F.lit(None).cast("string"))
        table.append(rows.withColumn("attempt", F.lit(before + attempt)).withColumn("failed", F.col(ERROR).isNotNull()))
    missing = left().select(idx)
    errors = table.read().where("failed").where(F.col("attempt") >= before).select(idx, (F.col("attempt") - before).alias("attempt"), F.col(ERROR).alias("error"))
    if missing.isEmpty():
        return Stage("COMPLETED", stage_rows(spark, out), missing, errors, None)
    first = errors.agg(F.min_by("error", F.struct("attempt", idx))).first()[0]
    return Stage("FAILED", stage_rows(spark, out), missing, errors, first)


def failure_text(name: str, stage: Stage, idx: str = "idx") -> str:
    """One line on why a stage failed: how many frames are missing, the first of them, the first error."""
    n, some = stage.missing.count(), [str(r[0]) for r in stage.missing.orderBy(idx).limit(NAMED).collect()]
    more = f", +{n - len(some)} more" if n > len(some) else ""
    return f"stage {name}: {n} frames missing ({', '.join(some)}{more})" + (f"; first error: {stage.first_error}" if stage.first_error else "")


EVENTS = "event string, fingerprint string, stage long, message string"


class Journal:
    """Events of a job, each published under the next number, so that none is lost or replaced."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.files = spark, Files(spark, folder)

    def add(self, event: str, fingerprint: str, stage: int | None = None, message: str | None = None) -> None:
        text = json.dumps({"event": event, "fingerprint": fingerprint, "stage": stage, "message": message})
        at = 1 + max([int(n[:10]) for n in self.files.names("events") if n.endswith(".json") and not n.startswith(".")], default=0)
        while not self.files.publish(text, "events", f"{at:010d}.json"):
            at += 1

    def events(self) -> DataFrame:
        """seq and what `add` was told."""
        if not any(n.endswith(".json") for n in self.files.names("events")):
            return self.spark.createDataFrame([], "seq long, " + EVENTS)
        number = F.regexp_extract("_metadata.file_name", r"^(\d+)\.json$", 1).cast("long")
        return self.spark.read.schema(EVENTS).json(f"{self.files.root}/events").select(number.alias("seq"), *[f.split()[0] for f in EVENTS.split(", ")])


def folded_jobs(events: DataFrame, *key: str) -> DataFrame:
    """key, status, fingerprint, completed_stages, packaged, cleaned, message of each job, by its events (seq and others).

    A job's events of another fingerprint than its last one don't count: its frames were made of something else. Status is
    the last of RUNNING, PAUSED, CANCELLED, FAILED and COMPLETED; a cancelled job has nothing done. Cleaned are the stages
    whose tables are gone.
    """
    e = events.join(events.groupBy(*key).agg(F.max_by("fingerprint", "seq").alias("fingerprint")), [*key, "fingerprint"]) if key else events.crossJoin(
        F.broadcast(events.agg(F.max_by("fingerprint", "seq").alias("_now")))).where("fingerprint = _now").drop("_now")
    kind = F.col("event")
    cancelled = F.max(F.when(kind == "CANCELLED", F.col("seq")))
    last = e.groupBy(*key, "fingerprint").agg(cancelled.alias("_cancelled"))
    e = (e.join(last, [*key, "fingerprint"]) if key else e.join(last, "fingerprint")).where("_cancelled is null or seq >= _cancelled")
    state = kind.isin("RUNNING", "PAUSED", "CANCELLED", "FAILED", "COMPLETED")
    return e.groupBy(*key, "fingerprint").agg(
        F.max_by(F.when(state, kind), F.when(state, F.col("seq"))).alias("status"),
        F.coalesce(F.max(F.when(kind == "stage", F.col("stage"))), F.lit(0)).alias("completed_stages"),
        F.coalesce(F.max(kind == "packaged"), F.lit(False)).alias("packaged"),
        F.array_sort(F.collect_set(F.when(kind == "cleaned", F.col("stage")))).alias("cleaned"),
        F.max_by(F.when(state, F.col("message")), F.when(state, F.col("seq"))).alias("message"))


def run_job(spark: SparkSession, frames: DataFrame, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]], folder: str, cleanup: str = "KEEP",
            fingerprint: str = "", package: Callable[[DataFrame], None] | None = None, idx: str = "idx", asked: Callable[[], str | None] = lambda: None) -> str:
    """The status of a job after its stages ran, each on the frames of the one before, and its output was packaged.

    A job that was stopped goes on where its journal says: stages that are complete are passed over (with AUTO also those
    whose tables are gone since), packaging is done once. Events of another `fingerprint` don't count, and its frames lie
    in folders of their own. A stage with frames missing fails the job and leaves all tables. `package` gets the last
    stage's frames; without it they become the table `output` in `folder`. KEEP leaves the stages' tables; AUTO drops each
    once the next stage is complete, DROP_AT_END none before; after packaging both drop all. `asked` is looked at before
    each stage: PAUSED stops there, CANCELLED drops all that was done.
    """
    if cleanup not in CLEANUP:
        raise ValueError(cleanup)
    journal, files = Journal(spark, folder), Files(spark, folder)
    mark = hashlib.sha1(fingerprint.encode()).hexdigest()[:12]
    names = [f"{mark}-stage{i}-{name}" for i, (name, _) in enumerate(stages)]
    journal.add("RUNNING", fingerprint)
    state = folded_jobs(journal.events()).first()
    done = state.completed_stages

    def drop(i: int) -> None:
        if names[i] in files.names("stages"):
            files.delete("stages", names[i])
            journal.add("cleaned", fingerprint, i)

    def ended(status: str, message: str | None = None) -> str:
        journal.add(status, fingerprint, message=message)
        return status

    if not state.packaged:
        rows = frames
        for i, (name, process) in enumerate(stages):
            want = asked()
            if want == "CANCELLED":
                files.delete("stages")
                return ended(want)
            if want == "PAUSED":
                return ended(want)
            path = f"{files.root}/stages/{names[i]}"
            if i < done and (cleanup == "AUTO" or names[i] in files.names("stages")):
                rows = stage_rows(spark, path) if names[i] in files.names("stages") else None
            else:
                if rows is None:
                    return ended("FAILED", "tables of earlier stages are gone")
                stage = run_stage(rows, path, process, idx)
                if stage.status == "FAILED":
                    return ended("FAILED", failure_text(name, stage, idx))
                rows = stage.rows
                journal.add("stage", fingerprint, i + 1)
            if cleanup == "AUTO" and i:
                drop(i - 1)
        if rows is None:
            return ended("FAILED", "tables of the last stage are gone")
        (package or Table(spark, f"{files.root}/output").replace)(rows)
        journal.add("packaged", fingerprint)
    if cleanup != "KEEP":
        for i in range(len(stages)):
            drop(i)
    return ended("COMPLETED")
