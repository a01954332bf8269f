"""Stages whose frames fail, and jobs that are stopped at every step."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from framequarry.operators import jobs, stages
from framequarry.operators.versions import Files, Table


def picky(bad=()):
    """A processor that fails on some frames; its class travels with it."""

    class Picky:
        def setup(self):
            self.bad = set(bad)

        def process(self, rows):
            rows["value"] = rows["value"] * 2  # in place: a batch that fails is tried anew from its own copy
            for i in rows["idx"]:
                if i in self.bad:
                    raise ValueError(f"frame {i}")
            return rows

        def release(self):
            pass

    return Picky()


def frames(spark, n=1000):
    return spark.range(n, numPartitions=3).select(F.col("id").alias("idx"), (F.col("id") + 2**53).alias("value"), F.lit("x").alias("note"))


def test_three_poisoned_frames(spark, tmp_path):
    """All other frames are done in one pass, large numbers stay exact, and the first cause is told."""
    bad = [3, 500, 999]
    stage = stages.run_stage(frames(spark), str(tmp_path / "s"), lambda x: stages.captured(x, [picky(bad)]))
    assert stage.status == "FAILED" and sorted(r.idx for r in stage.missing.collect()) == bad
    assert stage.rows.where("value <> (idx + 9007199254740992L) * 2").isEmpty() and stage.rows.count() == 997 and stage.rows.columns == ["idx", "value", "note"]
    assert sorted(tuple(r) for r in stage.errors.collect()) == sorted((i, a, f"ValueError: frame {i}") for i in bad for a in (0, 1))
    assert stage.first_error == "ValueError: frame 3"
    assert stages.failure_text("picky", stage) == "stage picky: 3 frames missing (3, 500, 999); first error: ValueError: frame 3"
    # the frames that are left, and only these, are done by a later run
    seen = []
    again = stages.run_stage(frames(spark), str(tmp_path / "s"), lambda x: seen.append(x.count()) or stages.captured(x, [picky()]))
    assert again.status == "COMPLETED" and again.first_error is None and seen == [3] and again.rows.count() == 1000 and again.errors.count() == 0


def test_retry_of_what_failed(spark, tmp_path):
    """A frame that fails at first is done by the second pass; its error stays told, but isn't the stage's."""
    tries = []

    def process(x):
        tries.append(x.count())
        return stages.captured(x, [picky([7] if len(tries) == 1 else [])])

    stage = stages.run_stage(frames(spark, 50), str(tmp_path / "s"), process)
    assert stage.status == "COMPLETED" and tries == [50, 1] and stage.first_error is None
    assert [tuple(r) for r in stage.errors.collect()] == [(7, 0, "ValueError: frame 7")] and stage.rows.count() == 50


def test_all_fail_and_none(spark, tmp_path):
    stage = stages.run_stage(frames(spark, 20), str(tmp_path / "a"), lambda x: stages.captured(x, [picky(range(20))]), retries=0)
    assert stage.status == "FAILED" and stage.rows.count() == 0 and stage.errors.count() == 20
    assert stages.failure_text("s", stage) == "stage s: 20 frames missing (0, 1, 2, 3, 4, 5, 6, 7, +12 more); first error: ValueError: frame 0"
    stage = stages.run_stage(frames(spark, 0), str(tmp_path / "b"), lambda x: stages.captured(x, [picky()]))
    assert stage.status == "COMPLETED" and stage.rows.count() == 0


def work(add):
    return lambda x: x.withColumn("value", F.col("value") + add)


STAGES = [("one", work(1)), ("two", work(10))]


def outcome(spark, folder, cleanup, **more):
    status = stages.run_job(spark, frames(spark, 30), STAGES, str(folder), cleanup, **more)
    out = Table(spark, f"{folder}/output")
    rows = out.read().where("value <> idx + 9007199254740992L + 11").count() if out.exists() else None
    left = len(Files(spark, f"{folder}/stages").names())
    return status, rows, out.exists() and out.read().count(), left


@pytest.mark.parametrize(("cleanup", "left"), [("KEEP", 2), ("AUTO", 0), ("DROP_AT_END", 0)])
def test_job_killed_at_each_step(spark, tmp_path, monkeypatch, cleanup, left):
    """Whatever event a job dies at, before or after it is written down, the next run ends as if nothing had happened."""
    real, steps = stages.Journal.add, []
    monkeypatch.setattr(stages.Journal, "add", lambda self, event, *a, **k: (steps.append(event), real(self, event, *a, **k)))
    assert outcome(spark, tmp_path / "whole", cleanup) == ("COMPLETED", 0, 30, left)
    total = len(steps)
    assert total == {"KEEP": 5, "AUTO": 7, "DROP_AT_END": 7}[cleanup]
    for kill in range(total) if cleanup == "AUTO" else (total - 3, total - 1):
        for written in (False,) if kill % 2 else (True,):
            n = iter(range(99))

            def dies(self, event, *a, n=n, kill=kill, written=written, **k):
                if next(n) == kill:
                    if written:
                        real(self, event, *a, **k)
                    raise KeyboardInterrupt
                real(self, event, *a, **k)

            folder = tmp_path / f"{kill}-{written}"
            monkeypatch.setattr(stages.Journal, "add", dies)
            with pytest.raises(KeyboardInterrupt):
                outcome(spark, folder, cleanup)
            monkeypatch.setattr(stages.Journal, "add", real)
            assert outcome(spark, folder, cleanup) == ("COMPLETED", 0, 30, left), (kill, written)


def test_job_fails_pauses_cancels(spark, tmp_path):
    folder = str(tmp_path / "f")
    broken = [STAGES[0], ("bad", lambda x: stages.captured(x, [picky([4])]))]
    assert stages.run_job(spark, frames(spark, 30), broken, folder, "AUTO") == "FAILED"
    told = stages.folded_jobs(stages.Journal(spark, folder).events()).first()
    assert told.status == "FAILED" and told.completed_stages == 1 and told.message == "stage bad: 1 frames missing (4); first error: ValueError: frame 4"
    assert stages.run_job(spark, frames(spark, 30), [STAGES[0], ("bad", STAGES[1][1])], folder, "AUTO") == "COMPLETED"
    # another fingerprint: nothing of before counts
    assert stages.run_job(spark, frames(spark, 10), STAGES, folder, "KEEP", fingerprint="other") == "COMPLETED"
    assert Table(spark, folder + "/output").read().count() == 10
    paused = iter([None, "PAUSED"])
    folder = str(tmp_path / "p")
    assert stages.run_job(spark, frames(spark, 30), STAGES, folder, asked=lambda: next(paused)) == "PAUSED"
    seen = []
    todo = [("one", lambda x: seen.append(1) or work(1)(x)), STAGES[1]]
    assert stages.run_job(spark, frames(spark, 30), todo, folder, asked=lambda: None) == "COMPLETED" and not seen
    folder = str(tmp_path / "c")
    asked = iter([None, "CANCELLED"])
    assert stages.run_job(spark, frames(spark, 30), STAGES, folder, asked=lambda: next(asked)) == "CANCELLED"
    assert stages.folded_jobs(stages.Journal(spark, folder).events()).first().completed_stages == 0 and not Files(spark, folder).names("stages")
    assert stages.run_job(spark, frames(spark, 30), STAGES, folder) == "COMPLETED"
    with pytest.raises(ValueError):
        stages.run_job(spark, frames(spark, 1), STAGES, folder, "SOMETIMES")


def test_queue_states(spark):
    rows = lambda *x: spark.createDataFrame(x, "file string, status string, ended boolean, continue_on_error boolean")
    runnable = lambda *x: {r.file for r in jobs.queue_states(rows(*x)).where("runnable").collect()}
    rest = [("a", "PENDING", False, False), ("b", "PAUSED", False, False), ("c", "COMPLETED", True, False), ("d", "FAILED", False, False)]
    assert runnable(*rest) == {"a", "b"}
    assert runnable(*rest, ("e", "FAILED", True, True)) == {"a", "b"}
    for status in ("FAILED", "PAUSED", "CANCELLED"):
        assert runnable(*rest, ("e", status, True, False)) == set()
