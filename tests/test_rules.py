"""Expected values of the blueprint's fixtures, on literal rows."""

from __future__ import annotations

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from framequarry.functions import scalars as S
from framequarry.operators import stages, sections, storage
from framequarry.sources import frames
from framequarry.streaming import policies


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


@pytest.mark.parametrize(("pairs", "want"), [
    ([], []), ([(120, 50)], [(50, 120)]), ([(180, 240), (50, 120)], [(50, 120), (180, 240)]), ([(50, 120), (100, 200)], [(50, 200)]),
    ([(50, 120), (121, 180)], [(50, 180)]), ([(50, 120), (122, 180)], [(50, 120), (122, 180)]), ([(-10, 30)], [(0, 30)]), ([(-10, -5), (10, 20)], [(10, 20)]),
])
def test_sections(spark, pairs, want):
    got = sections.canonical(spark.createDataFrame(pairs, "start long, end long"))
    assert sorted((r["start"], r["end"]) for r in got.collect()) == want


def test_head_start(spark):
    dense = [(300, 30, 30, 0), (300, 60, 30, 0), (300, 10, 30, 200), (300, 15, 30, 150), (10, 11, 30, 7), (300, 0, 30, 300), (300, 10, 0, 300), (0, 10, 30, 0)]
    df = spark.createDataFrame([tuple(map(float, x)) for x in dense], "n double, rate double, fps double, want double")
    assert all(r.got == r.want for r in df.select(S.required_prefill(F.col("n"), F.col("rate"), F.col("fps")).alias("got"), "want").collect())
    sparse = [(30, 10, 2.5, 75), (30, 10, 2, 60), (30, 2, 2, 60), (30, 30, 2.5, 0), (25, 10, 2.5, 63), (30, 0, 2, 60), (0, 10, 2.5, 0), (30, 10, 0, 0)]
    df = spark.createDataFrame([tuple(map(float, x)) for x in sparse], "fps double, rate double, cushion double, want double")
    assert all(r.got == r.want for r in df.select(S.sparse_prefill(F.col("fps"), F.col("rate"), F.col("cushion")).alias("got"), "want").collect())


@pytest.mark.parametrize(("rows", "cap", "gone"), [
    ([("old", 10_000, 1, False), ("new", 10_000, 2, False)], 15_000, ["old"]), ([("old", 10_000, 1, False)], 0, []),
    ([("a", 10_000, 1, True), ("b", 10_000, 2, True)], 5, []), ([("p", 50_000, 1, True), ("old", 1_000, 2, False)], 5_000, []),
    ([("p", 10_000, 0, True), ("old", 10_000, 1, False), ("new", 10_000, 2, False)], 15_000, ["old"]),
])
def test_eviction(spark, rows, cap, gone):
    e = spark.createDataFrame(rows, "path string, size long, used long, keep boolean")
    assert [r.path for r in storage.evict_to_cap(e, cap, "size", "used", "path", "keep").collect()] == gone


def tick(**x):
    return SimpleNamespace(**({"seq": 0, "target": 0, "last_submitted": 0, "last_completed": 0, "read_latency_ms": None, "process_fps": 10.0, "workers": 1, "outstanding": 0} | x))


def test_strategies():
    assert policies.synced()(policies.START, tick(target=200, last_submitted=10, last_completed=0, read_latency_ms=120.0))[1] == 11
    p = policies.predictive()
    assert p(policies.START, tick(last_submitted=-1, last_completed=-1))[1] == 0
    assert p(policies.START, tick(outstanding=2))[1] is None
    assert p(policies.START, tick(target=100, last_completed=90))[1] == 106
    assert p(policies.START, tick(target=100, last_completed=90, workers=4))[1] == 124
    assert policies.predictive(max_lead_seconds=0.1)(policies.START, tick(target=100, last_completed=90))[1] == 103
    b = policies.buffering()
    assert b(policies.START, tick(last_submitted=9, workers=4))[1] == 12
    assert b(policies.START, tick(last_submitted=5, process_fps=None, workers=4))[1] == 6
    assert b(policies.START, tick(outstanding=8, workers=4))[1] is None


def test_shortfall(spark):
    assert one(spark, S.shortfall_fails(F.lit(10), F.lit(8), F.lit(30.0)), S.shortfall_fails(F.lit(100), F.lit(10), F.lit(30.0))) == (False, True)


def test_stage_resumes(spark, tmp_path):
    """A stage that lost part of its frames only does the missing ones, and each once."""
    stage = str(tmp_path / "stage")
    todo = spark.range(10).select(F.col("id").alias("idx"))
    stages.run_stage(todo.where("idx < 4"), stage, lambda x: x)
    done = stages.run_stage(todo, stage, lambda x: x.where("idx <> 7"))
    assert done.status == "FAILED" and done.first_error is None and [r.idx for r in done.missing.collect()] == [7]
    assert sorted(r.idx for r in done.rows.collect()) == [0, 1, 2, 3, 4, 5, 6, 8, 9]


def test_synthetic_video(spark):
    frames.register(spark)
    v = spark.read.format("synthetic_video").option("frames", 10).option("ranges", 3).load()
    assert sorted(r.frame_index for r in v.select("frame_index").collect()) == list(range(10))
    assert v.rdd.getNumPartitions() == 3


def test_streamed_replay_is_the_batch_replay(spark, tmp_path):
    rows = [(u, s, s * 3, s, max(-1, s - 5), 80.0 if s % 7 else 10.0, 10.0, 2, s % 5) for u in (1, 2) for s in range(60)]
    ticks = spark.createDataFrame(rows, "user_id long, " + ", ".join(f"{c} {'double' if c in ('read_latency_ms', 'process_fps') else 'long'}" for c in policies.TICK))
    for i in range(3):
        ticks.where(F.col("seq").between(20 * i, 20 * i + 19)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    policy = policies.synced(max_lag=30)
    stream = spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = policies.replay_stream(stream, "user_id", policy).writeStream.format("memory").queryName("replayed").option(
        "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    key = lambda df: sorted((r.user_id, r.seq, r.next_frame, r.mode) for r in df.collect())
    assert key(spark.table("replayed")) == key(policies.replay(ticks, "user_id", policy))
