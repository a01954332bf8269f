"""Queries over tables with larger keys, denser times and more rows than the test tables have."""

from __future__ import annotations

from framequarry import catalog


def events(spark, path, ids, **columns):
    """A table `events` with these ids; other columns as SQL over `id`."""
    rule = {"ts": "timestamp_seconds(id)", "user_id": "id % 3", "event_type": "'view'", "value": "id / 2D"} | columns
    spark.createDataFrame([(i,) for i in ids], "id long").selectExpr("id AS event_id", *[f"{v} AS {k}" for k, v in rule.items()]).write.mode("overwrite").parquet(f"{path}/events.parquet")
    return str(path)


def test_sizes_beyond_longs(spark, tmp_path):
    """The cube of an id may exceed 64 bits."""
    d = events(spark, tmp_path, [0, 10, 2_097_151, 2_097_152, 36_000_000])
    got = {r.event_id: (r.size, r.clock) for r in catalog.QUERIES["tick_and_text"](spark, d).collect()}
    text = lambda i: f"{i**3} B" if i**3 < 1024 else f"{i**3 / 1024**4:.1f} TB"
    assert got == {i: (text(i), f"{i * 37 // 3600}:{i * 37 // 60 % 60:02d}:{i * 37 % 60:02d}" if i * 37 >= 3600 else f"{i * 37 // 60}:{i * 37 % 60:02d}") for i in (0, 10, 2_097_151, 2_097_152, 36_000_000)}


def test_windows_cost_no_more_than_their_rows(spark):
    """Ends of windows of the last seconds against plain Python: with times in common, below 0 and null, null keys, times
    on a window's bounds; and no window slides over rows."""
    from pyspark.sql import functions as F

    from framequarry.operators import series

    rows = [(i, "ab"[i % 2] if i % 23 else None, None if i % 29 == 0 else (i * i * 37_001) % 9_000_000 // 250_000 * 250_000 - 3_000_000, i % 3 > 0) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, k string, us long, is_event boolean")
    for only in (False, True):
        at = F.when(F.col("is_event"), F.col("us")) if only else None
        got = {r.id: (r._n, r._first, r._last) for r in series.recent(df, ["k"], "us", 1.5, at).collect()}
        want = {}
        for i, k, us, _ in rows:
            near = [u for _, q, u, e in rows if q == k and us is not None and u is not None and us - 1_500_000 <= u <= us and (e or not only)]
            if us is None and not only:  # rows without a time are in each other's windows
                want[i] = (sum(q == k and u is None for _, q, u, _ in rows), None, None)
                continue
            want[i] = (len(near), min(near, default=None), max(near, default=None))
        assert got == want
    for d in (series.window_rate(df, ["k"]), series.rate_with_decay(df, ["k"])):
        assert "RangeFrame, -" not in d._jdf.queryExecution().optimizedPlan().toString() and d.count() == 400


def test_done_frames_stay_off_the_driver(spark, tmp_path):
    """What a stage has done is joined by a shuffle: it is never collected to be sent to all tasks."""
    from framequarry.operators import stages

    stage = stages.run_stage(spark.range(1_000).selectExpr("id AS idx"), str(tmp_path / "s"), lambda x: x.where("idx % 100 > 0"))
    assert stage.status == "FAILED" and stage.missing.count() == 10
    plan = stage.missing._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
