"""Throttling over streams: the batch fold's rows in every split, after a restart, and with state that goes by timers."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from framequarry.streaming import policies


@pytest.mark.parametrize("parts", [2, 5])
def test_throttle_stream(spark, tmp_path, parts):
    rng = random.Random(parts)
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = sorted((start + timedelta(seconds=rng.randrange(4000), microseconds=rng.randrange(10**6)), rng.randrange(4)) for _ in range(400))
    rows = [(k, t) for t, k in rows]
    schema = "k long, t timestamp"
    cut = [len(rows) * i // parts for i in range(parts + 1)]
    for a, b in zip(cut[:-1], cut[1:]):  # each part is a run of its own, so every one but the first is a restart
        spark.createDataFrame(rows[a:b], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = policies.throttle_stream(stream, "k", "t", 90.0).writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
            "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert q.awaitTermination(180)
    us = lambda d: sorted((r.k, r.us) for r in d.select("k", F.unix_micros("t").alias("us")).collect())
    whole = spark.createDataFrame(rows, schema).select("k", F.unix_micros("t").alias("us"))
    want = sorted((r.k, r.us) for r in policies.throttle(whole, "k", "us", 90.0).collect())
    assert us(spark.read.parquet(str(tmp_path / "out"))) == want and 40 < len(want) < 400
