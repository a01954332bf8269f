"""Running sums and numbers over a global order, on wide tables and however Spark deals them out."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from framequarry.operators import playback, storage
from framequarry.plans import prefix


@pytest.fixture
def many_parts(spark):
    """Partitions that Spark coalesces by size, each branch of a plan alone."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def wide(spark, n: int, width: int = 200):
    i = F.col("id")
    return spark.range(n).select(
        i, (F.pmod(F.xxhash64(i), F.lit(5_000))).alias("age"), (1 + i % 7).alias("size"), F.repeat(F.sha2(i.cast("string"), 256), width // 64).alias("note"))


def test_wide_rows(spark, many_parts):
    """No row is lost or counted twice, in every range and at every border."""
    n = 300_000
    d = wide(spark, n)
    order = [F.col("age"), F.col("id")]
    got = prefix.numbered(d, order, "place", rows=20_000).select("place", "age", "id", F.length("note").alias("l"))
    r = got.agg(F.count("*"), F.countDistinct("place"), F.min("place"), F.max("place"), F.min("l")).first()
    assert tuple(r) == (n, n, 1, n, 192)
    assert got.join(got.select((F.col("place") - 1).alias("place"), F.struct("age", "id").alias("next")), "place").where(F.struct("age", "id") >= F.col("next")).isEmpty()


def test_evict_and_prune_wide(spark, many_parts, monkeypatch):
    monkeypatch.setattr(prefix, "RANGE_ROWS", 20_000)
    n = 300_000
    d = wide(spark, n)
    total = d.agg(F.sum("size")).first()[0]
    gone = storage.evict_to_cap(d, 100_000, "size", "age", "id")
    assert gone.columns == d.columns
    s = gone.agg(F.count("*"), F.countDistinct("id"), F.sum("size"), F.max(F.struct("age", "id"))).first()
    assert s[0] == s[1] and total - s[2] <= 100_000 < total - s[2] + 7
    assert d.where((F.col("age") < s[3].age) | ((F.col("age") == s[3].age) & (F.col("id") <= s[3].id))).count() == s[0]
    old = storage.prune_to_count(d, 50_000, "age", "id")
    assert old.count() == old.select("id").distinct().count() == n - 50_000


def test_ties_nulls_and_small(spark):
    rows = [(None, None, 1), (None, 2, 2), (1, None, 3), (1, 1, 4), (2, 0, 5)]
    d = spark.createDataFrame(rows, "a int, b int, v int")
    for n in (1, 2, 100):
        got = prefix.running_sum(d, "v", [F.col("a"), F.col("b")], "upto", rows=n).collect()
        assert {r.v: r.upto for r in got} == {1: 1, 2: 3, 3: 6, 4: 10, 5: 15}
    assert prefix.running_sum(d.limit(0), "v", [F.col("a")], "upto").count() == 0
    heavy = spark.range(1_000).select(F.lit(5).alias("a"), F.col("id"))
    assert prefix.numbered(heavy, [F.col("a"), F.col("id")], "n", rows=10).where("n <> id + 1").isEmpty()
    seen = playback.first_seen_numbers(spark.createDataFrame([("x", 1), ("y", 1), ("x", 0), (None, 0), ("z", 9)], "v string, t int"), "v", ["t"])
    assert {r.v: r.number for r in seen.collect()} == {"x": 0, "y": 1, "z": 2}
