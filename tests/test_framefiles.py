"""Folders of frame files as a source and sink: what is read, what a failed write leaves, streams that restart."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from framequarry.sources import framefiles, frames


def pictures(spark, n, start=0):
    i = F.col("id")
    return spark.range(start, start + n, numPartitions=3).select(i.alias("frame_index"), F.concat(F.lit("frame"), i.cast("string")).cast("binary").alias("payload"))


def names(path) -> list[str]:
    return sorted(p.name for p in path.iterdir() if not p.name.startswith(("_", ".staging")))


def rows_read(df) -> int:
    """Rows that the scan itself gave."""
    df.sparkSession.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        q = df._jdf.queryExecution()
        q.executedPlan().executeCollect()
        leaf = q.executedPlan().collectLeaves().head()
        return leaf.metrics().get("numOutputRows").get().value()
    finally:
        df.sparkSession.conf.set("spark.sql.adaptive.enabled", "true")


def plan_text(df) -> str:
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


@pytest.mark.parametrize(("where", "want"), [
    ("frame_index > 10 and frame_index <= 20", 10), ("frame_index in (3, 5, 99, 1000)", 3), ("frame_index = 7", 1), ("frame_index >= 95", 5), ("frame_index < 0", 0),
    ("frame_index in (1, 2, 3) and frame_index < 3", 2), ("frame_index <=> 4", 1), ("frame_index between 40 and 10", 0), ("frame_index in (2, null)", 1)])
def test_pushed_filters(spark, tmp_path, where, want):
    """Only the frames that filters leave are read, and the plan says so."""
    frames.write_files(pictures(spark, 100), str(tmp_path / "f"))
    read = lambda: frames.frame_files(spark, str(tmp_path / "f"), where=where)
    assert sorted(r.frame_index for r in read().collect()) == sorted(r.frame_index for r in pictures(spark, 100).where(where).collect())
    assert rows_read(read()) == want
    if "null" not in where and want:
        assert "frame_index" in plan_text(read()).split("PushedFilters", 1)[1]
    assert rows_read(frames.video(spark, "synthetic", where, frames=100, width=2, height=1)) == want


def test_scans_keep_their_filters(spark, tmp_path):
    """Two scans of one folder, and filters that come later in one of two branches, don't mix."""
    frames.write_files(pictures(spark, 50), str(tmp_path / "f"))
    f = lambda where=None: frames.frame_files(spark, str(tmp_path / "f"), where=where).select("frame_index")
    ids = lambda d: sorted(r.frame_index for r in d.collect())
    assert ids(f("frame_index < 3").unionAll(f("frame_index > 47"))) == [0, 1, 2, 48, 49]
    one = f("frame_index < 10")
    assert ids(one.where("frame_index < 2").unionAll(one.where("frame_index in (7, 30)"))) == [0, 1, 7]
    every = f()
    assert ids(every.where("frame_index < 2").unionAll(every.where("frame_index = 30"))) == [0, 1, 30]


def test_filters_left_to_spark(spark, tmp_path):
    """What no range tells is asked of every frame; gaps and empty files are no frames."""
    frames.write_files(pictures(spark, 50).where("frame_index % 10 > 0"), str(tmp_path / "f"))
    (tmp_path / "f" / "00000020.png").write_bytes(b"")
    (tmp_path / "f" / "other.txt").write_text("x")
    d = frames.frame_files(spark, str(tmp_path / "f"))
    assert d.count() == 45 and d.where("length > 6").count() == 36 and d.where("frame_index > 10 or length = 6").count() == 45
    assert rows_read(d.where("frame_index % 2 = 0")) == 45
    known = frames.frame_files(spark, str(tmp_path / "f"), frames=30, ranges=4)
    assert known.count() == 27 and known.rdd.getNumPartitions() == 4 and known.where("frame_index = 40").count() == 0
    assert bytes(d.where("frame_index = 7").first().payload) == b"frame7"
    assert frames.frame_files(spark, str(tmp_path / "none")).count() == 0


def test_failed_write_leaves_nothing(spark, tmp_path):
    """A task that fails half way, and the tasks that were done before it, leave no file; what was there stays."""
    path = str(tmp_path / "f")
    frames.write_files(pictures(spark, 5, start=1000), path)
    before = names(tmp_path / "f")
    bad = pictures(spark, 60).withColumn("payload", F.when(F.col("frame_index") == 55, F.raise_error(F.lit("no picture")).cast("binary")).otherwise(F.col("payload")))
    with pytest.raises(Exception, match="no picture"):
        frames.write_files(bad, path)
    assert names(tmp_path / "f") == before
    frames.write_files(pictures(spark, 8), path)
    frames.write_files(pictures(spark, 3), path, mode="overwrite")
    assert names(tmp_path / "f") == ["00000000.png", "00000001.png", "00000002.png"]
    frames.copy_files(spark, path, str(tmp_path / "g"))
    assert names(tmp_path / "g") == names(tmp_path / "f")
    assert frames.package(pictures(spark, 2), str(tmp_path / "a.b" / "clip.mp4"), True) == (str(tmp_path / "a.b" / "clip"), "no encoder: frames instead")
    assert frames.package(pictures(spark, 2), str(tmp_path / "frames"), False) == (str(tmp_path / "frames"), None)
    made = []
    assert frames.package(pictures(spark, 2), "x.mp4", True, encode=lambda f, o: made.append((f.count(), o))) == ("x.mp4", None) and made == [(2, "x.mp4")]


def streamed(spark, tmp_path, name, **options) -> list[int]:
    """One run until nothing is new; the numbers that all runs have delivered so far, in order."""
    frames.register(spark)
    s = spark.readStream.format("frames").options(path=str(tmp_path / "in"), **options).load().select("frame_index")
    q = s.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(once=True).start()
    assert q.awaitTermination(120)
    return sorted(r.frame_index for r in spark.read.parquet(str(tmp_path / name)).collect())


def test_stream_restarts(spark, tmp_path):
    """Each frame once, or only the newest of each trigger: after a restart too, nothing is repeated or passed over."""
    source = str(tmp_path / "in")
    frames.write_files(pictures(spark, 10), source)
    assert streamed(spark, tmp_path, "all", ranges="3") == list(range(10))
    assert streamed(spark, tmp_path, "newest", latest="true") == [9]
    frames.write_files(pictures(spark, 5, start=10), source)
    assert streamed(spark, tmp_path, "all", ranges="3") == list(range(15))
    assert streamed(spark, tmp_path, "newest", latest="true") == [9, 14]
    assert streamed(spark, tmp_path, "newest", latest="true") == [9, 14]


def test_latest_frame_sink(spark, tmp_path, monkeypatch):
    """The newest frame, one encoding for each version; a batch that is played again changes nothing."""
    calls = []
    monkeypatch.setitem(framefiles.ENCODERS, "loud", lambda b: calls.append(b) or b.upper())
    w = framefiles.LatestWriter({"path": str(tmp_path / "o"), "ext": "jpg", "encoder": "loud"})
    row = lambda i: framefiles.Newest(i, b"f%d" % i)
    told = lambda: json.loads((tmp_path / "o" / "latest.json").read_text())
    w.commit([row(3), None, row(5)], 0)
    assert told() == {"version": 1, "batch": 0, "frame_index": 5, "file": "frame-1.jpg"} and (tmp_path / "o" / "frame-1.jpg").read_bytes() == b"F5"
    w.commit([row(9)], 0)
    assert told()["frame_index"] == 5
    w.commit([row(4)], 1), w.commit([None], 2)
    assert told() == {"version": 1, "batch": 2, "frame_index": 5, "file": "frame-1.jpg"} and calls == [b"f5"]
    w.commit([row(6)], 3)
    assert told()["version"] == 2 and names(tmp_path / "o") == [".latest.tmp", "frame-2.jpg", "latest.json"] or names(tmp_path / "o") == ["frame-2.jpg", "latest.json"]
    frames.register(spark)
    frames.write_files(pictures(spark, 4), str(tmp_path / "in"))
    s = spark.readStream.format("frames").options(path=str(tmp_path / "in")).load()
    q = s.writeStream.format("latest_frame").options(path=str(tmp_path / "p"), ext="bin").option("checkpointLocation", str(tmp_path / "state")).trigger(once=True).start()
    assert q.awaitTermination(120) and json.loads((tmp_path / "p" / "latest.json").read_text())["frame_index"] == 3
    assert (tmp_path / "p" / "frame-1.bin").read_bytes() == b"frame3"


def test_moves_of_tasks(spark, tmp_path):
    """A job that is told a name for staging only tells its folders; tasks move them, and what an attempt before did stays done."""
    frames.register(spark)
    path = str(tmp_path / "f")
    pictures(spark, 30).select("frame_index", F.length("payload").cast("long").alias("length"), "payload").write.format("frames").options(path=path, staging=".staging-x").mode("append").save()
    own = framefiles.whole(path, ".staging-x")
    assert len(own) == 3 and names(tmp_path / "f") == []
    first = next((tmp_path / "f" / ".staging-x").glob("*/*/*.png"))
    first.rename(tmp_path / "f" / first.name)
    assert sorted(i for folder in own for i in framefiles.moved(path, folder)) == sorted(set(range(30)) - {int(first.stem)})
    assert names(tmp_path / "f") == [f"{i:08d}.png" for i in range(30)]
    framefiles.tidy(path, ".staging-x")
    frames.write_files(pictures(spark, 40), path)
    assert sorted(p.name for p in (tmp_path / "f").iterdir()) == [f"{i:08d}.png" for i in range(40)]


def test_listed_by_tasks(spark, tmp_path):
    """Each file is listed by one task of several; hidden and empty ones are passed over as Spark's own reader does."""
    for n in ("1.png", "sub/2.PNG", "sub/_3.png", ".4.png", "_no/5.png", "6.txt", "sub/a b.jpg", "7.png"):
        (tmp_path / "f" / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "f" / n).write_bytes(b"" if n == "7.png" else b"xy")
    path = str(tmp_path / "f")
    got = frames.scan(spark, path, ("png", "jpg"))
    assert got.rdd.getNumPartitions() > 1 and frames.cached(spark, path).rdd.getNumPartitions() > 1
    own = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{png,PNG,jpg}").load(path)
    rows = lambda d, time: sorted(map(tuple, d.select("path", "length", time).collect()))
    assert rows(got, "mtime") == rows(own, "modificationTime") and got.count() == 3
    assert sorted(r.frame_index for r in frames.cached(spark, path).collect()) == [1, 6, 7]


def test_many_single_frames(tmp_path):
    """Frames with gaps between them are told to tasks in 16 bytes each, and to more tasks as they become more."""
    import pickle

    import numpy as np

    parts = framefiles.dealt(framefiles.together(np.arange(0, 1_400_000, 7)), None)
    assert len(parts) == 10 and sum(len(pickle.dumps(p)) for p in parts) < 3_300_000
    assert [i for p in parts for i in p.frames()] == list(range(0, 1_400_000, 7))
    few = framefiles.dealt((np.array([3, 10]), np.array([6, 14])), 3)
    assert [list(p.frames()) for p in few] == [[3, 4, 5], [10, 11, 12], [13]]
    assert framefiles.dealt(framefiles.together(np.empty(0, np.int64)), None) == []
