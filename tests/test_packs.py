"""Folders of frames in packs: what they take, what is read, added and copied, what a failed write leaves."""

from __future__ import annotations

import uuid
import zipfile

import pytest
from pyspark.sql import functions as F

from framequarry.sources import framefiles, frames
from test_framefiles import names, pictures, rows_read


@pytest.fixture(autouse=True)
def small_packs(monkeypatch):
    monkeypatch.setattr(frames, "PACK_FRAMES", 10)


def contents(spark, path, where=None) -> dict[int, bytes]:
    rows = frames.frame_files(spark, str(path), where=where).collect()
    assert len({r.frame_index for r in rows}) == len(rows) and all(r.length == len(r.payload) for r in rows)
    return {r.frame_index: bytes(r.payload) for r in rows}


def test_packaged_frames_share_files(spark, tmp_path):
    """A package and its copy hold all frames in a few files, not one for each; a copied pack is the same bytes."""
    folder, _ = frames.package(pictures(spark, 95), str(tmp_path / "clip.mp4"), video=True, pack=True)
    frames.copy_files(spark, folder, str(tmp_path / "copy"))
    want = [".packs", *(f"{k:08d}-{k + 9:08d}.png.zip" for k in range(0, 100, 10))]
    assert names(tmp_path / "clip") == want == names(tmp_path / "copy")
    assert all((tmp_path / "clip" / n).read_bytes() == (tmp_path / "copy" / n).read_bytes() for n in want)
    assert contents(spark, tmp_path / "copy") == {i: b"frame%d" % i for i in range(95)}
    with zipfile.ZipFile(tmp_path / "copy" / want[-1]) as z:
        assert z.namelist() == [f"{i:08d}.png" for i in range(90, 95)] and z.read("00000093.png") == b"frame93" and z.testzip() is None


def test_packs_grow(spark, tmp_path):
    """Frames are added to packs and replaced in them; what isn't written again stays; empty ones are no frames."""
    path = str(tmp_path / "f")
    frames.write_files(pictures(spark, 40).where("frame_index % 3 = 0"), path, pack=True)
    new = pictures(spark, 25).where("frame_index % 2 = 0").withColumn("payload", F.when(F.col("frame_index") == 8, b"").otherwise(F.lit(b"new")))
    frames.write_files(new, path)  # the folder's form goes on
    want = {i: b"frame%d" % i for i in range(0, 40, 3)} | {i: b"new" for i in range(0, 25, 2) if i != 8}
    assert contents(spark, path) == want
    other = str(tmp_path / "g")
    frames.write_files(pictures(spark, 12, start=5), other, pack=True)
    frames.copy_files(spark, path, other)
    assert contents(spark, other) == {i: b"frame%d" % i for i in range(5, 17)} | {k: v for k, v in want.items() if k != 8}
    frames.write_files(pictures(spark, 3, start=20), path, mode="overwrite")
    assert contents(spark, path) == {i: b"frame%d" % i for i in (20, 21, 22)} and names(tmp_path / "f") == [".packs", "00000020-00000029.png.zip"]


def test_forms_dont_mix(spark, tmp_path):
    one, packed = str(tmp_path / "one"), str(tmp_path / "packed")
    frames.write_files(pictures(spark, 5), one)
    frames.write_files(pictures(spark, 5), packed, pack=True)
    for write in (lambda: frames.write_files(pictures(spark, 5), one, pack=True), lambda: frames.write_files(pictures(spark, 5), packed, pack=False),
                  lambda: frames.copy_files(spark, packed, one)):
        with pytest.raises(Exception, match="holds"):
            write()
    assert len(names(tmp_path / "one")) == 5 and len(names(tmp_path / "packed")) == 2
    frames.copy_files(spark, one, packed)
    assert contents(spark, packed) == contents(spark, one)


def test_failed_packs_leave_nothing(spark, tmp_path):
    """Neither a task that fails, nor rows out of order, nor a pack in two tasks change what was there."""
    path = str(tmp_path / "f")
    frames.write_files(pictures(spark, 5), path, pack=True)
    before = {n: (tmp_path / "f" / n).read_bytes() for n in names(tmp_path / "f")}
    bad = pictures(spark, 60).withColumn("payload", F.when(F.col("frame_index") == 55, F.raise_error(F.lit("no picture")).cast("binary")).otherwise(F.col("payload")))
    rows = pictures(spark, 30).withColumn("length", F.length("payload").cast("long")).select("frame_index", "length", "payload")
    straight = lambda d: d.write.format("frames").options(path=path, pack=10).mode("append").save()
    for write, why in ((lambda: frames.write_files(bad, path), "no picture"), (lambda: straight(rows.coalesce(1).orderBy(F.desc("frame_index"))), "in order"),
                       (lambda: straight(rows.withColumn("frame_index", -F.col("frame_index"))), "in order"), (lambda: straight(rows.where("frame_index between 8 and 11").union(rows.where("frame_index = 9"))), "several tasks")):
        with pytest.raises(Exception, match=why):
            write()
        assert {n: (tmp_path / "f" / n).read_bytes() for n in names(tmp_path / "f")} == before
        assert not list((tmp_path / "f").glob(".staging*"))


@pytest.mark.parametrize("where", ["frame_index > 10 and frame_index <= 20", "frame_index in (3, 5, 99, 1000)", "frame_index = 7", "frame_index >= 95", "frame_index < 0",
                                   "frame_index in (1, 2, 3) and frame_index < 3", "frame_index between 8 and 41"])
def test_pushed_filters_in_packs(spark, tmp_path, where):
    """Of packs too only frames that filters leave are read, each pack once for a task."""
    path = str(tmp_path / "f")
    some = pictures(spark, 100).where("frame_index % 10 != 4")
    frames.write_files(some, path, pack=True)
    want = {r.frame_index: bytes(r.payload) for r in some.where(where).collect()}
    assert contents(spark, path, where) == want and rows_read(frames.frame_files(spark, path, where=where)) == len(want)
    assert len(frames.frame_files(spark, path, frames=30, ranges=4).collect()) == 27


def test_damaged_pack_is_told(spark, tmp_path):
    frames.write_files(pictures(spark, 5), str(tmp_path / "f"), pack=True)
    pack = tmp_path / "f" / "00000000-00000009.png.zip"
    pack.write_bytes(pack.read_bytes().replace(b"frame3", b"frameX"))
    with pytest.raises(Exception, match="BadZipFile"):
        contents(spark, tmp_path / "f")


def test_stream_of_packs(tmp_path, spark):
    """Offsets follow the newest frame of the last pack."""
    path = str(tmp_path / "f")
    frames.write_files(pictures(spark, 13), path, pack=True)
    reader = framefiles._StreamReader({"path": path})
    assert reader.latestOffset() == {"next": 13}
    frames.write_files(pictures(spark, 4, start=13), path)
    assert reader.latestOffset() == {"next": 17}
    got = [i for p in reader.partitions({"next": 9}, {"next": 17}) for b in reader.read(p) for i in b.column("frame_index").to_pylist()]
    assert got == list(range(9, 17))


def files_of(spark, tmp_path, monkeypatch, query) -> tuple[int, int]:
    """(rows of a query over the smallest tables, files in the folders that it makes)"""
    import __spark_entry__ as entry
    from framequarry.plans import job_queries

    monkeypatch.setattr(job_queries, "scratch", lambda spark, name: f"file://{tmp_path}/{name}-{uuid.uuid4().hex}")
    n = entry.queries()[query](spark, entry.SMALL).count()
    return n, sum(p.is_file() for p in tmp_path.rglob("*"))


def test_frame_ranges_files(spark, tmp_path, monkeypatch):
    """A thousand frames in packs of ten, and those of them that are copied."""
    n, files = files_of(spark, tmp_path, monkeypatch, "frame_ranges")
    assert n == 167 + 5 + 143 and files <= 2 * (100 + 1)


def test_frame_files_files(spark, tmp_path, monkeypatch):
    """A thousand frames in packs of ten, listed one by one."""
    n, files = files_of(spark, tmp_path, monkeypatch, "frame_files")
    assert n == 1000 and files <= 101


def test_listed_in_packs(spark, tmp_path):
    """Frames in packs are listed as those beside packs are: by name, with lengths, empty ones only where they are asked for."""
    some = pictures(spark, 25).withColumn("payload", F.when(F.col("frame_index") == 8, b"").otherwise(F.col("payload")))
    frames.write_files(some, str(tmp_path / "a" / "b"), pack=True)
    frames.write_files(pictures(spark, 3, start=100), str(tmp_path / "a" / "b"), ext="JPG")
    frames.write_files(pictures(spark, 3, start=200), str(tmp_path / "a"))
    (tmp_path / "a" / "00000000-00000009.png.zip").write_bytes(b"no pack: its folder holds single files")
    rows = frames.scan(spark, str(tmp_path), (".png",)).collect()
    number = lambda r: int(r.path.rsplit("/", 1)[1].split(".")[0])
    assert sorted(map(number, rows)) == [*(i for i in range(25) if i != 8), 200, 201, 202] and {(r.ext, r.kind) for r in rows} == {("png", "image")}
    assert all(r.length == len(f"frame{number(r)}") for r in rows)
    pack = tmp_path / "a" / "b" / "00000010-00000019.png.zip"
    assert {int(r.mtime.timestamp() * 1000) for r in rows if f"{pack}!/" in r.path} == {pack.stat().st_mtime_ns // 1_000_000}
    assert sorted(map(number, frames.scan(spark, str(tmp_path), ("jpg",)).collect())) == [100, 101, 102]
    assert sorted(r.frame_index for r in frames.cached(spark, str(tmp_path / "a" / "b")).collect()) == [*range(25), 100, 101, 102]
