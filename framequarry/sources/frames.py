"""Frames from folders, documents and a synthetic stream; and stores of frames as tables."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader

from ..functions import scalars as S
from ..operators.versions import Table
from .framefiles import (
    PACK_FRAMES, Bounds, FrameFiles, LatestFrame, ListedFiles, RangedReader, Ranges, copied, fits, mark, moved, pack_size, packs, tidy, whole,
)

FRAMES = "target_id string, frame_index bigint, height int, width int, payload binary"


def folder(spark: SparkSession, path: str, ext: str = "png", recursive: bool = False) -> DataFrame:
    """frame_index, path, length, mtime and content of files named by number; empty files are no frames."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{ext}").option("recursiveFileLookup", str(recursive).lower()).load(path)
    number = F.regexp_extract("path", r"(\d+)\.[^.]*$", 1)
    return f.where((F.col("length") > 0) & (number != "")).select(
        number.cast("long").alias("frame_index"), "path", "length", F.col("modificationTime").alias("mtime"), "content")


def single(spark: SparkSession, path: str) -> DataFrame:
    """One file as a stream of one frame."""
    return spark.read.format("binaryFile").load(path).limit(1).select(F.lit(0).cast("long").alias("frame_index"), "path", "length", F.col("modificationTime").alias("mtime"), "content")


def listing(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """path, length, mtime of files; contents are never read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path).select("path", "length", F.col("modificationTime").alias("mtime"))


def scan(spark: SparkSession, path: str, extensions: tuple[str, ...] | None = None) -> DataFrame:
    """path, length, mtime, ext, kind of media files under a folder; unreadable entries are passed over.

    Names are filtered before any file is asked for its size; contents are never read. Tasks list the folder, so that its
    files' names don't go through the driver. Frames in packs are listed one by one.
    """
    register(spark)
    exts = S.normal_extensions(extensions or ()) or S.VIDEO + S.IMAGE
    ends = "|".join(sorted({f".{v}" for e in exts for v in (e, e.upper())}))
    files = spark.read.format("listed_files").options(path=path, recursive="true", info="true", ends=ends).load().where("length > 0")
    return files.select("path", "length", F.timestamp_millis("mtime_ms").alias("mtime"), S.extension(F.col("path")).alias("ext"), S.media_kind(F.col("path")).alias("kind"))


def cached(spark: SparkSession, path: str) -> DataFrame:
    """frame_index of all files of a store named by number, whatever their size (Spark's readers leave out empty ones)."""
    register(spark)
    number = F.regexp_extract("path", r"/(\d+)(\.[^/]*)?$", 1)
    return spark.read.format("listed_files").options(path=path).load().where(number != "").select(number.cast("long").alias("frame_index"))


#: Readers by the name users choose them by; decoders of real files register here.
BACKENDS = {"synthetic": "synthetic_video"}


def video(spark: SparkSession, backend: str, where: Column | str | None = None, **options) -> DataFrame:
    """Frames by the reader of a backend, each task reading contiguous ranges of frames; by a condition `where` on frame_index
    no others are decoded."""
    if backend not in BACKENDS:
        raise ValueError(f"unknown backend {backend!r}, known: {', '.join(sorted(BACKENDS))}")
    register(spark)
    return _scanned(spark.read.format(BACKENDS[backend]).options(**options), where)


def planned(frames: DataFrame, plan: DataFrame) -> DataFrame:
    """Frames by their place in a plan (frame_index, position); the original index stays beside it."""
    return frames.join(plan, "frame_index")


def documents(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """JSON documents, one per file (or `lines`); unknown fields are ignored, corrupt ones are absent."""
    r = spark.read.schema(f"{schema}, _corrupt string").option("multiLine", str(not lines).lower()).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return r.withColumn("_ok", F.col("_corrupt").isNull()).where("_ok").drop("_corrupt", "_ok")


def settings(spark: SparkSession, path: str, defaults: dict[str, str]) -> dict[str, str]:
    """Settings saved as one JSON document: defaults for what lacks; a corrupt file is kept as .bak and defaults apply."""
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(hadoop)
    if not fs.exists(p):
        return dict(defaults)
    schema = ", ".join(f"{k} string" for k in defaults)
    rows = documents(spark, path, schema).limit(1).collect()  # one small document
    if not rows:
        fs.rename(p, jvm.org.apache.hadoop.fs.Path(path + ".bak"))
        return dict(defaults)
    return {k: v if rows[0][k] is None else rows[0][k] for k, v in defaults.items()}


class SyntheticVideo(DataSource):
    """A video by rule, for tests: `frames` frames of `width` x `height`, split into contiguous ranges.

    Options: frames, width, height, target, ranges. A decoder of real files has the same shape: each task opens the
    file once and reads its own range in order.
    """

    @classmethod
    def name(cls) -> str:
        return "synthetic_video"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema) -> DataSourceReader:
        return _SyntheticReader(self.options)


class _SyntheticReader(RangedReader):
    def __init__(self, options):
        super().__init__(options, 4)
        self.n = int(options.get("frames", "0"))
        self.size, self.target = (int(options.get("height", "2")), int(options.get("width", "2"))), options.get("target", "synthetic")

    def there(self) -> Bounds:
        return np.array([0]), np.array([self.n])

    def read(self, partition: Ranges | None) -> Iterator[tuple]:
        h, w = self.size
        for i in partition.frames() if partition else []:
            yield self.target, i, h, w, bytes([i % 256]) * (h * w * 3)


def register(spark: SparkSession) -> None:
    """Makes the library's formats known to a session, and has Spark push filters into them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (SyntheticVideo, FrameFiles, LatestFrame, ListedFiles):
        spark.dataSource.register(source)


def frame_files(spark: SparkSession, path: str, ext: str = "png", where: Column | str | None = None, **options) -> DataFrame:
    """frame_index, length, payload of a folder's frame files; by a condition `where` on frame_index other files stay closed."""
    register(spark)
    return _scanned(spark.read.format("frames").options(path=path, ext=ext, **options), where)


def _scanned(reader: DataFrameReader, where: Column | str | None) -> DataFrame:
    """What a source reads under a condition that is pushed into it.

    Spark keeps pushed filters with the relation, not with the scan: two scans of one relation with different filters would
    read the same frames. So each call has a relation of its own, filters that come later stay above a sample of
    everything, which they don't pass, and without a condition nothing is pushed.
    """
    return reader.load() if where is None else reader.option("pushdown", "true").load().where(where).sample(1.0)


def store(spark: SparkSession, path: str) -> Table:
    """The frames of all configurations, each in folders of its own, so that changing one never mixes frames."""
    return Table(spark, path, partition_by=("config_key",))


def save(frames: DataFrame, path: str, key: str) -> int:
    """Frames into the store of a configuration, as a new version."""
    return store(frames.sparkSession, path).append(frames.withColumn("config_key", F.lit(key)))


def load(spark: SparkSession, path: str, key: str) -> DataFrame:
    return store(spark, path).read().where(F.col("config_key") == key).drop("config_key")


def write_files(frames: DataFrame, path: str, ext: str = "png", encoder: str = "raw", mode: str = "append", frame: str = "frame_index", payload: str = "payload", spread: bool = True, pack: bool | None = None) -> None:
    """Frames as files %08d.ext in a folder that all machines share; a job that fails leaves none of its own.

    Frames are dealt out to all tasks by number (unless `spread` is false); once all are staged, tasks move them. With
    `pack` the files lie in archives of 10,000 numbers each, which is for many or small frames; without it being said the
    folder's form goes on, single files in a new one. Writers at once into one pack aren't for packs: the last one's stays.
    """
    spark = frames.sparkSession
    register(spark)
    size = (pack_size(path) or (PACK_FRAMES if pack else None)) if pack is not False else None
    options = {"path": path, "ext": ext, "encoder": encoder} | ({"pack": size} if size else {})
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    rows = frames.select(F.col(frame).cast("long").alias("frame_index"), F.length(payload).cast("long").alias("length"), F.col(payload).alias("payload"))
    if size:
        rows = rows.repartition(tasks, F.floor(F.col("frame_index") / size)).sortWithinPartitions("frame_index")
    if mode != "append":
        rows.write.format("frames").options(**options).mode(mode).save()
        return
    if spread and not size:
        rows = rows.repartition(tasks, "frame_index")
    staging = f".staging-{uuid.uuid4().hex}"
    try:
        rows.write.format("frames").options(**options, staging=staging).mode(mode).save()
        if own := whole(path, staging):
            spark.sparkContext.parallelize(own, len(own)).foreach(lambda folder: moved(path, folder))
    finally:
        tidy(path, staging)


def copy_files(spark: SparkSession, source: str, target: str, ext: str = "png") -> None:
    """The frame files of a folder in another one too, by many tasks; packs as they are, into a folder of no other form."""
    size = pack_size(source)
    if not size:
        write_files(frame_files(spark, source, ext), target, ext, spread=False)
        return
    fits(target, ext, size)
    firsts, staging = packs(source, ext).tolist(), f".staging-{uuid.uuid4().hex}"
    tasks = min(len(firsts), max(4 * spark.sparkContext.defaultParallelism, len(firsts) // 32))
    try:
        own = spark.sparkContext.parallelize(firsts, tasks).mapPartitions(lambda some: copied(source, target, staging, ext, size, some)).collect() if tasks else []
        mark(target, size)
        if own:
            spark.sparkContext.parallelize(own, len(own)).foreach(lambda folder: moved(target, folder))
    finally:
        tidy(target, staging)


def package(frames: DataFrame, output: str, video: bool, encode=None, ext: str = "png", payload: str = "payload", pack: bool | None = None) -> tuple[str, str | None]:
    """(where the output lies, note). A video by `encode(frames, output)`; without an encoder, and if frames are wanted, files
    in a folder (in packs, if `pack`): for a video that of its name without the extension."""
    if video and encode:
        encode(frames, output)
        return output, None
    folder = re.sub(r"\.[^./]*$", "", output) if video else output
    write_files(frames, folder, ext, payload=payload, pack=pack)
    return folder, "no encoder: frames instead" if video else None


def save_documents(df: DataFrame, path: str) -> int:
    """Rows as JSON documents, a new version of those at `path`; whatever stops the write leaves the one before."""
    return Table(df.sparkSession, path, "json").replace(df)


def saved_documents(spark: SparkSession, path: str) -> DataFrame:
    """The documents of the newest version."""
    return Table(spark, path, "json").read()
