"""Frame stores: tables by configuration with whole-table saves, and what a buffer holds by its log of puts and removals.

A log has a key (session), seq, op and frame. Ops: put; evict (memory only); invalidate (a frame, until it is put anew);
invalidate_from (all from a frame on are gone); invalidate_all (everything is gone, and so are the marks).
"""

from __future__ import annotations

import uuid
from bisect import bisect_left, bisect_right, insort
from collections import deque

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.groups import folded
from ..sources import frames as S
from .versions import Table

#: Puts that a buffer remembers for its fallback (fixed value).
RECENT = 1024
MODES = ("WRITE_READ", "READ_ONLY", "OFF")


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def save_whole(df: DataFrame, path: str, form: str = "parquet") -> int:
    """`df` as the new version of the table at `path`; whatever stops the write leaves the one before."""
    return Table(df.sparkSession, path, form).replace(df)


def has(spark: SparkSession, path: str, key: str, frames: DataFrame, frame: str = "frame_index") -> DataFrame:
    """`frames` with `present`: whether the store of a configuration has each; no store has none."""
    if not Table(spark, path).exists():
        return frames.withColumn("present", F.lit(False))
    have = S.load(spark, path, key).select(frame, F.lit(True).alias("present")).distinct()
    return frames.join(have, frame, "left").withColumn("present", F.coalesce("present", F.lit(False)))


def clear_from(spark: SparkSession, path: str, start: int, frame: str = "frame_index") -> None:
    """The store at `path` without its frames from `start` on, in all configurations."""
    store = S.store(spark, path)
    if store.exists():
        store.update(lambda rows: rows.where(F.col(frame) < start))


class Session:
    """A store for one session: a folder of its own under `root`, deleted when the session is closed."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.path = spark, f"{root.rstrip('/')}/session-{uuid.uuid4().hex}"

    def __enter__(self) -> str:
        return self.path

    def __exit__(self, *_) -> None:
        p, fs = _path(self.spark, self.path)
        fs.delete(p, True)


def holdings(log: DataFrame, key: str, seq: str = "seq", op: str = "op", frame: str = "frame") -> DataFrame:
    """key, frame, state of every frame that was put: ready (in memory), stored (evicted from it), invalid, or gone.

    Removals from a frame on reach all higher frames; their newest one is carried along in order of frames, so that
    nothing is joined by range.
    """
    o, s, f = F.col(op), F.col(seq), F.col(frame)
    last = lambda what: F.max(F.when(o == what, s))
    per = log.where(o.isin("put", "evict", "invalidate")).groupBy(key, frame).agg(last("put").alias("put"), last("evict").alias("evict"), last("invalidate").alias("bad"))
    cuts = log.where(o.isin("invalidate_from", "invalidate_all")).select(
        key, F.when(o == "invalidate_all", F.lit(-1)).otherwise(f).cast("long").alias("at"), s.alias("cut"), F.when(o == "invalidate_all", s).alias("fresh"))
    cuts = cuts.groupBy(key, "at").agg(F.max("cut").alias("cut"), F.max("fresh").alias("fresh"))
    both = per.withColumn("at", f.cast("long")).unionByName(cuts, allowMissingColumns=True)
    line = W.partitionBy(key).orderBy("at").rangeBetween(W.unboundedPreceding, 0)
    both = both.withColumn("cut", F.max("cut").over(line)).withColumn("fresh", F.max("fresh").over(line)).where(F.col("put").isNotNull() | F.col("bad").isNotNull())
    newer = lambda a, b: F.coalesce(F.col(a) > F.col(b), F.col(a).isNotNull())
    state = F.when(newer("bad", "put") & newer("bad", "fresh"), "invalid").when(~newer("put", "cut"), "gone").when(newer("evict", "put"), "stored").otherwise("ready")
    return both.where("put is not null").select(key, frame, state.alias("state"))


def readable(held: DataFrame, mode: str) -> DataFrame:
    """Holdings with `origin`: where a read finds each frame; with the store OFF only memory counts."""
    if mode not in MODES:
        raise ValueError(mode)
    state = F.col("state")
    disk = F.lit("miss") if mode == "OFF" else F.lit("disk")
    return held.withColumn("origin", F.when(state == "ready", "memory").when(state == "stored", disk).otherwise("miss"))


def back_filled(memory: DataFrame, reads: DataFrame, disk: DataFrame, frame: str) -> DataFrame:
    """Memory after reads: what was read from disk, once, is in memory too."""
    new = disk.join(reads.select(frame).distinct(), frame, "left_semi").join(memory.select(frame), frame, "left_anti")
    return memory.unionByName(new)


def latest_at_or_below(log: DataFrame, key: str, seq: str = "seq", op: str = "op", frame: str = "frame", recent: int = RECENT) -> DataFrame:
    """key, seq, target, shown of each `tick` of the log: the highest frame up to its own among the last `recent` puts that
    no mark makes invalid; null if there is none.

    A fold over the log of each key: the last puts in a ring, and those that are valid sorted beside it.
    """
    kind = log.schema[frame].dataType.simpleString()
    d = log.where(F.col(op).isin("put", "invalidate", "tick") & F.col(frame).isNotNull())

    def step(state: _Recent, row: tuple) -> tuple[_Recent, list[tuple]]:
        at, what, f = row
        if what == "tick":
            return state, [(at, f, state.below(f))]
        state.put(f) if what == "put" else state.invalidate(f)
        return state, []

    out = f"{seq} {log.schema[seq].dataType.simpleString()}, target {kind}, shown {kind}"
    return folded(d.select(key, seq, op, frame), [key], [seq], lambda: _Recent(recent), step, out)


class _Recent:
    """The last puts, and the valid ones among them in order."""

    def __init__(self, most: int):
        self.most, self.ring, self.valid, self.of = most, deque(), [], {}

    def put(self, f) -> None:
        entry = [f, True]
        self.ring.append(entry)
        self.of.setdefault(f, []).append(entry)
        insort(self.valid, f)
        if len(self.ring) > self.most:
            old = self.ring.popleft()
            self.of[old[0]].remove(old) if old[1] else None
            self.drop(old)

    def drop(self, entry: list) -> None:
        if entry[1]:
            entry[1] = False
            del self.valid[bisect_left(self.valid, entry[0])]

    def invalidate(self, f) -> None:
        for entry in self.of.pop(f, []):
            self.drop(entry)

    def below(self, f):
        i = bisect_right(self.valid, f)
        return self.valid[i - 1] if i else None


def miss_counts(ticks: DataFrame, held: DataFrame, key: str, target: str, frame: str) -> DataFrame:
    """key, hits, misses of reads at the current time."""
    have = held.where("origin <> 'miss'").select(key, F.col(frame).alias(target), F.lit(True).alias("_hit"))
    n = F.count_if(F.col("_hit").isNotNull())
    return ticks.join(have, [key, target], "left").groupBy(key).agg(n.alias("hits"), (F.count("*") - n).alias("misses"))


def by_content(crops: DataFrame, signature: Column, work, ident: str) -> DataFrame:
    """`crops` with what `work` gives for their content: it sees one crop of each signature, and all get its result."""
    c = crops.withColumn("_sig", signature)
    rest = [x for x in crops.columns]
    one = c.groupBy("_sig").agg(F.min_by(F.struct(*rest), ident).alias("r")).select("_sig", "r.*")
    return c.join(work(one), "_sig").drop("_sig")


def entry_meta(entries: DataFrame, source: Column, target: Column, created: Column) -> DataFrame:
    """Metadata of cache entries: what they were made of, when, and last used then."""
    return entries.withColumns({"source_path": source, "target_path": target, "created": created, "last_used": created})


def touched(meta: DataFrame, uses: DataFrame, key: str) -> DataFrame:
    """Metadata with the newest use of each entry; a use never sets it back."""
    new = uses.groupBy(key).agg(F.max("used").alias("_used"))
    return meta.join(new, key, "left").withColumn("last_used", F.greatest("last_used", "_used")).drop("_used")
