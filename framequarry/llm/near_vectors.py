"""Near-duplicate vectors by random-hyperplane sign hashing, exact cosine and distributed components.

Equal vectors form one class first. Vectors within half the threshold's angle of a leader form its ball: any two of them
are linked for certain, so that a hot group of near copies is counted, not compared. In each of several tables the signs
of products with random hyperplanes name a bucket. Buckets only bring ids and short sketches of signs together, which
tell which members can have a partner; the vectors of these alone are fetched, and all their cosines are computed exactly,
in blocks. A link counts in the first table whose bucket the two share, so counts need no list of pairs; each block hands
on a spanning forest of its links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .groups import sorted_groups

THRESHOLD, RECALL, SEED = 0.9, 0.95, 7
#: Rows of a bucket that are compared at a time; larger buckets are split and every two parts meet.
BLOCK = 2048
#: Signs in a sketch, and how many standard deviations above the mean of a pair at the threshold two sketches may differ.
SKETCH, SLACK = 192, 4.5
#: Buckets whose members may lead balls, the largest ones, and leaders tried from each; both are collected.
MAX_HOT_BUCKETS, TRIED = 256, 4
#: Ids with partners are broadcast up to so many rows.
MAX_BROADCAST_KEYS = 500_000
#: Rows of a block whose products are held together.
STRIP = 512


def shape(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """(bits, tables): buckets of about 512 of n vectors, and so many tables that a pair at the threshold meets with `recall`."""
    bits = max(4, min(30, math.ceil(math.log2(max(n, 2))) - 9))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same)))


def most_apart(threshold: float) -> int:
    """Signs in which the sketches of a pair at the threshold differ at most, but for a chance below 1e-5."""
    p = math.acos(threshold) / math.pi
    return math.ceil(SKETCH * p + SLACK * math.sqrt(SKETCH * p * (1 - p)))


class Hashing:
    """Unit vectors, signs, bucket numbers and balls; hyperplanes by length of vector are drawn once in a worker."""

    def __init__(self, bits: int, tables: int, threshold: float, leaders: list[tuple[int, list[float]]], seed: int):
        self.bits, self.tables, self.seed = bits, tables, seed
        self.inside = math.cos(math.acos(threshold) / 2) + 1e-9
        self.leaders = {}
        for i, (_, v) in enumerate(leaders):
            self.leaders.setdefault(len(v), ([], []))[0].append(i + 1)
            self.leaders[len(v)][1].append(v)
        self.planes: dict[int, np.ndarray] = {}

    def signs(self, x: np.ndarray) -> np.ndarray:
        d = x.shape[1]
        if d not in self.planes:
            self.planes[d] = np.random.default_rng([self.seed, d]).normal(size=(d, max(SKETCH, self.bits * self.tables)))
        return x @ self.planes[d] > 0

    def codes(self, signs: np.ndarray) -> np.ndarray:
        weights = np.int64(1) << np.arange(self.bits, dtype=np.int64)
        return signs[:, : self.bits * self.tables].reshape(-1, self.tables, self.bits) @ weights

    def balls(self, x: np.ndarray) -> np.ndarray:
        """The number of each vector's ball, from 1; 0 for none."""
        if x.shape[1] not in self.leaders:
            return np.zeros(len(x), np.int32)
        numbers, vectors = self.leaders[x.shape[1]]
        near = x @ unit_rows(np.array(vectors, np.float64)).T
        best = near.argmax(1)
        return np.where(near[np.arange(len(x)), best] >= self.inside, np.array(numbers)[best], 0).astype(np.int32)


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def by_length(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, unit vectors) of the vectors of each length."""
    sizes = np.diff(lists.offsets.to_numpy())
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        yield at, unit_rows(lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d))


def hashed(classes: DataFrame, how: Hashing, tables: int) -> DataFrame:
    """key (table, length and bucket), ball, cid, sketch of every class in each of the first tables."""
    shared = classes.sparkSession.sparkContext.broadcast(how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = shared.value
        for b in batches:
            cid = b.column(0).to_numpy()
            for at, x in by_length(b.column(1)):
                signs = h.signs(x)
                sketch = np.packbits(signs[:, :SKETCH], axis=1)
                sketch = pa.FixedSizeBinaryArray.from_buffers(pa.binary(SKETCH // 8), len(x), [None, pa.py_buffer(np.ascontiguousarray(sketch))]).cast(pa.binary())
                ball, codes = pa.array(h.balls(x)), h.codes(signs)
                for t in range(tables):
                    key = np.int64(x.shape[1] * 4096 + t) << 32 | codes[:, t]
                    yield pa.RecordBatch.from_arrays([pa.array(key), ball, pa.array(cid[at]), sketch], names=["key", "ball", "cid", "sketch"])

    return classes.select("cid", "e").mapInArrow(run, "key long, ball int, cid long, sketch binary")


def hot_leaders(classes: DataFrame, how: Hashing, threshold: float, block: int) -> list[tuple[int, list[float]]]:
    """(cid, vector) of members of the largest buckets of one table, none near another: a bounded number, in the driver.

    Which these are changes no result, only how much is left to compare.
    """
    tried = [F.min_by("cid", F.xxhash64("cid", F.lit(k))).alias(f"c{k}") for k in range(TRIED)]
    hot = hashed(classes, how, 1).groupBy("key").agg(F.count("*").alias("n"), *tried).where(F.col("n") > block)
    rows = hot.orderBy(F.col("n").desc(), "key").limit(MAX_HOT_BUCKETS).collect()
    order = list(dict.fromkeys(c for r in rows for c in r[2:]))
    if not order:
        return []
    found = {r.cid: list(r.e) for r in classes.where(F.col("cid").isin(order)).select("cid", "e").collect()}
    near, kept = math.cos(math.acos(threshold) / 4), []
    for c in order:
        v = unit_rows(np.array([found[c]], np.float64))[0]
        if all(len(u) != len(v) or float(u @ v) < near for _, u in kept):
            kept.append((c, v))
    return [(c, v.tolist()) for c, v in kept]


def apart(ball: np.ndarray, part: np.ndarray, s: slice, two: bool) -> np.ndarray:
    """Which pairs of rows (those of a strip with all) are to be compared at all."""
    ok = (ball[s, None] != ball[None]) | (ball[s, None] == 0)
    if two:
        ok &= part[s, None] != part[None]
    ok[np.arange(len(ok)), np.arange(s.start, s.start + len(ok))] = False
    return ok


def promising(rows: DataFrame, threshold: float) -> DataFrame:
    """key, p, q, part, cid, ball of the rows that have a partner whose sketch is near enough, within their group."""
    least = SKETCH - 2 * most_apart(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in sorted_groups(batches, 3):
            n = g.num_rows
            if n < 2:
                continue
            part, ball = g.column(3).to_numpy(), g.column(5).to_numpy()
            two = g.column(1)[0].as_py() != g.column(2)[0].as_py()
            bits = np.unpackbits(np.frombuffer(b"".join(g.column(6).to_pylist()), np.uint8).reshape(n, -1), axis=1)
            x = bits.astype(np.float32) * 2 - 1  # products count equal signs less unequal ones
            keep = np.zeros(n, bool)
            for a in range(0, n, STRIP):
                s = slice(a, min(n, a + STRIP))
                keep[s] = ((x[s] @ x.T >= least) & apart(ball, part, s, two)).any(1)
            if keep.any():
                at = pa.array(np.flatnonzero(keep))
                yield from g.select(range(6)).take(at).combine_chunks().to_batches()

    return rows.mapInArrow(run, "key long, p int, q int, part int, cid long, ball int")


def local_components(hit: np.ndarray) -> np.ndarray:
    """Smallest row reachable from each row of a symmetric boolean matrix."""
    n = len(hit)
    label = np.arange(n)
    while True:
        new = label.copy()
        for a in range(0, n, STRIP):
            new[a : a + STRIP] = np.minimum(new[a : a + STRIP], np.where(hit[a : a + STRIP], label[None], n).min(1))
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def block_links(rows: DataFrame, how: Hashing, threshold: float) -> DataFrame:
    """cid, links (weighted count of exact links), rep, to (representatives of the row and of a row it is connected with)."""
    shared = rows.sparkSession.sparkContext.broadcast(how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = shared.value
        for g in sorted_groups(batches, 3):
            n = g.num_rows
            if n < 2:
                continue
            t = (g.column(0)[0].as_py() >> 32) % 4096
            two = g.column(1)[0].as_py() != g.column(2)[0].as_py()
            part, cid, ball, rep, m = (g.column(i).to_numpy() for i in range(3, 8))
            (_, x), = by_length(g.column(8).combine_chunks())
            hit = np.zeros((n, n), bool)
            for a in range(0, n, STRIP):
                s = slice(a, min(n, a + STRIP))
                hit[s] = (x[s] @ x.T >= threshold) & apart(ball, part, s, two)
            if not hit.any():
                continue
            label = local_components(hit)
            if t:  # a pair that shares a bucket of an earlier table was counted there
                codes = h.codes(h.signs(x))[:, :t]
                for a in range(0, n, STRIP):
                    p, q = np.nonzero(hit[a : a + STRIP])
                    for k in range(0, len(p), 1 << 16):
                        i, j = p[k : k + (1 << 16)] + a, q[k : k + (1 << 16)]
                        hit[i, j] = ~(codes[i] == codes[j]).any(1)
            links = np.array([m[row].sum() for row in hit])
            out = np.flatnonzero((links > 0) | (label != np.arange(n)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cid[out]), pa.array(links[out]), pa.array(rep[out]), pa.array(rep[label[out]])], names=["cid", "links", "rep", "to"])

    return rows.mapInArrow(run, "cid long, links long, rep long, to long")


def ball_members(classes: DataFrame, how: Hashing) -> DataFrame:
    """cid, m, ball of the classes that lie in a ball."""
    shared = classes.sparkSession.sparkContext.broadcast(how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, x in by_length(b.column(2)):
                ball = shared.value.balls(x)
                some = np.flatnonzero(ball)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at[some])), b.column(1).take(pa.array(at[some])), pa.array(ball[some])], names=["cid", "m", "ball"])

    return classes.select("cid", "m", "e").mapInArrow(run, "cid long, m long, ball int")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of `vectors` (vec_id, embedding).

    Vectors that are null, empty, zero or hold a null or non-finite component link with nothing; vectors of different
    lengths don't link; repeated rows are vectors of their own that link; rows with a null id are vectors like others, and
    their component is named by its smallest id that isn't null (null without any, and then all of it is kept); an empty
    table gives an empty result; further columns are ignored.
    """
    spark = vectors.sparkSession
    kind = vectors.schema["embedding"].dataType.simpleString()
    e = F.col("embedding") if kind == "array<float>" else F.col("embedding").cast("array<double>")
    v = vectors.select("vec_id", e.alias("e"))
    good = F.col("e").isNotNull() & (F.size("e") > 0) & ~F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("e", lambda x: x != 0)
    v = v.select("vec_id", F.when(F.coalesce(good, F.lit(False)), F.col("e")).alias("e"))
    v = v.select("vec_id", "e", F.when(F.col("e").isNotNull(), F.xxhash64("e")).alias("h1"), F.when(F.col("e").isNotNull(), F.xxhash64(F.lit(5), "e")).alias("h2"))
    classes = v.where("h1 is not null").groupBy("h1", "h2").agg(F.count("*").alias("m"), F.min("vec_id").alias("low"), F.first("e").alias("e"))
    classes = common.written(classes.withColumn("cid", F.monotonically_increasing_id()))
    bits, tables = shape(classes.count(), threshold, recall)
    leaders = hot_leaders(classes, Hashing(bits, tables, threshold, [], seed), threshold, block)
    how = Hashing(bits, tables, threshold, leaders, seed)
    names = spark.createDataFrame([(i + 1, c) for i, (c, _) in enumerate(leaders)], "ball int, leader long")

    keys = ["key", "p", "q"]
    rows = common.dealt(hashed(classes, how, tables), block).select(*keys, "part", "cid", "ball", "sketch")
    jobs = promising(rows.repartition(*keys).sortWithinPartitions(*keys), threshold)
    jobs = common.written(jobs.join(F.broadcast(names), "ball", "left").select(*keys, "part", "cid", "ball", F.coalesce("leader", "cid").alias("rep")))
    need = common.small(jobs.select("cid").distinct(), MAX_BROADCAST_KEYS)
    rows = jobs.join(classes.join(need, "cid", "left_semi").select("cid", "m", "e"), "cid").select(*keys, "part", "cid", "ball", "rep", "m", "e")
    found = common.written(block_links(rows.repartition(*keys).sortWithinPartitions(*keys), how, threshold))
    common.dropped(jobs)

    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    comp = common.components(found.where("rep <> to").select("rep", "to"), "rep", "to").withColumnRenamed("node", "rep")
    info = classes.select("cid", "h1", "h2", "m", "low").join(links, "cid", "left")
    if leaders:
        members = common.written(ball_members(classes, how))
        weight = members.groupBy("ball").agg(F.sum("m").alias("weight")).join(names, "ball")  # one row a leader
        info = info.join(members.select("cid", "ball").join(F.broadcast(weight), "ball").select("cid", "weight", F.col("leader").alias("rep")), "cid", "left")
    else:
        info = info.withColumns({"weight": F.lit(None).cast("long"), "rep": F.lit(None).cast("long")})
    info = info.withColumn("rep", F.coalesce("rep", "cid")).join(comp, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    lowest = info.groupBy("component").agg(F.min("low").alias("component_id"))
    sure = F.coalesce(F.col("weight") - F.col("m"), F.lit(0))
    info = info.join(lowest, "component").select("h1", "h2", (F.col("m") - 1 + sure + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = v.select("vec_id", "h1", "h2").where("h1 is not null").join(info, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    alone = v.where("h1 is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionAll(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(common.documents(spark, sf_dir, "embeddings"))
