"""Catalogues of identities: nearest match, routing, merging, carrying over, representatives, online clustering.

A catalogue has the columns ord, id, centroid, source_path, occurrences (and what else it came with); its order is part
of its meaning: of equal matches the first wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..plans.groups import folded
from ..session import scratch

#: Numbers in a catalogue that is sent to all workers at once (8 bytes each); larger ones are shuffled in blocks.
MAX_BROADCAST_NUMBERS = 4_000_000
#: Pivots of a large catalogue; identities of a block's part, and rows that meet one copy of it.
PIVOTS, BLOCK_PART, ROWS_PART = 256, 4096, 1_000_000
#: Rows and identities whose similarities a task holds together.
BLOCK = 2048


def centroids(rows: DataFrame, key: str, vector: str, dim: int | None = None) -> DataFrame:
    """key, n, centroid: normalized means; one aggregate for each component, so that nothing is exploded."""
    if dim is None:
        first = rows.select(F.size(vector).alias("n")).where("n > 0").first()
        dim = first.n if first else 0
    means = rows.groupBy(key).agg(F.count("*").alias("n"), *[F.avg(F.get(vector, i).cast("double")).alias(f"_{i}") for i in range(dim)])
    return means.select(key, "n", F.array(*[F.col(f"_{i}") for i in range(dim)]).cast("array<double>").alias("mean")).select(
        key, "n", V.normalize(F.col("mean")).alias("centroid"))


def best(sim: np.ndarray, ords: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best columns of each row, the smallest ord first among equals."""
    if sim.shape[1] > k:
        # all that reach the k-th value compete, so that ties go by ord
        least = -np.partition(-sim, k - 1, 1)[:, k - 1 : k]
        sim = np.where(sim >= least, sim, -np.inf)
    order = np.lexsort((ords, -sim), axis=1)[:, :k]
    return np.take_along_axis(sim, order, 1), np.take_along_axis(ords, order, 1)


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; those of length 0 stay."""
    length = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(length == 0, 1, length)


def by_size(lists: pa.ListArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Rows and matrix of the vectors of each length but 0."""
    n = np.where(lists.is_valid().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()), 0)
    out = {}
    for d in np.unique(n[n > 0]).tolist():
        at = np.flatnonzero(n == d)
        out[d] = at, lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), d)
    return out


def _best_of(rows: DataFrame, key: str, vector: str, part: list[tuple[int, list[float]]], k: int, out: str) -> DataFrame:
    """The k best of one part of a catalogue, which goes to all workers; similarities are held for one block at a time."""
    shared = rows.sparkSession.sparkContext.broadcast((np.array([p[0] for p in part], np.int32), [np.array(p[1], np.float64) for p in part]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ords, mats = shared.value
        size = np.array([len(m) for m in mats])
        for b in chain.from_iterable((b.slice(i, BLOCK) for i in range(0, b.num_rows, BLOCK)) for b in batches):
            units = {d: (at, unit_rows(x)) for d, (at, x) in by_size(b.column(1)).items()}
            top, who = np.empty((b.num_rows, 0)), np.empty((b.num_rows, 0), np.int32)
            for s in range(0, len(ords), BLOCK):
                sim = np.full((b.num_rows, min(BLOCK, len(ords) - s)), -1.0)
                for d, (at, x) in units.items():
                    to = np.flatnonzero(size[s : s + BLOCK] == d)
                    if len(to):
                        sim[np.ix_(at, to)] = x @ np.stack([mats[s + i] for i in to]).T
                top, who = best(np.concatenate([top, sim], 1), np.concatenate([who, np.broadcast_to(ords[s : s + BLOCK], sim.shape)], 1), k)
            w = top.shape[1]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), w))), pa.array(np.tile(np.arange(1, w + 1, dtype=np.int32), b.num_rows)),
                 pa.array(who.ravel()), pa.array(top.ravel())], names=[key, "rank", "ord", "sim"])

    return rows.select(key, F.col(vector).cast("array<double>")).mapInArrow(run, out)


def scores(rows: DataFrame, key: str, vector: str, catalogue: DataFrame, k: int = 1, most: int = MAX_BROADCAST_NUMBERS, least: float = -np.inf) -> DataFrame:
    """key, rank (from 1), ord, sim of the k most similar identities of each row; of equal ones the first in order.

    A catalogue of up to `most` numbers is multiplied, block by block, in each task. A larger one is shuffled in blocks
    around pivots, see `_in_blocks`: there identities below `least`, those whose vectors have another length than the row's,
    and rows without any other, are absent. Keys must be unique.
    """
    cat = catalogue.select("ord", F.col("centroid").cast("array<double>").alias("centroid"))
    shape = cat.agg(F.count("*").alias("n"), F.sum(F.size("centroid")).alias("d")).first()
    if not shape.n:
        return rows.select(key).withColumns({"rank": F.lit(1), "ord": F.lit(0), "sim": F.lit(0.0)}).limit(0)
    out = f"{key} {rows.schema[key].dataType.simpleString()}, rank int, ord int, sim double"
    if shape.d <= most:
        return _best_of(rows, key, vector, sorted((r.ord, list(r.centroid)) for r in cat.collect()), k, out)
    found = _in_blocks(rows.select(key, F.col(vector).cast("array<double>").alias("vector")), key, cat, k, least, most)
    far = F.struct((-F.col("sim")).alias("far"), "ord", "sim")
    if k == 1:
        return found.groupBy(key).agg(F.min(far).alias("b")).select(key, F.lit(1).alias("rank"), "b.ord", "b.sim")
    top = found.groupBy(key).agg(F.slice(F.array_sort(F.collect_list(far)), 1, k).alias("best"))
    return top.select(key, F.posexplode("best").alias("p", "b")).select(key, (F.col("p") + 1).alias("rank"), "b.ord", "b.sim")


def _in_blocks(rows: DataFrame, key: str, cat: DataFrame, k: int, least: float, most: int) -> DataFrame:
    """key, ord, sim: of each row (key, vector) the k best of every part of the catalogue that can hold one of its k best.

    Some identities are pivots. Every identity belongs to the pivot at the smallest angle, and a block of identities has
    the largest of these as its radius. A row at an angle of a to the pivot is at an angle of a - radius at least to all of
    the block, so that it meets the block only if that can beat its k-th best pivot, or `least`. Identities and rows
    are shuffled by block, large blocks in parts, and copies of a part where many rows want it; a task holds one part, and
    rows pass by. The driver only sees the pivots and a few numbers of each block.
    """
    spark = rows.sparkSession
    size = cat.select(F.max(F.size("centroid"))).first()[0]
    some = cat.where(F.size("centroid") > 0).orderBy(F.xxhash64("ord")).limit(max(1, min(PIVOTS, most // size))).collect()
    pivots = {d: np.array([r.centroid for r in some if len(r.centroid) == d]) for d in {len(r.centroid) for r in some}}
    first = dict(zip(pivots, np.cumsum([0, *(len(p) for p in pivots.values())]).tolist()))

    def angles(x: np.ndarray, d: int) -> np.ndarray:
        return np.arccos(np.clip(unit_rows(x) @ unit_rows(pivots[d]).T, -1, 1))

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block, angle, norm = np.full(b.num_rows, -1), np.full(b.num_rows, np.pi), np.zeros(b.num_rows)
            for d, (at, x) in by_size(b.column(1)).items():
                norm[at] = np.sqrt((x * x).sum(1))
                block[at] = -d  # without a pivot of its length, or without a direction
                good = norm[at] > 0
                if d in pivots and good.any():
                    a = angles(x[good], d)
                    block[at[good]], angle[at[good]] = first[d] + a.argmin(1), a.min(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(block), pa.array(angle), pa.array(norm)], names=["ord", "centroid", "block", "angle", "norm"])

    path, cat = scratch(spark, "catalogue"), cat.select(F.col("ord").cast("long").alias("ord"), "centroid")
    cat.where(F.size("centroid") > 0).mapInArrow(assigned, "ord long, centroid array<double>, block long, angle double, norm double").write.parquet(path)
    cat = spark.read.parquet(path)
    blocks = {r.block: r for r in cat.groupBy("block").agg(F.max("angle").alias("radius"), F.max("norm").alias("high"), F.min("norm").alias("low"), F.count("*").alias("n")).collect()}
    kind = rows.schema[key].dataType.simpleString()

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chain.from_iterable((b.slice(i, BLOCK) for i in range(0, b.num_rows, BLOCK)) for b in batches):
            row, block = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for d, (at, x) in by_size(b.column(1)).items():
                if -d in blocks:
                    row.append(at), block.append(np.full(len(at), -d))
                own = [j for j in range(first[d], first[d] + len(pivots[d])) if j in blocks] if d in pivots else []
                if not own:
                    continue
                pick = np.array(own) - first[d]
                sim = unit_rows(x) @ pivots[d].T
                beat = np.maximum(-np.partition(-sim, k - 1, 1)[:, k - 1] if sim.shape[1] >= k else -np.inf, least)
                near = np.cos(np.maximum(0, angles(x, d)[:, pick] - np.array([blocks[j].radius for j in own])))
                reach = near * np.where(near >= 0, [blocks[j].high for j in own], [blocks[j].low for j in own])
                zero = (x == 0).all(1)
                i, j = np.nonzero((reach >= beat[:, None] - 1e-9) | zero[:, None])
                row.append(at[i]), block.append(np.array(own)[j])
            take = pa.array(np.concatenate(row))
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(np.concatenate(block))], names=[key, "vector", "block"])

    visits = rows.mapInArrow(wanted, f"{key} {kind}, vector array<double>, block long")
    asked = {r.block: r.n for r in visits.groupBy("block").agg(F.count("*").alias("n")).collect()}
    shape = spark.createDataFrame([(j, -(-b.n // BLOCK_PART), -(-asked.get(j, 0) // ROWS_PART)) for j, b in blocks.items()], "block long, parts int, copies int")
    j = cat.join(F.broadcast(shape), "block").withColumn("part", F.pmod(F.xxhash64("ord"), F.col("parts")).cast("int"))
    j = j.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    held = j.select("block", "part", "copy", F.lit(0).alias("kind"), none(key, kind), "ord", F.col("centroid").alias("vector"))
    v = visits.join(F.broadcast(shape), "block").withColumn("copy", F.pmod(F.xxhash64(key), F.col("copies")).cast("int"))
    v = v.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    both = held.unionAll(v.select("block", "part", "copy", F.lit(1).alias("kind"), key, none("ord", "long"), "vector"))
    by = ["block", "part", "copy"]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ords, mats = None, [], []
        for b in chain.from_iterable((b.slice(i, BLOCK) for i in range(0, b.num_rows, BLOCK)) for b in batches):
            at = np.stack([b.column(i).to_numpy() for i in range(4)])
            cuts = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(0)) + 1).tolist(), b.num_rows] if b.num_rows else [0]
            for s, e in zip(cuts[:-1], cuts[1:]):
                if now != tuple(at[:3, s]):
                    now, ords, mats = tuple(at[:3, s]), [], []
                _, x = next(iter(by_size(b.column(6).slice(s, e - s)).values()))  # a block has vectors of one length
                if at[3, s] == 0:
                    ords.append(b.column(5).slice(s, e - s).to_numpy()), mats.append(x)
                    continue
                if len(mats) != 1:
                    ords, mats = [np.concatenate(ords)], [np.concatenate(mats)]
                sim = unit_rows(x) @ mats[0].T
                top, who = best(sim, np.broadcast_to(ords[0], sim.shape), k)
                w = top.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [b.column(4).slice(s, e - s).take(pa.array(np.repeat(np.arange(e - s), w))), pa.array(who.ravel().astype(np.int32)), pa.array(top.ravel())], names=[key, "ord", "sim"])

    return both.repartition(*by).sortWithinPartitions(*by, "kind").mapInArrow(compared, f"{key} {kind}, ord int, sim double")


def best_match(rows: DataFrame, key: str, vector: str, catalogue: DataFrame, threshold: float) -> DataFrame:
    """key, ord, id, source_path, sim of the nearest identity at or above the threshold; rows without one are absent."""
    hit = scores(rows, key, vector, catalogue, least=threshold).where(F.col("sim") >= threshold)
    return hit.drop("rank").join(catalogue.select("ord", "id", "source_path"), "ord")


def route(rows: DataFrame, key: str, vector: str, catalogue: DataFrame, threshold: float, policy: str = "SKIP", default: str | None = None) -> DataFrame:
    """key, id, source: a match's source (null if it has none); without a match, by the policy SKIP, DEFAULT or FIRST."""
    if policy not in ("SKIP", "DEFAULT", "FIRST"):
        raise ValueError(policy)
    hit = best_match(rows, key, vector, catalogue, threshold).select(key, "id", "source_path", F.lit(True).alias("hit"))
    other: Column = F.lit(None).cast("string")
    if policy == "DEFAULT":
        other = F.lit(default).cast("string")
    elif policy == "FIRST":
        first = assigned_sources(catalogue).limit(1).select(F.col("source_path").alias("first_source")).collect()
        other = F.lit(first[0].first_source if first else default).cast("string")
    return rows.select(key).join(hit, key, "left").select(key, "id", F.when(F.col("hit"), F.col("source_path")).otherwise(other).alias("source"))


def assigned_sources(catalogue: DataFrame, default: str | None = None) -> DataFrame:
    """source_path, ord: distinct sources by first appearance; a default that isn't among them comes last."""
    s = catalogue.where("source_path is not null").groupBy("source_path").agg(F.min("ord").cast("long").alias("ord"))
    if default is not None:
        last = catalogue.sparkSession.createDataFrame([(default, 2**62)], "source_path string, ord long")
        s = s.unionByName(last.join(s, "source_path", "left_anti"))
    return s.orderBy("ord")


def is_active(catalogue: DataFrame, armed: bool = False, policy: str = "SKIP", default: str | None = None) -> DataFrame:
    """One row: whether routing does anything."""
    always = armed or (policy == "DEFAULT" and default is not None)
    return catalogue.agg((F.coalesce(F.bool_or(F.col("source_path").isNotNull()), F.lit(False)) | F.lit(always)).alias("active"))


#: What a merged identity takes from its first appearance, and from its best one, where the catalogue has it.
FIRST_FIELDS, BEST_FIELDS = ("first_frame", "first_bbox"), ("ref_frame", "ref_bbox", "sex", "age", "det_score", "pitch", "yaw", "roll")


def merge(catalogue: DataFrame, groups: DataFrame, dim: int) -> DataFrame:
    """`catalogue` with each group (id, grp, pos) of two members or more merged into the one listed first.

    That one keeps its id and place. Occurrences add up (1 at least); the centroid is their weighted mean, normalized;
    its source stays, else the first listed one that there is; first frame and box are those of the earliest member that
    has one, what describes the best appearance that of the highest score (unknown counts as 0). Of equals the one
    listed first wins. Ids that the catalogue lacks don't count; all other rows stay as they are.
    """
    g = catalogue.join(groups.select("id", F.col("grp").cast("string").alias("grp"), "pos"), "id", "left")
    g = g.withColumn("grp", F.coalesce(F.concat(F.lit("g:"), "grp"), F.concat(F.lit("i:"), "id"))).withColumn("pos", F.coalesce("pos", F.lit(0)))
    have = [c for c in catalogue.columns]
    n = F.col("occurrences").cast("double")
    first = [c for c in FIRST_FIELDS if c in have]
    best = [c for c in BEST_FIELDS if c in have]
    source = F.nullif("source_path", F.lit(""))
    early = F.when(F.col("first_frame").isNotNull(), F.struct("first_frame", "pos")) if first else None
    score = F.coalesce("det_score", F.lit(0.0)) if "det_score" in have else F.lit(0.0)
    m = g.groupBy("grp").agg(
        F.count("*").alias("members"), F.min_by(F.struct(*have), "pos").alias("own"), F.sum("occurrences").alias("all"),
        F.min_by(source, F.when(source.isNotNull(), F.col("pos"))).alias("source"),
        *([F.min_by(F.struct(*first), early).alias("early")] if first else []),
        *([F.max_by(F.struct(*best), F.struct(score, -F.col("pos"))).alias("best")] if best else []),
        *[F.sum(F.get("centroid", i) * n).alias(f"_{i}") for i in range(dim)])
    new = {"source_path": F.col("source"), "occurrences": F.greatest(F.col("all"), F.lit(1)), "centroid": V.normalize(F.array(*[F.col(f"_{i}") for i in range(dim)]))}
    new |= {c: F.col("early")[c] for c in first} | {c: F.col("best")[c] for c in best}
    return m.select(*[F.when(F.col("members") > 1, new[c]).otherwise(F.col("own")[c]).alias(c) if c in new else F.col("own")[c].alias(c) for c in have])


def edited(catalogue: DataFrame, edits: DataFrame) -> DataFrame:
    """`catalogue` after edits (seq, op, id, value): assign (a null value takes the source away) and remove.

    Of several assignments of an identity the last counts; a removed one is gone whatever else was done to it.
    """
    last = edits.where("op = 'assign'").groupBy("id").agg(F.max_by(F.struct("value"), "seq").alias("_new"))
    gone = edits.where("op = 'remove'").select("id").distinct()
    d = catalogue.join(gone, "id", "left_anti").join(last, "id", "left")
    return d.withColumn("source_path", F.when(F.col("_new").isNotNull(), F.col("_new.value")).otherwise(F.col("source_path"))).drop("_new").select(*catalogue.columns)


def settings_after(edits: DataFrame, map_id: str) -> DataFrame:
    """map_id, threshold, armed, policy, default: settings of catalogues after edits (seq, op, value), each by its last."""
    last = lambda what: F.max_by(F.when(F.col("op") == what, F.col("value")), F.when(F.col("op") == what, F.col("seq")))
    return edits.groupBy(map_id).agg(
        F.coalesce(last("threshold").cast("double"), F.lit(0.5)).alias("threshold"), F.coalesce(last("armed") == "on", F.lit(False)).alias("armed"),
        F.coalesce(last("unmatched"), F.lit("SKIP")).alias("policy"), last("default").alias("default"))


def minted_identities(rows: DataFrame, vector: str, parts: list[Column]) -> DataFrame:
    """New identities of vectors: twelve hex digits of their origin as id, the vector normalized as centroid, one occurrence."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return rows.withColumns({"id": F.substring(F.sha1(text), 1, 12), "centroid": V.normalize(F.col(vector)), "occurrences": F.lit(1).cast("long")})


def map_of_task(flag: Column, store: Column, live: Column, saved: Column) -> Column:
    """Which catalogue a task uses: the live one of its store if it has one and its flag is on (none if that is empty), else
    the one saved with it."""
    return F.when(store.isNotNull() & flag, live).otherwise(saved)


def prepared(routed: DataFrame, sources: DataFrame, multi: bool, single: str | None) -> DataFrame:
    """Routed rows with the source that swaps them: one that holds a face, else none; models that take one source only give
    all rows the single one."""
    if not multi:
        return routed.withColumn("source", F.lit(single).cast("string"))
    ok = sources.where("faces > 0").select(F.col("path").alias("source"), F.lit(True).alias("_ok")).distinct()
    return routed.join(ok, "source", "left").withColumn("source", F.when(F.col("_ok"), F.col("source"))).drop("_ok").select(*routed.columns)


def best_face(faces: DataFrame, frame: str, pos: str, vector: str, identity: DataFrame, threshold: float) -> DataFrame:
    """frame, pos, sim: in each frame the face most like one selected identity, the first of equals, if it is like enough.

    `identity` has one row (centroid); vectors are units.
    """
    one = F.broadcast(identity.select("centroid").limit(1))
    d = faces.where(F.col(vector).isNotNull()).join(one).withColumn("sim", V.cosine(F.col("centroid"), F.col(vector).cast("array<double>")))
    best = d.groupBy(frame).agg(F.max_by(F.struct(pos, "sim"), F.struct("sim", -F.col(pos))).alias("b"))
    return best.select(frame, f"b.{pos}", "b.sim").where(F.col("sim") >= threshold)


def carry_over(fresh: DataFrame, old: DataFrame, old_threshold: float) -> DataFrame:
    """`fresh` with sources of matching identities of the old catalogue, by the old catalogue's threshold."""
    named = fresh.select(F.col("id").alias("fresh_id"), "centroid")
    with_source = best_match(named, "fresh_id", "centroid", old, old_threshold).select(F.col("fresh_id").alias("id"), F.col("source_path").alias("old_source"))
    return fresh.join(with_source, "id", "left").withColumn("source_path", F.coalesce("old_source", "source_path")).drop("old_source")


def representative(rows: DataFrame, key: str, score: str = "det_score", frame: str = "frame_index", pos: str = "pos", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, best frame, best score, first frame, n, and `keep` of the best and (as first_*) of the first row.

    Best is the earliest of the highest scores.
    """
    best = F.max_by(F.struct(frame, *keep), F.struct(score, -F.col(frame), -F.col(pos)))
    first = F.min_by(F.struct(F.lit(0).alias("_"), *keep), F.struct(frame, pos))
    a = rows.groupBy(key).agg(F.max(score).alias("best_score"), best.alias("b"), first.alias("a"), F.min(frame).alias("first_frame"), F.count("*").alias("occurrences"))
    return a.select(key, F.col(f"b.{frame}").alias("best_frame"), "best_score", "first_frame", "occurrences",
                    *[F.col(f"b.{c}").alias(c) for c in keep], *[F.col(f"a.{c}").alias(f"first_{c}") for c in keep])


def finished(catalogue: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """The catalogue with what `representative` found of each identity; identities without rows have none."""
    return catalogue.join(found, key, "left")


def online_clusters(rows: DataFrame, target: str, frame: str, pos: str, vector: str, threshold: float) -> DataFrame:
    """target, frame, pos, cluster: each vector, in order, joins the nearest cluster or opens one.

    Of equal similarities the last cluster wins; a joined cluster's centroid becomes the normalized running mean. The
    fold is sequential within a target by definition; targets run in parallel.
    """
    kind = lambda c: rows.schema[c].dataType.simpleString()

    def step(state: _Clusters, row: tuple) -> tuple[_Clusters, list[tuple]]:
        return state, [(row[0], row[1], state.add(np.asarray(row[2], np.float64), threshold))]

    return folded(rows.select(target, frame, pos, vector), [target], [frame, pos], _Clusters, step, f"{frame} {kind(frame)}, {pos} {kind(pos)}, cluster int")


class _Clusters:
    """Centroids and sizes of one target's clusters, which is all that a fold keeps."""

    def __init__(self) -> None:
        self.means, self.sizes, self.used = np.zeros((16, 0)), np.zeros(16), 0

    def add(self, v: np.ndarray, threshold: float) -> int:
        v = unit(v)
        if not self.used:
            self.means = np.zeros((len(self.sizes), len(v)))
        near = self.means[: self.used] @ v
        best = self.used - 1 - int(np.argmax(near[::-1])) if self.used else -1
        if best >= 0 and near[best] >= threshold:
            self.means[best] = unit((self.means[best] * self.sizes[best] + v) / (self.sizes[best] + 1))
            self.sizes[best] += 1
            return best
        if self.used == len(self.sizes):
            self.means, self.sizes = np.concatenate([self.means, np.zeros_like(self.means)]), np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        self.means[self.used], self.sizes[self.used] = v, 1
        self.used += 1
        return self.used - 1


def unit(v: np.ndarray) -> np.ndarray:
    length = np.sqrt((v * v).sum())
    return v / length if length else v
