"""Detections and baked geometry: filters, nearest and hit tests, matching at a low floor, lookups with a fallback."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..plans.groups import by_group
from .identities import best_match

FLOOR = 0.3


def first_only(df: DataFrame, frame: str, pos: str, qualifies: Column, many: bool) -> DataFrame:
    """Qualifying detections: all, or the first of each frame."""
    ok = df.where(qualifies)
    return ok if many else ok.withColumn("_n", F.row_number().over(W.partitionBy(frame).orderBy(pos))).where("_n = 1").drop("_n")


def nearest_box(df: DataFrame, frame: str, pos: str, box: str, x: Column, y: Column) -> DataFrame:
    """Of each frame the detection whose box centre is nearest to a point; of equal ones the first."""
    c = V.center(F.col(box))
    d = (c["x"] - x) * (c["x"] - x) + (c["y"] - y) * (c["y"] - y)
    return df.withColumn("_d", d).groupBy(frame).agg(F.min_by(F.struct(pos, box), F.struct("_d", pos)).alias("b"), F.min("_d").alias("distance2")).select(
        frame, f"b.{pos}", f"b.{box}", "distance2")


def hit_test(df: DataFrame, frame: str, pos: str, box: str, x: Column, y: Column) -> DataFrame:
    """Of each frame the first detection whose box holds the point; frames without one are absent."""
    return df.where(V.box_contains(F.col(box), x, y)).groupBy(frame).agg(F.min(pos).alias(pos))


def suppress(df: DataFrame, frame: str, box: str, score: str, min_score: float = 0.5, max_overlap: float = 0.4, ties: tuple[str, ...] = ()) -> DataFrame:
    """Non-maximum suppression within frames: the best score first, boxes that overlap a kept one too much go.

    Equal scores go by the columns `ties`. Greedy by definition, so one frame is one group; frames run in parallel.
    """

    def keep(x: pd.DataFrame) -> pd.DataFrame:
        b = np.stack(x[box].to_numpy()).astype(float)
        area = np.maximum(0, b[:, 2] - b[:, 0]) * np.maximum(0, b[:, 3] - b[:, 1])
        kept: list[int] = []
        for i in range(len(b)):
            if kept:
                k = np.array(kept)
                w = np.maximum(0, np.minimum(b[i, 2], b[k, 2]) - np.maximum(b[i, 0], b[k, 0]))
                h = np.maximum(0, np.minimum(b[i, 3], b[k, 3]) - np.maximum(b[i, 1], b[k, 1]))
                both = w * h
                if (both > max_overlap * np.maximum(area[i] + area[k] - both, 1e-12)).any():
                    continue
            kept.append(i)
        return x.iloc[kept]

    some = df.where((F.col(score) >= min_score) & F.col(box).isNotNull() & F.col(frame).isNotNull())
    return by_group(some, [frame], [F.col(score).desc(), *ties], keep, df.schema)


def bake(detections: DataFrame, key: str, vector: str, catalogue: DataFrame, threshold: float, kps: str = "kps", bbox: str = "bbox") -> DataFrame:
    """Geometry rows: detections with a vector, a box and five keypoints, with the identity they match at the lower of
    the threshold and the floor."""
    ok = detections.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & (F.size(kps) == 5) & (F.size(bbox) >= 4))
    hit = best_match(ok, key, vector, catalogue, min(threshold, FLOOR)).select(key, F.col("id").alias("identity_id"), "sim")
    return ok.join(hit, key)


def lookup(frames: DataFrame, geometry: DataFrame, live: DataFrame, frame: str = "frame_index") -> DataFrame:
    """Rows of geometry by frame; frames without any take live detections instead; column `baked` tells which."""
    have = geometry.select(frame).distinct()
    a = frames.join(geometry, frame).withColumn("baked", F.lit(True))
    b = frames.join(have, frame, "left_anti").join(live, frame).withColumn("baked", F.lit(False))
    return a.unionByName(b, allowMissingColumns=True)


def per_frame(detections: DataFrame, frame: str, pos: str, *columns: str) -> DataFrame:
    """frame, faces: detections of a frame as an array in order."""
    return detections.groupBy(frame).agg(F.array_sort(F.collect_list(F.struct(pos, *columns))).alias("faces"))


def apply_chain(frames: DataFrame, processors: list, schema: str | None = None) -> DataFrame:
    """Frames through a chain of processors, each set up once in a worker and released at its end; an empty chain passes all.

    A processor has setup(), process(rows: pandas.DataFrame) -> pandas.DataFrame and release().
    """
    if not processors:
        return frames

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in processors:
            p.setup()
        try:
            for x in batches:
                for p in processors:
                    x = p.process(x)
                yield x
        finally:
            for p in processors:
                p.release()

    return frames.mapInPandas(run, schema or frames.schema)


def coverage(geometry: DataFrame, target: str, frame: str) -> DataFrame:
    """target, faces, frames: how many faces, in how many frames."""
    return geometry.groupBy(target).agg(F.count("*").alias("faces"), F.count_distinct(frame).alias("frames"))


def with_defaults(geometry: DataFrame) -> DataFrame:
    """Geometry of any age with all columns: what older tables lack is null, no roll and no vector."""
    kinds = {"frame_index": "long", "pos": "int", "identity_id": "string", "bbox": "array<double>", "kps": "array<double>", "embedding": "array<float>", "roll": "double"}
    return geometry.select(*[F.col(c).cast(k) if c in geometry.columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items()])


def stored(geometry: DataFrame, vector: str = "embedding", roll: str = "roll") -> DataFrame:
    """`geometry` as it is stored: vectors only if every row has one, all of one length, in half precision; rolls only if
    every row has one."""
    g = geometry.agg((F.bool_and(F.col(vector).isNotNull()) & (F.min(F.size(vector)) == F.max(F.size(vector)))).alias("v"), F.bool_and(F.col(roll).isNotNull()).alias("r")).first()
    keep = lambda c, ok: F.col(c) if ok else F.lit(None).cast(geometry.schema[c].dataType)
    return geometry.withColumn(vector, F.transform(keep(vector, g.v), half)).withColumn(roll, keep(roll, g.r))


def half(x: Column) -> Column:
    """A number as it is after a trip through 16-bit floating point: eleven significant bits, half to even."""
    x = x.cast("double")
    step = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.abs(x))), F.lit(-14)) - 10)
    return F.when(x == 0, x).otherwise(F.rint(x / step) * step)


def same_snapshot(clicks: DataFrame, snapshots: DataFrame, key: str, frame: str) -> DataFrame:
    """Clicks that were made on the frame of the snapshot they refer to."""
    return clicks.join(snapshots.select(key, F.col(frame).alias("_f")), key).where(F.col("_f") == F.col(frame)).drop("_f")


def combined(masks: list[Column]) -> Column:
    """Elementwise minimum of masks of one size."""
    out = masks[0]
    for m in masks[1:]:
        out = F.zip_with(out, m, lambda a, b: F.least(a, b))
    return out


def visible(depth: Column, center: Column, margin: float) -> Column:
    """Pixels that aren't in front of a face: as deep as the median of the centre, up to a share of the spread between the
    5th and 95th percentile. Without spread all are visible."""

    def at(a: Column, q: float) -> Column:
        place = (F.size(a) - 1) * F.lit(q)
        low = F.floor(place).cast("int")
        return F.get(a, low) + (place - low) * (F.get(a, F.least(low + 1, F.size(a) - 1)) - F.get(a, low))

    # the sorted pixels, then the limit, are bound as elements of an array, so that each is computed once
    both = F.array(F.struct(F.array_sort(depth).alias("all"), F.array_sort(center).alias("mid")))
    spreads = F.transform(both, lambda s: F.struct((at(s["all"], 0.95) - at(s["all"], 0.05)).alias("spread"), at(s["mid"], 0.5).alias("mid")))
    limit = F.transform(spreads, lambda s: F.when(s["spread"] > 1e-6, s["mid"] + margin * s["spread"]))
    return F.get(F.transform(limit, lambda m: F.transform(depth, lambda x: F.coalesce(x <= m, F.lit(True)).cast("double"))), 0)


def display_fields(detections: DataFrame) -> DataFrame:
    """What an overlay draws of a detection."""
    return detections.select(*[c for c in ("frame_index", "pos", "bbox", "kps", "det_score", "sex", "age", "pose") if c in detections.columns])
