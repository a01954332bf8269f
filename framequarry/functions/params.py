"""Parameters of processors: bounds that values must keep, and what a task gives to each processor."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Smallest and largest value of each parameter, None for none (fixed values).
BOUNDS = {
    "detection_interval": (1, None), "detection_size": (64, None), "rotation_threshold_deg": (0, 90), "landmark_min_score": (0.0, 1.0),
    "temporal_window": (1, 199), "temporal_strength": (0.0, 1.0), "upscale": (1, 4), "codeformer_fidelity": (0.0, 1.0), "tile": (0, None),
}
#: Task fields that a processor reads, by the name it knows them by.
SHARED = {c: f"swapper_{c}" for c in ("rotation_compensation", "rotation_threshold_deg", "rotation_redetect", "rotation_angle_source")}
PROJECTIONS = {
    "swapper": {c: f"swapper_{c}" for c in ("model", "detection_interval", "detection_size", "detector", "many_faces", "target_sex", "temporal_window", "temporal_strength")} | SHARED,
    "enhancer": {c: f"enhancer_{c}" for c in ("model", "upscale", "codeformer_fidelity", "fp16")} | SHARED,
    "upscaler": {c: f"upscaler_{c}" for c in ("model", "tile", "fp16")},
}


def out_of_bounds(**values: Column) -> Column:
    """Names of the parameters whose value is missing or beyond its bounds."""
    wrong = []
    for name, value in values.items():
        low, high = BOUNDS[name]
        ok = F.lit(True)
        if low is not None:
            ok = ok & (value >= low)
        if high is not None:
            ok = ok & (value <= high)
        wrong.append(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)))
    return F.array_sort(F.filter(F.array(*wrong), lambda x: x.isNotNull()))


def parameters(processor: str, columns: list[str]) -> Column:
    """A task's parameters for a processor as one struct; fields that the task lacks are left out."""
    return F.struct(*[F.col(c).alias(n) for n, c in PROJECTIONS[processor].items() if c in columns])


def resolved_sex(wanted: Column, source_sex: Column) -> Column:
    """Which sex is swapped: as wanted, or the source's (all, if that is unknown) where AS_SOURCE is."""
    return F.when(wanted != "AS_SOURCE", wanted).when(source_sex.isin("M", "F"), source_sex).otherwise("BOTH")


def refined(raw: Column, fine: Column, score: Column, least: Column) -> Column:
    """Refined landmarks if their score reaches the least, else the raw ones."""
    return F.when(fine.isNotNull() & (score >= least), fine).otherwise(raw)


def shown_meta(score: Column, sex: Column, age: Column, pitch: Column, yaw: Column, roll: Column, baked_roll: Column) -> Column:
    """What is shown for a face rebuilt from geometry: score 1 if unknown; a pose only with pitch and yaw, its roll the
    baked one, else the identity's, else 0."""
    pose = F.when(pitch.isNotNull() & yaw.isNotNull(), F.array(pitch, yaw, F.coalesce(baked_roll, roll, F.lit(0.0))).cast("array<double>"))
    return F.struct(F.coalesce(score, F.lit(1.0)).alias("det_score"), sex.alias("sex"), age.alias("age"), pose.alias("pose"))
