"""Column functions on vectors, boxes and sizes. All are built-in Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalize(a: Column) -> Column:
    """Unit length in double precision; the zero vector stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n == 0, x.cast("double")).otherwise(x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    """Dot product of unit vectors; -1 if one is empty or null or their lengths differ."""
    bad = a.isNull() | b.isNull() | (F.size(a) == 0) | (F.size(a) != F.size(b))
    return F.when(bad, F.lit(-1.0)).otherwise(dot(a, b))


def bbox4(a: Column) -> Column:
    """The first four numbers of a box, null if there are fewer."""
    return F.when(F.size(a) >= 4, F.transform(F.slice(a, 1, 4), lambda x: x.cast("double")))


def pose3(a: Column) -> Column:
    """(pitch, yaw, roll), all null if there are fewer than three numbers."""
    ok = F.coalesce(F.size(a) >= 3, F.lit(False))
    return F.struct(*[F.when(ok, F.get(a, i)).cast("double").alias(n) for i, n in enumerate(("pitch", "yaw", "roll"))])


def even_floor(x: Column) -> Column:
    return F.greatest(x - F.pmod(x, F.lit(2)), F.lit(2))


def scaled_dims(w: Column, h: Column, scale: Column) -> Column:
    """Size for processing: half-even rounding, then down to even numbers, 2 at least; scales of 1 and more change nothing."""
    side = lambda x: F.when(scale >= 1, x.cast("int")).otherwise(even_floor(F.bround(x * scale).cast("int")))
    return F.struct(side(w).alias("width"), side(h).alias("height"))


def rescale(a: Column, frame: Column, baked: Column) -> Column:
    """Coordinates baked at another size in the frame's scale; unchanged if the sizes are equal or unknown."""
    same = baked.isNull() | (baked <= 0) | (baked == frame)
    return F.transform(a, lambda x: F.when(same, x).otherwise(x * (frame / baked)))


def center(a: Column) -> Column:
    return F.struct(((F.get(a, 0) + F.get(a, 2)) / 2).alias("x"), ((F.get(a, 1) + F.get(a, 3)) / 2).alias("y"))


def box_contains(a: Column, x: Column, y: Column) -> Column:
    return (x >= F.get(a, 0)) & (x <= F.get(a, 2)) & (y >= F.get(a, 1)) & (y <= F.get(a, 3))


def roll_of_eyes(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Angle of the line from the first to the second eye, in degrees."""
    return F.degrees(F.atan2(y2 - y1, x2 - x1))


def landmark_five(points: Column) -> Column:
    """Five points from 68: the middles of both eyes, the nose tip and the corners of the mouth."""
    total = lambda a, n, k: F.aggregate(F.slice(points, a + 1, n), F.lit(0.0), lambda s, p: s + p[k])
    mean = lambda a, n: F.struct(*[(total(a, n, k) / n).alias(k) for k in ("x", "y")])
    one = lambda i: F.struct(*[F.get(points, i)[k].cast("double").alias(k) for k in ("x", "y")])
    return F.when(F.size(points) == 68, F.array(mean(36, 6), mean(42, 6), one(30), one(48), one(54)))


def compute_roll(baked: Column, landmark: Column, pose: Column, keypoints: Column) -> Column:
    """The first known of: baked angle, angle by landmarks, by pose, by keypoints; 0 without any."""
    return F.coalesce(baked, landmark, pose, keypoints, F.lit(0.0))


def gaussian(distance: Column, sigma: Column) -> Column:
    return F.exp(-(distance * distance) / (2 * sigma * sigma))


def interpolate(x: Column, x0: float, x1: float, y0: float, y1: float) -> Column:
    """Linear between two points, constant beyond."""
    return y0 + F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - x0) / (x1 - x0))) * (y1 - y0)
