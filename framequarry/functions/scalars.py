"""Column functions of playback, progress, keys and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions by kind (fixed values); video is tested first.
VIDEO = ("mp4", "m4v", "mov", "avi", "mkv", "webm", "wmv", "flv", "f4v", "mpg", "mpeg", "mpe", "m2v", "ts", "m2ts", "mts", "3gp", "3g2", "ogv", "vob", "asf", "divx", "rm", "rmvb")
IMAGE = ("png", "jpg", "jpeg", "jfif", "bmp", "tiff", "tif", "webp", "gif", "ppm", "pgm", "pbm", "tga")


def required_prefill(frames: Column, rate: Column, fps: Column) -> Column:
    """Frames that must be ready before playback: all if a rate is unknown, none if processing keeps up."""
    return F.when(frames <= 0, 0).when((rate <= 0) | (fps <= 0), frames).when(rate >= fps, 0).otherwise(
        F.greatest(F.lit(0), frames - F.floor(frames * rate / F.nullif(fps, F.lit(0))))).cast("long")


def sparse_prefill(fps: Column, rate: Column, cushion: Column) -> Column:
    """Head start of a cushion of seconds; none if processing keeps up or there is nothing to play or hold."""
    return F.when((fps <= 0) | (cushion <= 0), 0).when(rate >= fps, 0).otherwise(F.ceil(cushion * fps)).cast("long")


def predictive_lead(fps: Column, rate: Column, in_flight: Column, ahead: Column, cap_seconds: Column | None = None) -> Column:
    """Frames to aim ahead: what passes while all that may be in flight finishes, within the look-ahead and, if there is
    one, the cap; 0 without a rate."""
    bounds = [ahead] if cap_seconds is None else [ahead, F.floor(cap_seconds * fps)]
    lead = F.least(F.ceil(in_flight * fps / F.nullif(rate, F.lit(0))), *bounds)
    return F.when(rate.isNull() | (rate <= 0), 0).otherwise(F.greatest(F.lit(0), lead)).cast("long")


def stride(fps: Column, rate: Column) -> Column:
    return F.when((rate <= 0) | (fps <= 0), 1).otherwise(F.greatest(F.lit(1), F.ceil(fps / F.nullif(rate, F.lit(0))))).cast("long")


def frame_at(anchor: Column, seconds: Column, fps: Column, last: Column, playing: Column) -> Column:
    """Frame of a clock: the anchor plus whole frames passed while playing, within 0 and the last frame."""
    run = anchor + F.floor(seconds * fps)
    return F.greatest(F.lit(0), F.least(last, F.when(playing, run).otherwise(anchor))).cast("long")


def range_seconds(start: Column, end: Column, fps: Column) -> Column:
    return F.struct((start / fps).alias("from_s"), ((end + 1) / fps).alias("to_s"))


def shortfall_fails(claimed: Column, decoded: Column, fps: Column) -> Column:
    """Whether so few frames were decoded that a job must fail: over two seconds, ten frames at least, are missing."""
    return (claimed - decoded) > F.greatest(F.bround(2 * fps), F.lit(10))


def tick_seconds(playing: Column, fps: Column, paused: float = 0.1, least: float = 0.001) -> Column:
    return F.when(~playing | (fps <= 0), F.lit(paused)).otherwise(F.greatest(F.lit(least), 1 / F.nullif(fps, F.lit(0))))


def percent_text(done: Column, total: Column, stage: Column, stages: Column, name: Column) -> Column:
    """Progress of a step, like `[1/2] 15% (1500/10000, name)`; empty without a total. Stages count from 0; halves of a
    percent go to the even number."""
    share = F.bround(done / F.nullif(total, F.lit(0)) * 100).cast("long")
    line = F.format_string("[%d/%d] %d%% (%d/%d, %s)", (stage + 1).cast("long"), stages.cast("long"), share, done.cast("long"), total.cast("long"), name)
    return F.when(total <= 0, "").otherwise(line)


def clock_text(seconds: Column) -> Column:
    """Whole seconds as `M:SS`, from an hour on as `H:MM:SS`; the first part isn't padded."""
    s = seconds.cast("long")
    hours, minutes = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60)
    short = F.format_string("%d:%02d", minutes, F.pmod(s, F.lit(60)))
    return F.when(hours != 0, F.format_string("%d:%02d:%02d", hours, minutes, F.pmod(s, F.lit(60)))).otherwise(short)


def size_text(size: Column) -> Column:
    """Bytes in the largest unit of 1024 that leaves one at least, up to TB; whole bytes, else one decimal, halves to even."""
    n = size.cast("double")
    units = ["B", "KB", "MB", "GB", "TB"]
    one = lambda i: F.bround(n / 1024.0**i, 1)
    text = F.format_string("%.1f TB", one(4))
    for i in range(3, -1, -1):
        own = F.format_string("%d B", size.cast("long")) if i == 0 else F.format_string(f"%.1f {units[i]}", one(i))
        text = F.when(n < 1024.0 ** (i + 1), own).otherwise(text)
    return text


def short_hash(kind: str, n: int, *parts: Column) -> Column:
    """First n hex digits of sha1 or sha256 of the parts joined by a bar."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.substring(F.sha1(text) if kind == "sha1" else F.sha2(text, 256), 1, n)


def extension(path: Column) -> Column:
    """Lower-case extension without its dot, empty if there is none; a dot that begins a name begins no extension."""
    return F.lower(F.regexp_extract(path, r"[^/\\]\.([^./\\]+)$", 1))


def normal_extensions(exts) -> tuple[str, ...]:
    """Extensions as they are compared: lower case, without leading dots, empty ones left out."""
    return tuple(sorted({e.lower().lstrip(".") for e in exts if e}))


def media_kind(path: Column, video=None, image=None) -> Column:
    """video, image or other, by the given extensions; without any, by the usual ones."""
    e = extension(path)
    return F.when(e.isin(*(normal_extensions(video or ()) or VIDEO)), "video").when(e.isin(*(normal_extensions(image or ()) or IMAGE)), "image").otherwise("other")


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def version_key(text: Column) -> Column:
    """Numbers of a dotted version; text before the digits of a part is skipped, parts without digits are 0."""
    return F.transform(F.split(text, r"\."), lambda x: F.coalesce(F.try_to_number(F.regexp_extract(x, r"(\d+)", 1), F.lit("999999999")).cast("int"), F.lit(0)))


def is_newer(a: Column, b: Column) -> Column:
    """Whether version a is above b; missing parts count as 0."""
    n = F.greatest(F.size(version_key(a)), F.size(version_key(b)))
    full = lambda x: F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(F.get(version_key(x), i), F.lit(0)))
    return full(a) > full(b)


def sex_matches(mode: Column, sex: Column) -> Column:
    """Both and either take all; else the sexes must be equal, and an unknown one fails."""
    return F.when(mode.isin("B", "I"), True).otherwise(F.coalesce(mode == sex, F.lit(False)))


def det_size(size: Column) -> Column:
    """A detector's side: a multiple of 32, 32 at least."""
    return F.greatest(F.lit(32), size - F.pmod(size, F.lit(32)))
