"""Column functions of keys, signatures, names of outputs and sidecars, and the parsing of tool output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import parent, stem


def _digest(kind: str, n: int, parts: list[Column], sep: str = "|") -> Column:
    text = F.concat_ws(sep, *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts])
    return F.substring(F.sha1(text) if kind == "sha1" else F.sha2(text, 256), 1, n)


def fixed(x: Column, digits: int) -> Column:
    """A number with so many decimal digits, ties to even."""
    return F.call_function("format_number", x.cast("double"), F.lit("0." + "0" * digits))


def target_key(path: Column) -> Column:
    """A target's sidecars: sha1 of its canonical path."""
    return _digest("sha1", 16, [path])


def session_key(source: Column, target: Column, writer: Column, scale: Column, chain: Column) -> Column:
    """A session's frames: source, target, writer, scale to four digits and, by processor, name and (unless empty) settings.

    `chain` is an array of (name, identity).
    """
    links = F.flatten(F.transform(chain, lambda p: F.filter(F.array(p["name"], p["identity"]), lambda x: x.isNotNull() & (x != ""))))
    head = F.array(source, target, writer, F.concat(F.lit("scale="), fixed(scale, 4)))
    return F.substring(F.sha2(F.array_join(F.concat(head, links), "|"), 256), 1, 16)


def pairs_text(ranges: Column) -> Column:
    """Ranges as text: [(1, 2), (5, 6)]."""
    one = F.transform(ranges, lambda r: F.concat(F.lit("("), r["start"].cast("string"), F.lit(", "), r["end"].cast("string"), F.lit(")")))
    return F.concat(F.lit("["), F.array_join(one, ", "), F.lit("]"))


def stage_folder(i: Column, name: Column, size: Column, source: Column, target: Column, sections: Column) -> Column:
    """A stage's frames, by place, name, size of output and what is rendered; settings don't count, so that edits resume."""
    return F.concat(F.lit("stage"), i.cast("string"), F.lit("-"), name, F.lit("@"), size, F.lit("-"), _digest("sha1", 10, [source, target, sections]))


def chain_fingerprint(source: Column, target: Column, size: Column, sections: Column) -> Column:
    return _digest("sha1", 12, [source, target, size, sections])


def thumbnail_key(version: Column, path: Column, mtime_ns: Column, size: Column, side: Column) -> Column:
    return _digest("sha256", 24, [version, path, mtime_ns, size, side])


def scan_signature(stride: Column, detector: Column, size: Column, fast: Column, threshold: Column, sections: Column) -> Column:
    """What a scan depends on, as text; only a scan of the same signature is resumed."""
    return F.concat_ws("|", stride.cast("string"), detector, size.cast("string"), fast.cast("int").cast("string"), fixed(threshold, 4), sections)


def resumable(saved: Column, now: Column) -> Column:
    return F.coalesce(saved == now, F.lit(False))


def output_path(explicit: Column, folder: Column, source: Column, target: Column, video: Column) -> Column:
    """Where a job's result goes: its own path, else the common folder, else beside the target, under source+target."""
    name = F.concat(stem(source), F.lit("+"), stem(target), F.when(video, ".mp4").otherwise(""))
    return F.coalesce(explicit, F.concat(F.coalesce(folder, parent(target)), F.lit("/"), name))


def sidecar(root: Column, target: Column, kind: str) -> Column:
    """Path of a target's catalogue, geometry or progress under a root folder."""
    end = {"catalogue": ".json", "geometry": ".geometry.npz", "progress": ".progress.json"}[kind]
    return F.concat(root, F.lit("/"), target_key(target), F.lit(end))


def valid_id(ident: Column) -> Column:
    """Whether an id is safe as a file name: no separators, no way up."""
    return ident.isNotNull() & ~ident.contains("/") & ~ident.contains("\\") & ~ident.contains("..")


def inside(path: Column, root: Column) -> Column:
    """Whether a path without links lies below a root, and so may be deleted; the root itself may not."""
    top = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    return path.startswith(top) & (F.rtrim(path, F.lit("/")) != F.rtrim(root, F.lit("/"))) & ~path.rlike(r"(^|/)\.\.?(/|$)")


def content_signature(luma: Column, levels: int = 16) -> Column:
    """Sixteen grey levels of a small picture as hex digits; equal signatures count as equal content."""
    return F.array_join(F.transform(luma, lambda x: F.lower(F.hex(F.floor(x / (256 // levels)).cast("long")))), "")


def progress_frame(line: Column) -> Column:
    """The counter of a `frame=N` line, else null."""
    return F.try_to_number(F.nullif(F.regexp_extract(line, r"^frame=\s*(\d+)\s*$", 1), F.lit("")), F.lit("999999999999")).cast("long")


def gpu_row(line: Column) -> Column:
    """(name, driver, capability) of a line of comma-separated values; null if name or driver lacks."""
    p = F.transform(F.split(line, ","), lambda x: F.trim(x))
    at = lambda i: F.nullif(F.coalesce(F.get(p, i), F.lit("")), F.lit(""))
    row = F.struct(at(0).alias("name"), at(1).alias("driver"), F.nullif(at(2), F.lit("[N/A]")).alias("capability"))
    return F.when(at(0).isNotNull() & at(1).isNotNull(), row)


def stream_probe(rate: Column, frames: Column, seconds: Column) -> Column:
    """(fps, frame_count) of a stream: the rate is text like 30000/1001, 30 if it can't be read; without a count of frames
    that of its length."""
    a, b = F.split(rate, "/")[0].try_cast("double"), F.get(F.split(rate, "/"), 1)
    over = F.when(b.isNull() | (b == ""), F.lit(1.0)).otherwise(b.try_cast("double"))
    fps = F.when(a.isNull() | over.isNull() | (over <= 0), 30.0).otherwise(a / F.nullif(over, F.lit(0.0)))
    count = F.coalesce(frames.try_cast("long"), F.floor(seconds.try_cast("double") * fps).cast("long"), F.lit(0).cast("long"))
    return F.struct(fps.alias("fps"), count.alias("frame_count"))


def audio_plan(audio: Column, segments: Column, copyable: Column) -> Column:
    """(mode, filter) of a job's audio: none; cut to segments (an array of from_s, to_s), joined and encoded; copied;
    encoded."""
    cut = F.transform(segments, lambda s, i: F.concat(
        F.lit("[1:a]atrim=start="), fixed(s["from_s"], 6), F.lit(":end="), fixed(s["to_s"], 6), F.lit(",asetpts=PTS-STARTPTS[a"), i.cast("string"), F.lit("]")))
    names = F.array_join(F.transform(segments, lambda s, i: F.concat(F.lit("[a"), i.cast("string"), F.lit("]"))), "")
    graph = F.concat(F.array_join(cut, ";"), F.lit(";"), names, F.lit("concat=n="), F.size(segments).cast("string"), F.lit(":v=0:a=1[outa]"))
    trimmed = segments.isNotNull() & (F.size(segments) > 0)
    mode = F.when(~audio, "none").when(trimmed, "cut").when(copyable, "copy").otherwise("encode")
    return F.struct(mode.alias("mode"), F.when(audio & trimmed, graph).alias("filter"))


def sync_line(t: Column, target: Column, shown: Column, video_s: Column, audio_s: Column, playing: Column, mode: Column) -> Column:
    """One line of a trace: offset of audio to video, and how far the display lags."""
    offset = audio_s - video_s
    return F.format_string("sync t=%s target=%d shown=%d video=%ss audio=%ss offset=%s%ss lag=%df playing=%d mode=%s", fixed(t, 3), target, shown, fixed(video_s, 3),
                           fixed(audio_s, 3), F.when(offset < 0, "").otherwise("+"), fixed(offset, 3), target - shown, playing.cast("int"), mode)
