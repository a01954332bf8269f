"""Folders of frame files %08d.ext as a source and sink of Spark, in batches and streams, and a sink for the newest frame.

Format `frames`: option `path`, `ext` (png), `ranges` (partitions; 8, more for many frames), `frames` (how many there are;
without it the folder is listed once), `pushdown` (false: filters on frame_index open only the files that they leave; see
`frame_files`). Writing stages each task's files, and the job's commit moves them once all tasks are whole, so that a job
that fails shows none; with `staging` (a name) it only tells the folders that are whole, and `moved` moves each one's files.
With `pack` (a number) the files lie in packs: plain zip archives of the frames of as many numbers, none compressed, so that
a small frame takes its bytes and some 120 more instead of a block of the disk. Tasks give a pack's frames in order and none
of another task's packs (`write_files` sees to it). A folder holds packs or single files, and `.packs` marks the former.
Streaming reads deliver each file once, or with `latest` only the newest one of each trigger.

Format `listed_files`, reading only: option `path`, `recursive` (false), `ends` (what names end in, joined by bars), `info`
(false: sizes and times aren't asked for), `ranges` (8, more for a folder of many packs). Tasks list files for themselves
and each keeps its share of them. Frames in packs are listed from the packs' own directories, as pack!/frame, with the
pack's time.

Format `latest_frame`, streaming writes only: option `path`, `ext`, `encoder`. The newest frame so far, encoded once for
each version.

Paths are those of Arrow's file systems: local ones, hdfs, s3, gs, abfs.
"""

from __future__ import annotations

import heapq
import io
import json
import os
import re
import struct
import uuid
import zipfile
import zlib
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import groupby, islice
from operator import itemgetter

import numpy as np
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, EqualNullSafe, EqualTo, GreaterThan,
    GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage,
)

SCHEMA = "frame_index bigint, length bigint, payload binary"
LISTED = "path string, length bigint, mtime_ms bigint"
#: Files that a commit moves at once, and that a staged folder holds.
MOVERS, STAGED = 16, 10_000
#: Frames of a partition, where no number of partitions is asked for and 8 would have more.
RANGE_FRAMES = 20_000
#: Rows and bytes of payload of a batch that a reader gives (one row at least).
BATCH_ROWS, BATCH_BYTES = 1_000, 1 << 23
#: Frames of a pack, and the file that marks a folder of packs and holds that number.
PACK_FRAMES, MARK = 10_000, ".packs"
#: Names of packs, with their first and last numbers and what the frames' names end in.
PACK = re.compile(r"(\d{8,})-(\d{8,})\.([^/]+)\.zip")
#: How payloads become the bytes of a file, by name; real encoders register here.
ENCODERS: dict[str, Callable[[bytes], bytes]] = {"raw": bytes}


def file_system(path: str):
    """(Arrow's file system, path on it)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", path).rstrip("/"))


def file_name(i: int, ext: str) -> str:
    return f"{i:08d}.{ext}"


def entries(path: str) -> Iterator[tuple[str, Callable[[], int], Callable[[], int]]]:
    """(name, its size, its time in ms) of the files of a folder, in no order; a folder that isn't there has none.

    On a local file system the folder is read as it goes, and sizes and times only where they are asked for.
    """
    from pyarrow import fs

    system, root = file_system(path)
    if isinstance(system, fs.LocalFileSystem):
        if os.path.isdir(root):
            with os.scandir(root) as found:
                for e in found:
                    if e.is_file():
                        yield e.name, lambda e=e: e.stat().st_size, lambda e=e: e.stat().st_mtime_ns // 1_000_000
        return
    for f in system.get_file_info(fs.FileSelector(root, allow_not_found=True)):
        if f.is_file:
            yield f.base_name, lambda f=f: f.size, lambda f=f: f.mtime_ns // 1_000_000


def numbers(path: str, ext: str, empty: bool = False) -> np.ndarray:
    """Numbers of the frame files of a folder, in order; empty files are no frames (unless asked for, which no size costs)."""
    end = f".{ext}"
    found = ((n[: -len(end)], size) for n, size, _ in entries(path) if n.endswith(end))
    return np.unique(np.fromiter((int(n) for n, size in found if n.isascii() and n.isdigit() and (empty or size())), np.int64))


def pack_name(k: int, size: int, ext: str) -> str:
    return f"{k * size:08d}-{(k + 1) * size - 1:08d}.{ext}.zip"


def pack_size(path: str) -> int | None:
    """Numbers that a pack of a folder stands for; none, if the folder holds no packs."""
    system, root = file_system(path)
    try:
        with system.open_input_file(f"{root}/{MARK}") as f:
            return int(f.read())
    except FileNotFoundError:
        return None


def packs(path: str, ext: str) -> np.ndarray:
    """First numbers of a folder's packs, in order."""
    return np.unique(np.fromiter((int(m[1]) for n, _, _ in entries(path) if (m := PACK.fullmatch(n)) and m[3] == ext), np.int64))


def members(z: zipfile.ZipFile) -> tuple[np.ndarray, list[zipfile.ZipInfo]]:
    """Numbers of a pack's frames, in order, and where they lie."""
    found = z.infolist()
    return np.array([int(x.filename.split(".")[0]) for x in found], np.int64), found


def opened(system, path: str) -> io.BufferedReader:
    return io.BufferedReader(system.open_input_file(path), 1 << 20)


def unpacked(system, path: str, first: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """A pack's frames of these ranges, in order; a pack that isn't there has none."""
    try:
        f = opened(system, path)
    except FileNotFoundError:
        return
    with f, zipfile.ZipFile(f) as z:
        n, found = members(z)
        at = np.searchsorted(first, n, "right") - 1
        for j in np.flatnonzero((at >= 0) & (n < end[at])).tolist():
            x = found[j]
            if x.compress_type != zipfile.ZIP_STORED:  # somebody else's
                yield int(n[j]), z.read(x)
                continue
            f.seek(x.header_offset + 26)
            f.seek(sum(struct.unpack("<HH", f.read(4))), os.SEEK_CUR)
            data = f.read(x.file_size)
            if zlib.crc32(data) != x.CRC:
                raise zipfile.BadZipFile(f"{x.filename} in {path}")
            yield int(n[j]), data


def write_pack(system, target: str, rows: Iterator[tuple[int, bytes]], ext: str, old: str | None = None) -> None:
    """A pack of rows in order, of equal numbers the last; frames of the pack `old`, if there is one, that rows lack are kept."""
    kept = unpacked(system, old, np.array([0]), np.array([np.iinfo(np.int64).max])) if old else iter(())
    with io.BufferedWriter(system.open_output_stream(target), 1 << 20) as f, zipfile.ZipFile(f, "w") as z:
        for i, same in groupby(heapq.merge(kept, rows, key=itemgetter(0)), itemgetter(0)):
            z.writestr(zipfile.ZipInfo(file_name(i, ext)), deque(same, 1).pop()[1])


def copied(source: str, target: str, staging: str, ext: str, size: int, firsts: Iterator[int]) -> Iterator[str]:
    """The folder under `target` in which a task has staged packs of `source`, byte by byte where the target has no such pack."""
    from pyarrow import fs

    (system, root), (other, there) = file_system(source), file_system(target)
    own = f"{there}/{staging}/{uuid.uuid4().hex}"
    other.create_dir(f"{own}/000000", recursive=True)
    for i in firsts:
        name = pack_name(i // size, size, ext)
        if other.get_file_info(f"{there}/{name}").type == fs.FileType.NotFound:
            fs.copy_files(f"{root}/{name}", f"{own}/000000/{name}", source_filesystem=system, destination_filesystem=other)
        else:
            rows = (r for r in unpacked(system, f"{root}/{name}", np.array([i]), np.array([i + size])) if r[1])
            write_pack(other, f"{own}/000000/{name}", rows, ext, f"{there}/{name}")
    yield own


def mark(path: str, size: int) -> None:
    """Says that a folder holds packs, before it shows any."""
    system, root = file_system(path)
    if pack_size(path) is None:
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/{MARK}-{(own := uuid.uuid4().hex)}") as f:
            f.write(str(size).encode())
        system.move(f"{root}/{MARK}-{own}", f"{root}/{MARK}")


def fits(path: str, ext: str, size: int | None) -> None:
    """Raises if a folder holds frames in another form than packs of `size` (none: single files)."""
    found = pack_size(path)
    if found != size and (found or any(n.endswith(f".{ext}") and n[: -len(ext) - 1].isdigit() for n, _, _ in entries(path))):
        raise ValueError(f"{path} holds {f'packs of {found}' if found else 'single files'}")


#: First numbers of ranges and the numbers behind their last, in order.
Bounds = tuple[np.ndarray, np.ndarray]


def together(some: np.ndarray) -> Bounds:
    """Sorted numbers as ranges."""
    cut = np.flatnonzero(np.diff(some) != 1)
    return some[np.r_[0, cut + 1]] if len(some) else some, some[np.r_[cut, len(some) - 1]] + 1 if len(some) else some


class Ranges(InputPartition):
    """Ranges of frames that one task reads."""

    def __init__(self, first: np.ndarray, end: np.ndarray):
        super().__init__(None)
        self.first, self.end = first, end

    def frames(self) -> Iterator[int]:
        for a, b in zip(self.first, self.end):
            yield from range(int(a), int(b))


def dealt(bounds: Bounds, parts: int | None) -> list[Ranges]:
    """Ranges in as many partitions of about equal size, in order."""
    first, end = bounds
    upto = np.r_[0, np.cumsum(end - first)]
    total = int(upto[-1])
    parts = max(8, -(-total // RANGE_FRAMES)) if parts is None else max(parts, 1)
    step, out = -(-total // parts) or 1, []
    for low in range(0, total, step):
        high = min(low + step, total)
        i, j = int(np.searchsorted(upto, low, "right")) - 1, int(np.searchsorted(upto, high, "left"))
        a, b = first[i:j].copy(), end[i:j].copy()
        a[0] += low - upto[i]
        b[-1] -= upto[j] - high
        out.append(Ranges(a, b))
    return out


class RangedReader(DataSourceReader):
    """A reader of numbered frames that reads no others than filters on frame_index leave."""

    def __init__(self, options, parts: int | None):
        self.parts, self.low, self.high, self.points = int(options["ranges"]) if "ranges" in options else parts, 0, None, None
        self.pushes = options.get("pushdown", "false").lower() == "true"

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            v = getattr(f, "value", None)
            if not self.pushes or tuple(f.attribute) != ("frame_index",) or v is None and not isinstance(f, IsNotNull):
                yield f
            elif isinstance(f, (EqualTo, EqualNullSafe)):
                self.only({v})
            elif isinstance(f, In):
                self.only({x for x in v if x is not None})
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, v + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                end = v + isinstance(f, LessThanOrEqual)
                self.high = end if self.high is None else min(self.high, end)
            elif not isinstance(f, IsNotNull):  # no frame lacks its number
                yield f

    def only(self, some: set) -> None:
        self.points = some if self.points is None else self.points & some

    def there(self) -> Bounds:
        """Ranges that hold the frames that exist, among those asked for."""
        raise NotImplementedError

    def partitions(self) -> list[Ranges]:
        first, end = self.there()
        first, end = np.maximum(first, self.low), end if self.high is None else np.minimum(end, self.high)
        first, end = first[first < end], end[first < end]
        if self.points is not None:
            some = np.array(sorted(self.points), np.int64)
            at = np.searchsorted(first, some, "right") - 1
            first, end = together(some[(at >= 0) & (some < np.r_[end, 0][at])])
        return dealt((first, end), self.parts)


def contents(path: str, ext: str, ranges: Ranges) -> Iterator:
    """Batches of the files of these numbers that exist and aren't empty."""
    import pyarrow as pa

    system, root = file_system(path)
    index, payload, size, per = [], [], 0, pack_size(path)

    def batch():
        return pa.RecordBatch.from_arrays(
            [pa.array(index, pa.int64()), pa.array([len(x) for x in payload], pa.int64()), pa.array(payload, pa.binary())], names=["frame_index", "length", "payload"])

    def single() -> Iterator[tuple[int, bytes]]:
        for i in ranges.frames():
            try:
                with system.open_input_file(f"{root}/{file_name(i, ext)}") as f:
                    yield i, f.read()
            except FileNotFoundError:
                continue

    def in_packs() -> Iterator[tuple[int, bytes]]:
        cut = ((k, max(a, k * per), min(b, (k + 1) * per)) for a, b in zip(ranges.first.tolist(), ranges.end.tolist()) for k in range(a // per, (b - 1) // per + 1))
        for k, some in groupby(cut, itemgetter(0)):
            _, first, end = zip(*some)
            yield from unpacked(system, f"{root}/{pack_name(k, per, ext)}", np.array(first), np.array(end))

    for i, data in in_packs() if per else single():
        if data:
            if index and (len(index) >= BATCH_ROWS or size + len(data) > BATCH_BYTES):
                yield batch()
                index, payload, size = [], [], 0
            index.append(i), payload.append(data)
            size += len(data)
    if index:
        yield batch()


class _Reader(RangedReader):
    def __init__(self, options):
        super().__init__(options, None)
        self.path, self.ext, self.frames = options["path"], options.get("ext", "png"), options.get("frames")

    def there(self) -> Bounds:
        if self.frames:
            return np.array([0]), np.array([int(self.frames)])
        if self.points is None and (size := pack_size(self.path)):
            first, end = together(packs(self.path, self.ext) // size)
            return first * size, end * size
        # a list of frames is read by name, whatever else the folder holds
        return together(numbers(self.path, self.ext, empty=True) if self.points is None else np.array(sorted(self.points), np.int64))

    def read(self, partition: Ranges | None) -> Iterator:
        return contents(self.path, self.ext, partition) if partition else iter(())


@dataclass
class Written(WriterCommitMessage):
    """A task's folder, whose files lie in folders of their own, and numbers of its packs."""

    folder: str
    packs: list[int]


def moved(path: str, own: str, movers: int = 1) -> np.ndarray:
    """Moves what a task has staged in its folder `own` to the folder itself, and tells the names' numbers.

    Files that were staged later replace those staged before. A move is one call to the file system; those that were
    done, by an attempt before this one or one beside it, aren't done again.
    """
    from pyarrow import fs

    system, root = file_system(path)
    _, own = file_system(own)
    found = []

    def move(source: str, target: str) -> None:
        try:
            system.move(source, target)
        except FileNotFoundError:
            if system.get_file_info(target).type == fs.FileType.NotFound:
                raise

    with ThreadPoolExecutor(movers) as pool:
        for part in sorted(f.path for f in system.get_file_info(fs.FileSelector(own))):
            names = [n for n, _, _ in entries(part)]
            for _ in (map if movers == 1 else pool.map)(lambda n: move(f"{part}/{n}", f"{root}/{n}"), names):
                pass
            found.append(np.array([int(re.match(r"-?\d+", n)[0]) for n in names], np.int64))
    return np.concatenate(found) if found else np.empty(0, np.int64)


def whole(path: str, staging: str) -> list[str]:
    """The folders that a job has told to be whole."""
    system, root = file_system(path)
    with system.open_input_file(f"{root}/{staging}/whole.json") as f:
        return json.loads(f.read())


def tidy(path: str, staging: str) -> None:
    from pyarrow import fs

    system, root = file_system(path)
    if system.get_file_info(f"{root}/{staging}").type != fs.FileType.NotFound:
        system.delete_dir(f"{root}/{staging}")


class _Writer(DataSourceArrowWriter):
    def __init__(self, options, overwrite: bool):
        self.path, self.ext, self.overwrite, self.encoder = options["path"], options.get("ext", "png"), overwrite, options.get("encoder", "raw")
        self.told = "staging" in options
        self.staging = options["staging"] if self.told else f".staging-{uuid.uuid4().hex}"
        self.pack = int(options["pack"]) if "pack" in options else None
        fits(self.path, self.ext, self.pack)

    def packed(self, system, root: str, part: str, rows: Iterator[tuple[int, bytes]]) -> Iterator[int]:
        """Stages packs and tells their numbers."""
        def in_order() -> Iterator[tuple[int, bytes]]:
            before = 0
            for i, data in rows:
                if i < before:
                    raise ValueError(f"frame {i} after {before}: packs take frames in order, from 0 on")
                before = i
                yield i, ENCODERS[self.encoder](data)

        for k, some in groupby(in_order(), lambda r: r[0] // self.pack):
            name = pack_name(k, self.pack, self.ext)
            write_pack(system, f"{part}/{name}", some, self.ext, None if self.overwrite else f"{root}/{name}")
            yield k

    def write(self, iterator) -> Written:
        system, root = file_system(self.path)
        own, encode = f"{root}/{self.staging}/{uuid.uuid4().hex}", ENCODERS[self.encoder]
        system.create_dir(own, recursive=True)
        done = []
        try:
            rows = ((i, data) for b in iterator for i, data in zip(b.column("frame_index").to_pylist(), b.column("payload").to_pylist()))
            if self.pack:
                system.create_dir(f"{own}/000000")
                done = list(self.packed(system, root, f"{own}/000000", rows))
            for k in range(1_000_000):
                some = list(islice(rows, 1))
                if not some:
                    break
                part = f"{own}/{k:06d}"
                system.create_dir(part)
                for i, data in (*some, *islice(rows, STAGED - 1)):
                    with system.open_output_stream(f"{part}/{file_name(i, self.ext)}") as f:
                        f.write(encode(data))
        except BaseException:
            system.delete_dir(own)
            raise
        return Written(own, done)

    def commit(self, messages: list[Written | None]) -> None:
        """Only now tasks are known to be whole."""
        folders = [m.folder for m in messages if m]
        system, root = file_system(self.path)
        if self.pack:
            if len(every := [k for m in messages if m for k in m.packs]) > len(set(every)):
                raise ValueError("frames of one pack in several tasks")
            mark(self.path, self.pack)
        if self.told:
            system.create_dir(f"{root}/{self.staging}", recursive=True)
            with system.open_output_stream(f"{root}/{self.staging}/whole.json") as f:
                f.write(json.dumps(folders).encode())
            return
        new = [moved(self.path, own, MOVERS) for own in folders]
        if self.overwrite:
            there = packs(self.path, self.ext) if self.pack else numbers(self.path, self.ext)
            for n in np.setdiff1d(there, np.concatenate([np.empty(0, np.int64), *new])).tolist():
                system.delete_file(f"{root}/{pack_name(n // self.pack, self.pack, self.ext) if self.pack else file_name(n, self.ext)}")
        tidy(self.path, self.staging)

    def abort(self, messages: list[Written | None]) -> None:
        tidy(self.path, self.staging)


class _StreamReader(DataSourceStreamReader):
    """Offsets are the number behind the newest file; files are expected in the order of their numbers."""

    def __init__(self, options):
        self.path, self.ext, self.parts = options["path"], options.get("ext", "png"), int(options["ranges"]) if "ranges" in options else None
        self.newest = options.get("latest", "false").lower() == "true"

    def initialOffset(self) -> dict:  # noqa: N802
        return {"next": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        if size := pack_size(self.path):
            last = packs(self.path, self.ext)[-1:].tolist()
            system, root = file_system(self.path)
            for i in last:
                with opened(system, f"{root}/{pack_name(i // size, size, self.ext)}") as f, zipfile.ZipFile(f) as z:
                    return {"next": int(members(z)[0][-1]) + 1}
            return {"next": 0}
        return {"next": int(max(numbers(self.path, self.ext), default=-1)) + 1}

    def partitions(self, start: dict, end: dict) -> list[Ranges]:
        a, b = start["next"], end["next"]
        return dealt((np.array([max(a, b - 1) if self.newest else a]), np.array([b])), 1 if self.newest else self.parts) if a < b else []

    def read(self, partition: Ranges) -> Iterator:
        return contents(self.path, self.ext, partition)


class FrameFiles(DataSource):
    """Format `frames`: a folder of frame files."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options, overwrite)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(self.options)


class Share(InputPartition):
    """The files whose paths' hash leaves the first of `value` of the second, all tasks' number."""


class _ListedReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.parts = options["path"], int(options["ranges"]) if "ranges" in options else None
        self.recursive, self.info = (options.get(x, "false").lower() == "true" for x in ("recursive", "info"))
        self.ends = tuple(options["ends"].split("|")) if "ends" in options else ("",)

    def partitions(self) -> list[Share]:
        from pyarrow import fs

        system, root = file_system(self.path)
        if system.get_file_info(root).type != fs.FileType.Directory:
            raise FileNotFoundError(f"no folder {self.path}")
        parts = self.parts or max(8, sum(1 for n, _, _ in entries(self.path) if PACK.fullmatch(n)) // 32 if pack_size(self.path) else 0)
        return [Share((k, parts)) for k in range(parts)]

    def folders(self) -> Iterator[str]:
        """The folder, and all below it that aren't hidden; those that can't be read are passed over."""
        from pyarrow import fs

        system, root = file_system(self.path)
        todo = [root]
        while todo:
            yield (one := todo.pop())
            if not self.recursive:
                return
            try:
                if isinstance(system, fs.LocalFileSystem):
                    with os.scandir(one) as found:
                        below = [e.path for e in found if e.is_dir()]
                else:
                    below = [f.path for f in system.get_file_info(fs.FileSelector(one)) if f.type == fs.FileType.Directory]
            except OSError:
                if one == root:
                    raise
                continue
            todo += [p for p in below if not hidden(p.rsplit("/", 1)[1])]

    def read(self, partition: Share) -> Iterator:
        import pyarrow as pa

        system, root = file_system(self.path)
        shown = f"file:{root}" if system.type_name == "local" else self.path.rstrip("/")
        share, parts = partition.value

        def rows() -> Iterator[tuple]:
            for one in self.folders():
                packed = pack_size(one) is not None
                try:
                    for name, size, time in entries(one):
                        at, pack = f"{one}/{name}", packed and PACK.fullmatch(name)
                        if hidden(name) or not (pack or name.endswith(self.ends)) or zlib.crc32(at.encode("utf-8", "surrogateescape")) % parts != share:
                            continue
                        if pack:
                            yield from in_pack(at, time)
                            continue
                        try:
                            yield (shown + at[len(root) :], size(), time()) if self.info else (shown + at[len(root) :], None, None)
                        except OSError:  # it went, or can't be read
                            continue
                except OSError:
                    continue

        def in_pack(at: str, time: Callable[[], int]) -> Iterator[tuple]:
            try:
                with opened(system, at) as f, zipfile.ZipFile(f) as z:
                    found, told = z.infolist(), time() if self.info else None
            except FileNotFoundError:  # it went
                return
            except OSError as e:  # too many frames to pass over
                raise RuntimeError(f"can't read the pack {at}") from e
            yield from ((f"{shown}{at[len(root) :]}!/{x.filename}", x.file_size if self.info else None, told) for x in found if x.filename.endswith(self.ends))

        todo = rows()
        while some := list(islice(todo, STAGED)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), (pa.string(), pa.int64(), pa.int64()))], names=["path", "length", "mtime_ms"])


def hidden(name: str) -> bool:
    """Whether Spark's own readers pass over a file or folder of this name."""
    return name.startswith(".") or name.startswith("_") and "=" not in name


class ListedFiles(DataSource):
    """Format `listed_files`: the files of a folder; contents are never read."""

    @classmethod
    def name(cls) -> str:
        return "listed_files"

    def schema(self) -> str:
        return LISTED

    def reader(self, schema) -> DataSourceReader:
        return _ListedReader(self.options)


@dataclass
class Newest(WriterCommitMessage):
    """A task's newest frame."""

    frame_index: int
    payload: bytes


class LatestWriter(DataSourceStreamWriter):
    """Keeps `latest.json` (version, batch, frame_index, file) and the file that it names.

    A batch that was committed before, or holds nothing newer, changes no version; a frame is encoded when it becomes one.
    """

    def __init__(self, options):
        self.path, self.ext, self.encoder = options["path"], options.get("ext", "jpg"), options.get("encoder", "raw")

    def write(self, iterator) -> Newest | None:
        newest = max(iterator, key=lambda r: r.frame_index, default=None)
        return None if newest is None else Newest(newest.frame_index, bytes(newest.payload))

    def told(self) -> dict:
        system, root = file_system(self.path)
        try:
            with system.open_input_file(f"{root}/latest.json") as f:
                return json.loads(f.read())
        except FileNotFoundError:
            return {"version": 0, "batch": -1, "frame_index": -1, "file": None}

    def commit(self, messages: list[Newest | None], batchId: int) -> None:  # noqa: N803
        told = self.told()
        if batchId <= told["batch"]:
            return
        system, root = file_system(self.path)
        system.create_dir(root, recursive=True)
        newest = max((m for m in messages if m), key=lambda m: m.frame_index, default=None)
        old = None
        if newest is not None and newest.frame_index > told["frame_index"]:
            old, version = told["file"], told["version"] + 1
            told |= {"version": version, "frame_index": newest.frame_index, "file": f"frame-{version}.{self.ext}"}
            with system.open_output_stream(f"{root}/{told['file']}") as f:
                f.write(ENCODERS[self.encoder](newest.payload))
        with system.open_output_stream(f"{root}/.latest.tmp") as f:
            f.write(json.dumps(told | {"batch": batchId}).encode())
        system.move(f"{root}/.latest.tmp", f"{root}/latest.json")
        if old:
            system.delete_file(f"{root}/{old}")

    def abort(self, messages: list[Newest | None], batchId: int) -> None:  # noqa: N803
        """Nothing was changed yet."""


class LatestFrame(DataSource):
    """Format `latest_frame`: the newest frame of a stream."""

    @classmethod
    def name(cls) -> str:
        return "latest_frame"

    def schema(self) -> str:
        return SCHEMA

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:  # noqa: N802
        return LatestWriter(self.options)
