"""Exact removal of byte strings that occur earlier in the corpus, one suffix bucket at a time.

Every suffix of a text is looked at to a depth of `LENGTH` bytes. A cover sample picks positions so that two suffixes
that agree to that depth have a sampled position at the same distance: the smallest of the hashed `Q`-byte strings
within the depth (the leftmost of equal ones). It thins the positions more than a periodic difference cover of the same
depth does, and neighbouring suffixes share a sampled position; such a run of suffixes travels as one record, with the
sample's rank (the hash at the sampled position) and a digest of all its bytes. Suffixes that agree lie in one rank's
bucket.

Buckets are read in sorted order as a stream. Records of one digest agree in all suffixes, so all but the earliest are
settled by rank alone, however long the copies are. Only the earliest records of a rank with several digests are sorted
suffix by suffix. Nothing holds more than a bounded piece of a bucket: buckets of many different records are dealt out
anew by suffix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common
from .arrowtext import small_batches, text_bytes
from .quality_net import runs
from .shingles import BYTE, mixed, powers

LENGTH, Q = 100, 20
#: Different records of one rank that are sorted together; larger buckets are dealt out by suffix.
MOST_TOGETHER = 4096
#: Ranks of larger buckets are broadcast up to so many.
MAX_BROADCAST_RANKS = 500_000
#: Ids of several rows are broadcast up to so many.
MAX_BROADCAST_IDS = 500_000
PLACE_BITS = 21
_LOW = np.uint64((1 << PLACE_BITS) - 1)


def prefix_sums(raw: np.ndarray) -> np.ndarray:
    c = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(BYTE[raw] * powers("base", len(raw)), out=c[1:])
    return c


def records(raw: np.ndarray, off: np.ndarray, length: int = LENGTH, q: int = Q) -> tuple[np.ndarray, ...]:
    """(row, rank, digest, first start, last start, sampled place) of the runs of suffixes; places count from the text's start.

    The texts have under 2**PLACE_BITS bytes together.
    """
    w = length - q + 1
    whole = np.diff(off) >= length
    if not whole.any():
        return tuple(np.empty(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64, np.int64))
    lo, hi = off[:-1][whole], off[1:][whole]
    n, c = len(raw), prefix_sums(raw)
    inverse = powers("inverse", n + 1)
    h = mixed((c[q:] - c[:-q]) * inverse[: n - q + 1])
    # sliding minimum of w sampled strings for each start: suffix and prefix minima of blocks of w
    key = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    x = np.full(-(-(len(key) + w) // w) * w, np.uint64(2**64 - 1))
    x[: len(key)] = key
    y = x.reshape(-1, w)
    before = np.minimum.accumulate(y, 1).ravel()
    after = np.minimum.accumulate(y[:, ::-1], 1)[:, ::-1].ravel()
    n_windows = n - length + 1
    top = np.minimum(after[:n_windows], before[w - 1 : w - 1 + n_windows])
    place = (top & _LOW).astype(np.int64)
    inside = np.zeros(n_windows + 1, np.int32)
    np.add.at(inside, lo, 1), np.add.at(inside, hi - length + 1, -1)
    inside = np.cumsum(inside[:-1]) > 0
    new = np.ones(n_windows, bool)
    new[1:] = (place[1:] != place[:-1]) | (inside[1:] != inside[:-1])
    new[lo] = True
    s = np.flatnonzero(new)
    e = np.append(s[1:], n_windows) - 1
    s, e = s[inside[s]], e[inside[s]]
    at = place[s]
    digest = mixed(mixed((c[e + length] - c[s]) * inverse[s]) + (((at - s) << 8) | (e - s)).astype(np.uint64))
    row = np.searchsorted(off, s, "right") - 1
    zero = off[row]
    return row, h[at], digest, s - zero, e - zero, at - zero


def sliced_records(raw: np.ndarray, off: np.ndarray, length: int, q: int, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, ...]]:
    """The records of all texts, about `most` bytes at a time; longer texts in parts that overlap, so that no suffix is missed."""
    for i, j in runs(off, most):
        a, b = int(off[i]), int(off[j])
        if b - a <= most:
            row, *rest = records(raw[a:b], off[i : j + 1] - off[i], length, q)
            yield row + i, *rest
            continue
        for k in range(a, b, most):
            part = raw[k : min(b, k + most + length - 1)]
            row, rank, digest, s, e, at = records(part, np.array([0, len(part)]), length, q)
            yield row + i, rank, digest, s + k - a, e + k - a, at + k - a


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, id (never null), kd (tells different texts of one id apart), text (never null), times (rows equal in both).

    Texts of an id that several rows have are compared as texts, and each different one is numbered in a table; all
    others have number 0.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"), text.alias("text"))
    once = d.select("doc_id", "id", F.lit(0).cast("long").alias("kd"), "text", F.lit(1).cast("long").alias("times"))
    many = common.written(d.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"))
    if many.isEmpty():
        return once
    many = common.small(many, MAX_BROADCAST_IDS)
    again = d.join(many, "id").groupBy("doc_id", "id", "text").agg(F.count("*").alias("times"))
    again = common.written(again.withColumn("kd", 1 + F.monotonically_increasing_id()))
    return once.join(many, "id", "left_anti").unionByName(again)


def record_table(d: DataFrame, length: int, q: int) -> DataFrame:
    """rank, digest, id, kd, at (sampled place << 16 | distance of the first start << 8 | of the last), copy.

    Of equal records that a task meets in one batch only the earliest goes to its bucket, with those of other texts that
    have its very id and place. The others are copies for certain; they travel by a rank of their own, so that no bucket
    grows with the number of its copies.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, kd = b.column(0).to_numpy(), b.column(1).to_numpy()
            raw, off = text_bytes(b.column(2))
            parts = list(sliced_records(raw, off, length, q))
            if not parts:
                continue
            row, rank, digest, s, e, at = (np.concatenate(x) for x in zip(*parts))
            ident, at = ids[row], (at << 16) | ((at - s) << 8) | (at - e)
            order = np.lexsort((at, ident, digest, rank))
            row, rank, digest, ident, at = (x[order] for x in (row, rank, digest, ident, at))
            first = np.ones(len(row), bool)
            first[1:] = (rank[1:] != rank[:-1]) | (digest[1:] != digest[:-1])
            of = np.flatnonzero(first)[np.cumsum(first) - 1]
            copy = (ident != ident[of]) | (at != at[of])
            rank = np.where(copy, mixed(ident.view(np.uint64) + mixed(at.view(np.uint64))), rank)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rank.view(np.int64)), pa.array(digest.view(np.int64)), pa.array(ident), pa.array(at), pa.array(kd[row]), pa.array(copy)],
                names=["rank", "digest", "id", "at", "kd", "copy"])

    return d.select("id", "kd", "text").mapInArrow(run, "rank long, digest long, id long, at long, kd long, copy boolean")


def settled(table: DataFrame, length: int) -> DataFrame:
    """Of sorted records: lo, hi of starts that an earlier equal record has; and the earliest records of ranks with several digests (lo null).

    Records of an id and place with the earliest, which other texts of that id have, are earliest too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, head, several, waiting = (None, None), (0, 0), False, None

        def out(rank, ids, kd, at, copies: bool) -> pa.RecordBatch:
            place, a, b = at >> 16, (at >> 8) & 255, at & 255
            lo = pa.array(place - a) if copies else pa.nulls(len(at), pa.int64())
            hi = pa.array(place - b) if copies else pa.nulls(len(at), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(rank), pa.array(ids), pa.array(kd), pa.array(at), lo, hi], names=["rank", "id", "kd", "at", "lo", "hi"])

        for b in batches:
            rank, digest, ids, at, kd, copy = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            if copy.any():
                yield out(rank[copy], ids[copy], kd[copy], at[copy], True)
                rank, digest, ids, at, kd = (x[~copy] for x in (rank, digest, ids, at, kd))
            if not len(rank):
                continue
            first = np.ones(len(rank), bool)
            first[1:] = (rank[1:] != rank[:-1]) | (digest[1:] != digest[:-1])
            if last == (rank[0], digest[0]):
                first[0] = False
            f = np.flatnonzero(first)
            # against the earliest of its digest; what has its very id and place isn't later
            of = np.concatenate([[-1], f])[np.cumsum(first)]
            later = ~first & ((ids != np.where(of < 0, head[0], ids[of])) | (at != np.where(of < 0, head[1], at[of])))
            if later.any():
                yield out(rank[later], ids[later], kd[later], at[later], True)
            level = ~first & ~later
            if level.any():
                yield out(rank[level], ids[level], kd[level], at[level], False)
            if len(f):
                head = (ids[f[-1]], at[f[-1]])
            if len(f):
                r = rank[f]
                cut = np.concatenate([[0], np.flatnonzero(r[1:] != r[:-1]) + 1])
                size = np.diff(np.append(cut, len(r)))
                goes_on = r[0] == last[0]
                many = size > 1
                if goes_on:
                    many[0] = True
                    if waiting is not None:
                        yield out(*(x[None] for x in waiting), False)
                waiting = None
                keep = np.repeat(many, size)
                k = f[keep]
                if len(k):
                    yield out(rank[k], ids[k], kd[k], at[k], False)
                several = bool(many[-1])
                if not several:
                    z = f[-1]
                    waiting = (rank[z], ids[z], kd[z], at[z])
            last = (rank[-1], digest[-1])

    kinds = "rank long, id long, kd long, at long, lo long, hi long"
    return table.repartition("rank").sortWithinPartitions("rank", "digest", "id", "at").select("rank", "digest", "id", "at", "kd", "copy").mapInArrow(run, kinds)


def with_texts(d: DataFrame, rows: DataFrame, extra: list[str]) -> DataFrame:
    """id, kd, kind (0: a text, 1: a row about it), doc_id, text, times and the `extra` columns; texts stand before their rows."""
    texts = d.select("id", "kd", F.lit(0).alias("kind"), "doc_id", "text", "times",
                     *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in extra])
    about = rows.select("id", "kd", F.lit(1).alias("kind"), F.lit(None).cast(d.schema["doc_id"].dataType).alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit(0).cast("long").alias("times"), *extra)
    return texts.unionAll(about).repartition("id", "kd").sortWithinPartitions("id", "kd", "kind")


def suffixes(d: DataFrame, firsts: DataFrame, length: int) -> DataFrame:
    """The bytes of the records that are sorted suffix by suffix: rank, id, kd, at, big, bytes; one row of two 8-byte hashes for each suffix if big."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, text = None, b""
        for b in batches:
            ids, kd, kind = (b.column(i).to_numpy() for i in range(3))
            texts = b.column(4)
            rank, at, big = (b.column(i).fill_null(0 if i < 8 else False).to_numpy(zero_copy_only=False) for i in (6, 7, 8))
            out: list[tuple] = []
            for i in range(len(ids)):
                if kind[i] == 0:
                    key, text = (ids[i], kd[i]), texts[i].as_py().encode()
                elif key == (ids[i], kd[i]):
                    a = int(at[i])
                    place, s, e = a >> 16, (a >> 8) & 255, a & 255
                    part = text[place - s : place - e + length]
                    if not big[i]:
                        out.append((int(rank[i]), ids[i], kd[i], a, False, part))
                    else:
                        x = np.frombuffer(part, np.uint8)
                        c = prefix_sums(x)
                        m = s - e + 1
                        h = mixed((c[length : length + m] - c[:m]) * powers("inverse", m)).view(np.int64)
                        # beside the hash, other 64 bits of the same bytes
                        out += [(int(h[j]), ids[i], kd[i], place - s + j, True, hashlib.blake2b(part[j : j + length], digest_size=8).digest()) for j in range(m)]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()))],
                    names=["rank", "id", "kd", "at", "big", "bytes"])

    return with_texts(d, firsts, ["rank", "at", "big"]).mapInArrow(run, "rank long, id long, kd long, at long, big boolean, bytes binary")


def repeated_starts(s: np.ndarray, flag: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, lo, hi) of runs of flagged neighbours with one owner."""
    at = np.flatnonzero(flag)
    if not len(at):
        return at, at, at
    cut = np.concatenate([[0], np.flatnonzero((np.diff(at) != 1) | (owner[at[1:]] != owner[at[:-1]])) + 1])
    ends = np.append(cut[1:], len(at)) - 1
    return owner[at[cut]], s[at[cut]], s[at[ends]]


def beyond_first(new: np.ndarray, ids: np.ndarray, start: np.ndarray, head: tuple | None = None) -> np.ndarray:
    """Which of neighbours in groups (`new`: one begins) have another id or start than the first of their group.

    `head` is the first of the group that the rows before began.
    """
    first = np.flatnonzero(new)
    of = np.concatenate([[-1], first])[np.cumsum(new)]
    own = of >= 0
    return (ids != np.where(own, ids[of], head[0] if head else 0)) | (start != np.where(own, start[of], head[1] if head else 0))


def sorted_buckets(rows: DataFrame, length: int) -> DataFrame:
    """id, kd, lo, hi: starts whose suffix an earlier record of the bucket has; each bucket is whole and of bounded size."""

    def settle(t: pa.Table) -> pa.RecordBatch:
        ids, kd, at = (t.column(i).to_numpy() for i in (1, 2, 3))
        place, s, e = at >> 16, (at >> 8) & 255, at & 255
        data = b"".join(t.column(5).to_pylist())
        size = s - e + length
        zero = np.cumsum(size) - size
        c = prefix_sums(np.frombuffer(data, np.uint8))
        m = s - e + 1
        owner = np.repeat(np.arange(len(ids)), m)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(m) - m, m)
        x = zero[owner] + k
        h = mixed((c[x + length] - c[x]) * powers("inverse", len(data) + 1)[x])
        order = np.argsort(h, kind="stable")  # records come by id and place, so the earliest of equal suffixes is first
        same = np.flatnonzero(h[order[1:]] == h[order[:-1]])
        equal = np.zeros(len(h), bool)  # in that order, to the one before
        window = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), length)
        for i in range(0, len(same), 20_000):  # neighbours of one hash are held against each other byte by byte
            at = same[i : i + 20_000]
            equal[at + 1] = (window[x[order[at + 1]]] == window[x[order[at]]]).all(1)
        again = np.zeros(len(h), bool)
        again[order] = beyond_first(~equal, ids[owner[order]], ((place - s)[owner] + k)[order])
        o, lo, hi = repeated_starts((place - s)[owner] + k, again, owner)
        return pa.RecordBatch.from_arrays([pa.array(ids[o]), pa.array(kd[o]), pa.array(lo), pa.array(hi)], names=["id", "kd", "lo", "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            rank = b.column(0).to_numpy()
            last = int(np.searchsorted(rank, rank[-1]))  # the last bucket may go on
            if held and last == 0 and held[-1].column(0)[-1].as_py() == rank[0]:
                held.append(b)
                continue
            if last or held:
                yield settle(pa.Table.from_batches([*held, b.slice(0, last)]))
            held = [b.slice(last)]
        if held:
            yield settle(pa.Table.from_batches(held))

    return rows.repartition("rank").sortWithinPartitions("rank", "id", "at").mapInArrow(run, "id long, kd long, lo long, hi long")


def dealt_suffixes(rows: DataFrame) -> DataFrame:
    """id, kd, lo, hi: of single suffixes by two hashes (128 bits), all but the earliest; one row is kept in mind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = head = None
        for b in batches:
            h, ids, kd, at = (b.column(i).to_numpy() for i in range(4))
            if not len(h):
                continue
            other = np.frombuffer(b"".join(b.column(4).to_pylist()), np.int64)
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (other[1:] != other[:-1])
            new[0] = last != (h[0], other[0])
            again = beyond_first(new, ids, at, head)
            last = (h[-1], other[-1])
            if new.any():
                z = np.flatnonzero(new)[-1]
                head = (ids[z], at[z])
            yield pa.RecordBatch.from_arrays([pa.array(ids[again]), pa.array(kd[again]), pa.array(at[again]), pa.array(at[again])], names=["id", "kd", "lo", "hi"])

    rows = rows.select("rank", "id", "kd", "at", "bytes").repartition("rank").sortWithinPartitions("rank", "bytes", "id", "at")
    return rows.mapInArrow(run, "id long, kd long, lo long, hi long")


def without_repeats(d: DataFrame, ranges: DataFrame, length: int, with_text: bool) -> DataFrame:
    kind, arrow_kind = d.schema["doc_id"].dataType.simpleString(), to_arrow_type(d.schema["doc_id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, doc, text, times = None, None, b"", 1
        lo: list[np.ndarray] = []
        hi: list[np.ndarray] = []

        def result() -> tuple:
            x = np.frombuffer(text, np.uint8)
            edge = np.zeros(len(x) + 1, np.int32)
            if lo:
                np.add.at(edge, np.concatenate(lo), 1)
                np.add.at(edge, np.concatenate(hi) + length, -1)
            gone = np.cumsum(edge[:-1]) > 0
            kept = x[~gone].tobytes() if lo else text
            spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(x) else 0
            row = (doc, len(x), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
            return (*row, *([kept.decode("utf-8", "replace")] if with_text else []), times)

        for b in batches:
            ids, kd, what = (b.column(i).to_numpy() for i in range(3))
            starts, ends = (b.column(i).to_numpy(zero_copy_only=False) for i in (6, 7))
            out: list[tuple] = []
            cuts = np.concatenate([[0], np.flatnonzero((ids[1:] != ids[:-1]) | (kd[1:] != kd[:-1])) + 1, [len(ids)]]) if len(ids) else [0]
            for s, e in zip(cuts[:-1], cuts[1:]):
                if key != (ids[s], kd[s]):
                    if key is not None:
                        out.append(result())
                    key, doc, text, times, lo, hi = (ids[s], kd[s]), b.column(3)[s].as_py(), b.column(4)[s].as_py().encode(), b.column(5)[s].as_py(), [], []
                n_texts = int((what[s:e] == 0).sum())
                if s + n_texts < e:
                    lo.append(starts[s + n_texts : e].astype(np.int64)), hi.append(ends[s + n_texts : e].astype(np.int64))
            if out:
                yield batch(out)
        if key is not None:
            yield batch([result()])

    fields = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text + ", times long"

    def batch(out: list[tuple]) -> pa.RecordBatch:
        names = [f.split()[0] for f in fields.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(x) if i else pa.array(x, arrow_kind) for i, x in enumerate(zip(*out))], names=names)

    found = with_texts(d, ranges, ["lo", "hi"]).mapInArrow(run, fields)
    return found.withColumn("times", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("times")


def suffix_dedup(docs: DataFrame, length: int = LENGTH, q: int = Q, with_text: bool = False, most_together: int = MOST_TOGETHER) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of `docs` (and kept_text).

    Removed is each byte covered by a `length`-byte string that also starts earlier: in a smaller doc_id (null: the
    smallest), or earlier in the same text. Null texts count as empty; texts under `length` bytes lose nothing; rows
    that repeat id and text get equal results and none is earlier; an empty table gives an empty result; further
    columns are ignored.
    """
    small_batches(docs.sparkSession)
    d = keyed(docs)
    table = record_table(d, length, q)
    known = common.written(settled(table, length))
    copies = known.where("lo is not null").select("id", "kd", "lo", "hi")
    firsts = known.where("lo is null").select("rank", "id", "kd", "at")
    # only the few large ranks are looked for among the records, which needn't be dealt out by rank for it
    big = firsts.groupBy("rank").agg(F.count("*").alias("size")).where(F.col("size") > most_together).select("rank", F.lit(True).alias("big"))
    firsts = firsts.join(common.small(common.written(big), MAX_BROADCAST_RANKS), "rank", "left").withColumn("big", F.coalesce("big", F.lit(False)))
    parts = common.written(suffixes(d, firsts, length))
    sorted_out = common.written(sorted_buckets(parts.where("not big"), length).unionAll(dealt_suffixes(parts.where("big"))))
    common.dropped(parts)
    ranges = copies.unionAll(sorted_out)
    return without_repeats(d, ranges, length, with_text)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(common.documents(spark, sf_dir))
