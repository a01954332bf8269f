"""Best-fit packing of tokenized documents into sequences of fixed length, by sum of squares.

Documents are tokenized whole; those over a sequence are cut into full pieces and a rest. Full pieces are sequences of
their own. The others go by a hash into groups of about `GROUP` pieces, packed in parallel; in a group, longest first,
each goes into the open sequence (or a new one) for which the sum, over all residual gaps, of the squared number of open
sequences with that gap becomes smallest. What the groups leave open is packed once more, each open sequence as one
piece, until all of it fits one group or hardly any two fit together.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .arrowtext import is_space, small_batches, text_bytes
from .units import Known, Tokens, cut, ids_of

LENGTH, END_ID, GROUP = 2048, 0, 25_000
TOKENIZER = "word_bpe_49k.json"
#: Bytes of units and their ids that a worker remembers; beyond half of it, those stay that were used since the last time.
MAX_CACHE_BYTES = 160_000_000
#: Bytes of text that are cut into units at a time (one word at least).
SPLIT_BYTES = 1 << 22
#: Open sequences that are broadcast after they were packed again; more are joined by a shuffle.
MAX_BROADCAST_OPEN = 500_000

_loaded: dict = {}


def word_ids(path: str):
    """[tokenizer, units and their ids, those known before them] of this worker process."""
    if path not in _loaded:
        _loaded[path] = [Tokens(path), Known(), Known()]
    return _loaded[path]


def blocks(raw: np.ndarray, off: np.ndarray, most_bytes: int) -> Iterator[tuple[int, int]]:
    """(first, behind the last) byte of stretches of about `most_bytes` that end at a white space or with a text; one word at least."""
    a, n = 0, len(raw)
    while a < n:
        b, size = n, most_bytes
        while a + size < n:  # a word longer than that makes it larger
            ends = np.flatnonzero(is_space(raw[a + 1 : a + size + 1]))[-1:] + a + 1
            b = max([*ends.tolist(), int(off[np.searchsorted(off, a + size, "right") - 1])])
            if b > a:
                break
            b, size = n, 2 * size
        yield a, b
        a = b


def encoded(raw: np.ndarray, off: np.ndarray, path: str) -> list[bytes]:
    """The ids of each text as bytes, little-endian 32-bit numbers; a text of any length is encoded in stretches."""
    known, flat, ends = word_ids(path), [], np.zeros(len(off), np.int64)
    for a, b in blocks(raw, off, SPLIT_BYTES):
        if known[1].size > MAX_CACHE_BYTES // 2:
            known[1:] = Known(), known[1]
        tokens, now, before = known
        units, place, odd = cut(raw[a:b], off[(off >= a) & (off < b)] - a)
        ids, count = ids_of(units, odd, tokens, now, before)
        flat.append(ids)
        ends += np.append(0, np.cumsum(count))[np.searchsorted(place, np.clip(off, a, b) - a)]
    data = np.concatenate(flat).tobytes() if flat else b""
    return [data[4 * x : 4 * y] for x, y in zip(ends[:-1], ends[1:])]


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    small_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()
    out = "piece int, start long, length long, ids_crc32 long"
    d = docs.select(F.col("doc_id"), F.col("text"))
    kind = d.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = text_bytes(b.column(1))
            row, piece, start, size, crc = [], [], [], [], []
            for i, ids in enumerate(encoded(raw, off, path)):
                ids += end
                for k, s in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[s : s + 4 * length]
                    row.append(i), piece.append(k), start.append(s // 4), size.append(len(part) // 4), crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, size, crc)]],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return d.mapInArrow(run, f"doc_id {kind}, {out}")


def sum_of_squares(sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each size in the given order. Ties go to the smallest gap left, then to what is open."""
    count = np.zeros(length + 1, np.int64)
    open_bins: list[list[int]] = [[] for _ in range(length + 1)]
    bins, offsets, n = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), 0
    never = np.int64(1) << 60
    for i, s in enumerate(sizes.tolist()):
        # from gap g to g - s: (n[g] - 1)^2 - n[g]^2 + (n[g-s] + 1)^2 - n[g-s]^2; full ones are not open
        at = count[s:length]
        change = np.where(at > 0, 2 - 2 * at, never)
        if len(change):
            change[0] -= 1
            change[1:] += 2 * count[1 : length - s]
            k = int(change.argmin())
        if len(change) and change[k] <= 2 * count[length - s] + 1:
            b = open_bins[s + k].pop()
            count[s + k] -= 1
        else:
            b, k, n = n, length - s, n + 1
        bins[i], offsets[i] = b, length - k - s
        if k:
            count[k] += 1
            open_bins[k].append(b)
    return bins, offsets


def together(items: DataFrame, length: int, group: int, level: int = 0) -> DataFrame:
    """item, sequence_id, offset of `items` (item, size), in groups; open sequences of several groups are packed again."""
    count = items.count()
    n = max(1, -(-count // group))

    def pack(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["size", "item"], ascending=[False, True])
        b, offset = sum_of_squares(x["size"].to_numpy(), length)
        return x.assign(sequence_id=(level << 58) + (x["pack_group"].to_numpy(np.int64) << 32) + b, offset=offset).drop(columns="pack_group")

    placed = items.withColumn("pack_group", F.pmod(F.xxhash64("item"), F.lit(n))).groupBy("pack_group").applyInPandas(
        pack, "item long, size long, sequence_id long, offset long")
    if n == 1:
        return placed.select("item", "sequence_id", "offset")
    placed = common.written(placed)
    left = placed.groupBy("sequence_id").agg(F.sum("size").alias("size")).where(F.col("size") < length)
    left = common.written(left.withColumnRenamed("sequence_id", "item"))
    if 2 * left.count() > count:  # most pieces are alone: packing them again would find nothing new
        return placed.select("item", "sequence_id", "offset")
    again = together(left, length, group, level + 1).select(F.col("item").alias("sequence_id"), F.col("sequence_id").alias("into"), F.col("offset").alias("at"))
    placed = placed.join(common.small(again, MAX_BROADCAST_OPEN), "sequence_id", "left")
    return placed.select("item", F.coalesce("into", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("at", F.lit(0))).alias("offset"))


def packed(parts: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """The columns of `pieces` with sequence_id and offset."""
    parts = common.written(parts.withColumn("item", F.monotonically_increasing_id()))
    rest = parts.where(F.col("length") < length)
    some = rest.join(together(rest.select("item", F.col("length").alias("size")), length, group), "item")
    full = parts.where(F.col("length") >= length).select("*", (-1 - F.col("item")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return full.unionByName(some).drop("item")


def best_fit_pack(docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID, group: int = GROUP) -> DataFrame:
    """One row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are the end id alone; repeated rows are packed each; texts of any length are read whole; an
    empty table gives an empty result; further columns of `docs` are ignored.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    return packed(pieces(docs, path, length, end_id), length, group)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(common.documents(spark, sf_dir))
