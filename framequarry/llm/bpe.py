"""Byte-pair encoding and decoding by contiguous arrays of ranks.

The words of a batch that a worker hasn't met are cut into pieces as the tokenizer's file says. A short piece is a row of
two arrays, its parts' ids and the ranks of neighbouring parts; all pieces of one length are a matrix. Again and again
the smallest rank of every row is found, the boundary there is deleted, and the ranks on both sides are looked up anew,
until no row has a rank left. Pieces over `SHORT` bytes take a heap of ranks instead, which gives the same order of
merges in n log n steps. Decoding looks up each id's string and joins them.
"""

from __future__ import annotations

import gc
import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .arrowtext import small_batches, text_bytes
from .memory import Memory

TOKENIZER = "word_bpe_49k.json"
#: Bytes of the longest piece that is a row of a matrix.
SHORT = 48
#: Bytes of words and of pieces with their ids that a worker remembers, each.
WORD_BYTES, PIECE_BYTES = 100_000_000, 50_000_000
#: Words that are cut and merged at a time, and bytes of text (one text at least).
WORDS, SPLIT_BYTES = 50_000, 1 << 22
NONE = np.int32(2**31 - 1)
#: How the tokenizer cuts ASCII text in lower case (a fixed rule of its file).
ASCII_PIECE = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\x09-\x0d a-z0-9]+")

_loaded: dict = {}


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else one from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    odd = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(odd)) for b in range(256)]


class Ranks:
    """A tokenizer file as arrays: ids of bytes within and at the end of a piece, and what pairs of ids merge to."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        model = told["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int32)
        self.last = np.array([vocab[c + end] for c in letters], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        by = np.argsort(left << 32 | right, kind="stable")
        self.pairs, self.order = (left << 32 | right)[by], by.astype(np.int32)
        self.rank_of = {(a, b): i for i, (a, b) in enumerate(zip(left.tolist(), right.tolist()))}
        self.special = {t["content"].encode(): t["id"] for t in told["added_tokens"]}
        self.cut = re.compile(b"(" + b"|".join(re.escape(s) for s in self.special) + b")")
        size = 1 + max([*vocab.values(), *self.special.values()])
        tokens: list = [None] * size
        for text, i in [*vocab.items(), *((s.decode(), i) for s, i in self.special.items())]:
            tokens[i] = text
        self.tokens = pa.array(tokens, pa.string())
        tokenizer = Tokenizer.from_file(path)
        self.normal, self.split = tokenizer.normalizer, tokenizer.pre_tokenizer
        self.words, self.pieces = Memory(WORD_BYTES), Memory(PIECE_BYTES)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, NONE where they don't merge."""
        want = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, want), len(self.pairs) - 1)
        return np.where(self.pairs[at] == want, self.order[at], NONE)

    def short(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces of one length, merged together."""
        n, rows = len(pieces[0]), np.arange(len(pieces))
        raw = np.frombuffer(b"".join(pieces), np.uint8).reshape(len(pieces), n)
        ids = self.inner[raw]
        ids[:, -1] = self.last[raw[:, -1]]
        rank = np.full((len(pieces), n), NONE, np.int32)
        rank[:, :-1] = self.ranks(ids[:, :-1], ids[:, 1:])
        size = np.full(len(pieces), n)
        done, sizes, column = np.zeros((len(pieces), n), "<u4"), np.empty(len(pieces), int), np.arange(n)
        while len(rows):
            at = rank.argmin(1)
            k = np.arange(len(rows))
            best = rank[k, at]
            still = best < NONE
            done[rows[~still]], sizes[rows[~still]] = ids[~still], size[~still]
            rows, ids, rank, size, at, best = (x[still] for x in (rows, ids, rank, size, at, best))
            k = np.arange(len(rows))
            # the part behind the boundary goes: all further ones move one place to the left
            ids[k, at] = self.merged[best]
            move = np.minimum(column + (column > at[:, None]), n - 1)
            ids, rank = np.take_along_axis(ids, move, 1), np.take_along_axis(rank, move, 1)
            rank[:, -1] = NONE
            size -= 1
            right = at + 1 < size
            rank[k, at] = NONE
            rank[k[right], at[right]] = self.ranks(ids[k[right], at[right]], ids[k[right], at[right] + 1])
            left = at > 0
            rank[k[left], at[left] - 1] = self.ranks(ids[k[left], at[left] - 1], ids[k[left], at[left]])
        flat = done.tobytes()
        return [flat[a : a + 4 * k] for a, k in zip(range(0, len(flat), 4 * n), sizes.tolist())]

    def long(self, piece: bytes) -> bytes:
        """Ids of one piece of any length, by a heap of ranks; of equal ranks the leftmost comes first."""
        raw = np.frombuffer(piece, np.uint8)
        ids = self.inner[raw].tolist()
        ids[-1] = int(self.last[raw[-1]])
        n, rank_of = len(ids), self.rank_of
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank_of.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or rank_of.get((ids[i], ids[j])) != r:
                continue
            ids[i], ids[j], after[i] = int(self.merged[r]), -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := rank_of.get((ids[a], ids[b]))) is not None:
                    heapq.heappush(heap, (r, a))
        return np.array([x for x in ids if x >= 0], "<u4").tobytes()

    def merged_pieces(self, pieces: list) -> list[bytes]:
        """Ids of each piece; a special token is its id."""
        by: dict = {}
        for p in pieces:
            by.setdefault(-1 if isinstance(p, int) else len(p) if len(p) <= SHORT else 0, []).append(p)
        out: dict = {}
        for n, some in by.items():
            out.update(zip(some, self.short(some) if n > 0 else map(self.long, some) if n == 0 else [np.array([p], "<u4").tobytes() for p in some]))
        return [out[p] for p in pieces]

    def cut_plain(self, texts: list[str]) -> list[list[bytes]]:
        """Pieces of each text without white space or special tokens, by the library's own normal form and rule."""
        joined = self.normal.normalize_str(" ".join(texts))
        starts = np.cumsum([0] + [len(w) + 1 for w in joined.split(" ")])
        out: list = [[] for _ in texts]
        if len(starts) != len(texts) + 1:  # a white space came or went: one at a time
            if len(texts) > 1:
                return [self.cut_plain([t])[0] for t in texts]
            starts = np.array([0, len(joined) + 1])
        w = 0
        for _, (a, b) in self.split.pre_tokenize_str(joined):
            while a >= starts[w + 1]:
                w += 1
            out[w].append(joined[a:b].encode())
        return out

    def cut_words(self, words: list[bytes]) -> list[list]:
        """Pieces of each word as bytes in normal form; special tokens as their ids."""
        out: list = [None] * len(words)
        odd: list[tuple[int, int, str]] = []  # word, place in it, text
        for i, w in enumerate(words):
            special = b"<|" in w
            if w.isascii() and not special:
                low = w.lower()
                if low.isalpha():
                    out[i] = [low]
                else:  # one mark at the end is a piece
                    out[i] = [low[:-1], low[-1:]] if low[:-1].isalpha() and not low[-1:].isdigit() else ASCII_PIECE.findall(low)
            else:
                parts = self.cut.split(w) if special else [w]
                out[i] = [self.special.get(p, p) if k % 2 else p for k, p in enumerate(parts)]
                odd += [(i, k, p.decode()) for k, p in enumerate(parts) if not k % 2]
        for (i, k, _), got in zip(odd, self.cut_plain([t for _, _, t in odd]) if odd else []):
            out[i][k] = got
        for i in {i for i, _, _ in odd}:
            out[i] = [y for x in out[i] for y in (x if isinstance(x, list) else [x])]
        return out

    def ids_of_words(self, words: list[bytes]) -> Iterator[bytes]:
        for a in range(0, len(words), WORDS):
            cut = self.cut_words(words[a : a + WORDS])
            ids = self.pieces.known(set().union(*cut), self.merged_pieces).__getitem__
            yield from [ids(c[0]) if len(c) == 1 else b"".join(map(ids, c)) for c in cut]

    def encoded(self, raw: np.ndarray, off: np.ndarray) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers. No token holds white space and none spans it."""
        data, collects = raw.tobytes(), gc.isenabled()
        gc.disable()  # many small lists, none in a cycle
        try:
            split = [data[a:b].split() for a, b in zip(off[:-1], off[1:])]
            ids = self.words.known(set().union(*split), self.ids_of_words)
            return [b"".join(map(ids.__getitem__, ws)) for ws in split]
        finally:
            gc.enable() if collects else None


def loaded(path: str) -> Ranks:
    """The tokenizer of this worker process."""
    if path not in _loaded:
        _loaded[path] = Ranks(path)
    return _loaded[path]


def default_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def runs(off: np.ndarray, most_bytes: int) -> Iterator[tuple[int, int]]:
    """(first, behind the last) of neighbouring texts with at most so many bytes together; one text at least."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most_bytes, "right")) - 1)
        yield i, j
        i = j


def numbered(df: DataFrame, keep: list[str], last: Column) -> DataFrame:
    """The columns `keep` under numbers, as their names may hold anything, and `last`."""
    quoted = [F.col("`" + c.replace("`", "``") + "`") for c in keep]
    return df.select(*[c.alias(f"c{i}") for i, c in enumerate(quoted)], last.alias("last"))


def bpe_encode(docs: DataFrame, path: str | None = None, text: str = "text", ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all by default) of `docs` and `ids`, the token ids of its column `text`.

    Null and empty texts, and those of white space alone, have no ids; equal rows have a row each; texts of any length
    are read whole; an empty table gives an empty result. A column of the name `ids` is replaced.
    """
    path = path or default_path()
    small_batches(docs.sparkSession)
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() != ids.lower()]
    d = numbered(docs, keep, F.col(text))
    schema = T.StructType([*d.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = loaded(path)
        for b in batches:
            raw, off = text_bytes(b.column(len(keep)))
            for i, j in runs(off, SPLIT_BYTES):
                got = ranks.encoded(raw[off[i] : off[j]], off[i : j + 1] - off[i])
                ends = np.cumsum([0] + [len(x) // 4 for x in got])
                flat = pa.array(np.frombuffer(b"".join(got), "<i4"), pa.int32())
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([*[c.slice(i, j - i) for c in b.columns[:-1]], lists], names=schema.names)

    return d.mapInArrow(run, schema).toDF(*keep, ids)


def bpe_decode(rows: DataFrame, path: str | None = None, ids: str = "ids", text: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all by default) of `rows` and `text`, the strings of its `ids` joined by spaces.

    That is the text of a tokenizer file without a decoder; special tokens stay. Null or no ids give an empty text; ids
    that the vocabulary lacks, and nulls, are left out. A column of the name `text` is replaced.
    """
    path = path or default_path()
    small_batches(rows.sparkSession)
    keep = [c for c in (rows.columns if keep is None else keep) if c.lower() != text.lower()]
    d = numbered(rows, keep, F.coalesce(F.col(ids).cast("array<int>"), F.array().cast("array<int>")))
    schema = T.StructType([*d.schema.fields[:-1], T.StructField("text", T.StringType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = loaded(path).tokens
        for b in batches:
            lists = b.column(len(keep))
            ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            flat, ends = flat[ends[0] : ends[-1]], ends - ends[0]
            known = (flat >= 0) & (flat < len(tokens))  # a null among them is not a number, and unknown
            if not known.all():
                ends, flat = np.concatenate([[0], np.cumsum(known)])[ends], flat[known]
            strings = tokens.take(pa.array(flat, pa.int32()))
            texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), strings), " ")
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], texts], names=schema.names)

    return d.mapInArrow(run, schema).toDF(*keep, text)


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's ids and their decoded text as digests."""
    coded = bpe_encode(common.documents(spark, sf_dir), keep=["doc_id"])
    both = bpe_decode(coded)
    return both.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
