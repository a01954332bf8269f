"""Language-model scores of texts by the likelihood of all their segmentations into subwords.

The pieces are those of a public tokenizer's vocabulary, each as the inside or the end of a word; its ranks give the
first scores (probability falling with the rank), which one expectation step over the training words' lattices, in
Spark, turns into unigram scores. A word's probability is the sum over all ways to cut it into pieces, by the forward
recursion in log space; a text's is the product over its words and one end. Every distinct word is scored once;
frequent words reach the texts by a broadcast of bounded size, all others by a shuffled join.
"""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .arrowtext import small_batches, text_bytes

VOCABULARY, END_OF_WORD = "word_bpe_49k.json", "</w>"
#: Words that a task counts before it hands them on, and bytes of text that it reads for it, which bounds their length.
MAX_COUNTER, MAX_COUNTED_BYTES = 300_000, 1 << 27
#: Words whose scores are broadcast at most, the most frequent ones of up to MANY bytes.
MAX_FREQUENT = 200_000
#: Added to each piece's expected count, so that all stay possible.
ADDED = 0.01
#: Words over so many bytes are summed one at a time, in linear time.
MANY = 64
PRIME = np.uint64(0x9E3779B97F4A7C15)
_NONE = np.float64(-np.inf)


def byte_pieces(path: str) -> list[tuple[bytes, bool]]:
    """(bytes, ends a word) of the vocabulary by rank; single bytes come first and are all there.

    Byte-level vocabularies write printable Latin-1 bytes as themselves and the others as the characters from 256 on.
    """
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    vocab = json.load(open(path))["model"]["vocab"]
    out = [(bytes([b]), end) for end in (False, True) for b in range(256)]
    seen = set(out)
    for text in sorted(vocab, key=vocab.get):
        end = text.endswith(END_OF_WORD)
        text = text.removesuffix(END_OF_WORD)
        if text and all(c in of for c in text):
            piece = (bytes(of[c] for c in text), end)
            if piece not in seen:
                seen.add(piece)
                out.append(piece)
    return out


def powers(n: int) -> np.ndarray:
    p = np.full(n + 1, PRIME, np.uint64)
    p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


class Lattice:
    """Forward and backward sums over the segmentations of words, for many words of one length at a time."""

    def __init__(self, pieces: list[tuple[bytes, bool]], scores: np.ndarray):
        """scores: natural logarithms of the pieces' probabilities."""
        self.scores = np.append(scores, _NONE)
        self.n = len(pieces)
        self.longest = max(len(p) for p, _ in pieces)
        self.keys, self.ids = [], []
        for end in (False, True):
            ids = np.array([i for i, p in enumerate(pieces) if p[1] == end], np.int64)
            keys = np.array([self.key(pieces[i][0]) for i in ids], np.uint64)
            order = np.argsort(keys)
            self.keys.append(keys[order]), self.ids.append(ids[order])

    @staticmethod
    def key(b: bytes) -> int:
        h = 0
        for x in b:
            h = (h * int(PRIME) + x + 1) & (2**64 - 1)
        return h

    def find(self, keys: np.ndarray, end: bool) -> np.ndarray:
        """Piece numbers; n where there is none."""
        at = np.minimum(np.searchsorted(self.keys[end], keys), len(self.keys[end]) - 1)
        return np.where(self.keys[end][at] == keys, self.ids[end][at], self.n)

    def edges(self, words: np.ndarray) -> dict[tuple[int, int], np.ndarray]:
        """Piece numbers of words[:, i:j] by (i, j)."""
        _, length = words.shape
        pre = np.zeros((length + 1, len(words)), np.uint64)
        for j in range(length):
            pre[j + 1] = pre[j] * PRIME + words[:, j].astype(np.uint64) + np.uint64(1)
        p = powers(self.longest)
        return {(i, j): self.find(pre[j] - pre[i] * p[j - i], j == length)
                for j in range(1, length + 1) for i in range(max(0, j - self.longest), j)}

    def forward(self, words: np.ndarray, edges: dict | None = None) -> np.ndarray:
        """alpha: (length + 1, words)."""
        edges = self.edges(words) if edges is None else edges
        length = words.shape[1]
        alpha = np.zeros((length + 1, len(words)))
        for j in range(1, length + 1):
            x = np.stack([alpha[i] + self.scores[edges[i, j]] for i in range(max(0, j - self.longest), j)])
            top = x.max(0)
            alpha[j] = top + np.log(np.exp(x - top).sum(0))
        return alpha

    def expected(self, words: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected counts of the pieces over all segmentations, words counted by weight."""
        edges = self.edges(words)
        alpha, length = self.forward(words, edges), words.shape[1]
        beta = np.zeros_like(alpha)
        out = np.zeros(self.n + 1)
        for i in range(length - 1, -1, -1):
            ends = range(i + 1, min(length, i + self.longest) + 1)
            x = np.stack([self.scores[edges[i, j]] + beta[j] for j in ends])
            for k, j in enumerate(ends):
                share = np.exp(alpha[i] + x[k] - alpha[length])
                np.add.at(out, edges[i, j], share * weight)
            top = x.max(0)
            beta[i] = top + np.log(np.exp(x - top).sum(0))
        return out[:-1]

    def long_edges(self, word: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, piece number) of all pieces within one long word, by end."""
        n, x = len(word), np.frombuffer(word, np.uint8).astype(np.uint64) + np.uint64(1)
        key = np.zeros(n, np.uint64)
        found = []
        for size in range(1, min(n, self.longest) + 1):
            # keys of all pieces of this size: those of one byte less, and the byte after them
            key = key[: n - size + 1] * PRIME + x[size - 1 :]
            ids = np.append(self.find(key[:-1], False), self.find(key[-1:], True))
            at = np.flatnonzero(ids < self.n)
            found.append(np.stack([at, at + size, ids[at]]))
        start, end, piece = np.concatenate(found, 1)
        order = np.argsort(end, kind="stable")
        return start[order], end[order], piece[order]

    def long_sums(self, at: np.ndarray, to: np.ndarray, score: np.ndarray, n: int) -> np.ndarray:
        """Log sums over the ways from 0 to each place of one long word, by its edges sorted by `to`, in linear time."""
        cuts, at, score = np.searchsorted(to, np.arange(1, n + 2)).tolist(), at.tolist(), score.tolist()
        alpha = [-math.inf] * (n + 1)
        alpha[0] = 0.0
        for j in range(1, n + 1):
            x = [alpha[at[k]] + score[k] for k in range(cuts[j - 1], cuts[j])]
            if x and (top := max(x)) > -math.inf:
                alpha[j] = top + math.log(sum(math.exp(v - top) for v in x))
        return np.array(alpha)

    def long_word(self, word: bytes) -> float:
        """The forward sum of one long word."""
        at, to, piece = self.long_edges(word)
        return float(self.long_sums(at, to, self.scores[piece], len(word))[-1])

    def long_expected(self, word: bytes, weight: float) -> np.ndarray:
        """`expected` for one long word."""
        at, to, piece = self.long_edges(word)
        score, n = self.scores[piece], len(word)
        alpha = self.long_sums(at, to, score, n)
        back = np.argsort(-at, kind="stable")  # the backward sums are forward sums of the reversed edges
        beta = self.long_sums(n - to[back], n - at[back], score[back], n)[::-1]
        return np.bincount(piece, np.exp(alpha[at] + score + beta[to] - alpha[n]) * weight, self.n)

    def log_probability(self, words: list[bytes]) -> np.ndarray:
        out = np.empty(len(words))
        for ids, x in by_length(words):
            out[ids] = self.forward(x)[-1] if x is not None else [self.long_word(words[i]) for i in ids]
        return out


def by_length(words: list[bytes], most: int = 20_000) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """(row numbers, byte matrix) of words of equal length; no matrix for those over MANY bytes."""
    size = np.array([len(w) for w in words])
    order = np.argsort(size, kind="stable")
    cuts = np.flatnonzero(np.diff(size[order])) + 1
    for ids in np.split(order, cuts):
        if not len(ids):
            continue
        n = size[ids[0]]
        for a in range(0, len(ids), most):
            part = ids[a : a + most]
            yield part, np.frombuffer(b"".join(words[i] for i in part), np.uint8).reshape(-1, n) if n <= MANY else None


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n (in all texts), c (in training texts), for every distinct word; docs has text and train."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, read = (Counter(), Counter()), 0

        def flush() -> pa.RecordBatch:
            words = list(both[0].keys() | both[1].keys())
            held, c = (np.fromiter(map(x.get, words, repeat(0)), np.int64, len(words)) for x in both)
            both[0].clear(), both[1].clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(held + c), pa.array(c)], names=["word", "n", "c"])

        for b in batches:
            raw, off = text_bytes(b.column(0))
            data, train = raw.tobytes().lower(), b.column(1).to_numpy(zero_copy_only=False)
            for s, e, t in zip(off[:-1], off[1:], train):
                both[bool(t)].update(data[s:e].split())
            read += len(data)
            if len(both[0]) + len(both[1]) > MAX_COUNTER or read > MAX_COUNTED_BYTES:
                read = 0
                yield flush()
        if both[0] or both[1]:
            yield flush()

    part = docs.select("text", "train").mapInArrow(run, "word binary, n long, c long")
    return part.groupBy("word").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


def piece_scores(words: DataFrame, pieces: list[tuple[bytes, bool]], ends: int) -> np.ndarray:
    """Natural-log probabilities of the pieces and, last, of the end: one expectation step from the ranks' scores."""
    first = np.log(1 / (np.arange(len(pieces)) + 2.7))
    shared = words.sparkSession.sparkContext.broadcast((pieces, first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, total = Lattice(*shared.value), np.zeros(len(first))
        for b in batches:
            ws, c = b.column(0).to_pylist(), b.column(1).to_numpy()
            for ids, x in by_length(ws):
                if x is not None:
                    total += lattice.expected(x, c[ids].astype(float))
                else:
                    for i in ids:
                        total += lattice.long_expected(ws[i], float(c[i]))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["piece", "x"])

    got = words.where("c > 0").select("word", "c").mapInArrow(run, "piece long, x double").groupBy("piece").agg(F.sum("x").alias("x"))
    x = np.full(len(pieces) + 1, ADDED)
    for r in got.collect():  # one row for each piece of the vocabulary at most
        x[r.piece] += r.x
    x[-1] += ends
    return np.log(x / x.sum())


def lattice_scores(docs: DataFrame, path: str | None = None, folds: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null texts count as empty: their only token is the end. Repeated rows get a row each and count each in training; an
    empty table gives an empty result; without training rows all counts are 0 and scores rest on the added counts;
    words of any length are scored whole; further columns of `docs` are ignored.
    """
    spark = docs.sparkSession
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    small_batches(spark)
    # a null id is in no fold of its own: it counts as training text
    out_of = F.coalesce(common.doc_bucket(F.col("doc_id"), folds) == held, F.lit(False))
    d = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text", out_of.alias("held_out"))
    counts = common.written(word_counts(d.select("text", (~F.col("held_out")).alias("train"))))
    ends = d.where("not held_out").count()
    sums = counts.agg(F.sum("c").alias("c"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    total, distinct = (sums.c or 0) + ends, (sums.v or 0) + (ends > 0)
    pieces = byte_pieces(path)
    scores = piece_scores(counts, pieces, ends)
    shared = spark.sparkContext.broadcast((pieces, scores[:-1]))

    def score_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(*shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(lattice.log_probability(b.column(0).to_pylist()) / math.log(10))], names=["word", "n", "c", "lattice"])

    scored = common.written(counts.mapInArrow(score_words, "word binary, n long, c long, lattice double"))
    # the lowest power of two above which at most MAX_FREQUENT words lie
    sizes = sorted(((r.b, r["count"]) for r in scored.groupBy(F.length(F.bin("n")).alias("b")).count().collect()), reverse=True)
    floor, kept = 64, 0
    for bits, k in sizes:
        if kept + k > MAX_FREQUENT:
            break
        floor, kept = bits, kept + k
    frequent = (F.length(F.bin("n")) >= floor) & (F.length("word") <= MANY)
    often = scored.where(frequent).select("word", "c", "lattice").toArrow().to_pydict()
    unit = math.log10(total + distinct + 1)
    table = ({bytes(w): i for i, w in enumerate(often["word"])}, np.array([0, *often["c"]], np.int64), np.array([0, *often["lattice"]], float))
    table = spark.sparkContext.broadcast(table)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, c, lattice = table.value
        base = np.log10(c + 1.0) - unit
        base[0] = 0.0
        for b in batches:
            raw, off = text_bytes(b.column(2))
            data = raw.tobytes().lower()
            n, known, bases, lattices, rare_row, rare_word, rare_n = [], [], [], [], [], [], []
            for i, (s, e) in enumerate(zip(off[:-1], off[1:])):
                ws = data[s:e].split()
                at = np.fromiter(map(index.get, ws, repeat(-1)), np.int64, len(ws)) + 1
                n.append(len(ws)), known.append(int((c[at] > 0).sum())), bases.append(base[at].sum()), lattices.append(lattice[at].sum())
                rest = Counter(ws[k] for k in np.flatnonzero(at == 0))
                rare_row += repeat(i, len(rest))
                rare_word += rest.keys()
                rare_n += rest.values()
            some, many = len(n), len(rare_row)
            at = pa.array([*range(some), *rare_row], pa.int64())
            pad = lambda x, kind: pa.array([*x, *repeat(None, many)], kind)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), b.column(1).take(at), b.column(3).take(at), pa.array([*repeat(None, some), *rare_word], pa.binary()),
                 pa.array([*repeat(1, some), *rare_n], pa.int64()), pad(n, pa.int64()), pad(known, pa.int64()), pad(bases, pa.float64()), pad(lattices, pa.float64())],
                names=["rid", "doc_id", "held_out", "word", "times", "n_words", "known", "base", "lattice"])

    kind = d.schema["doc_id"].dataType.simpleString()
    seen = common.written(d.select("rid", "doc_id", "text", "held_out").mapInArrow(
        read, f"rid long, doc_id {kind}, held_out boolean, word binary, times long, n_words long, known long, base double, lattice double"))
    rare = seen.where("word is not null").select("rid", "doc_id", "held_out", "word", "times").join(
        scored.where(~frequent).select("word", "c", F.col("lattice").alias("w_lattice")), "word")
    times = F.col("times")
    rare = rare.select(
        "rid", "doc_id", "held_out", F.lit(0).cast("long").alias("n_words"), F.when(F.col("c") > 0, times).otherwise(0).alias("known"),
        (times * (F.log10(F.col("c") + 1.0) - unit)).alias("base"), (times * F.col("w_lattice")).alias("lattice"))
    every = seen.where("word is null").select(*rare.columns).unionAll(rare)
    end_base, end_lattice = math.log10(ends + 1) - unit, float(scores[-1] / math.log(10))
    return every.groupBy("rid", "doc_id", "held_out").agg(
        (F.sum("n_words") + 1).alias("n_tokens"), (F.sum("known") + int(ends > 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.sum("base") + end_base).alias("base_score"),
        (F.sum("lattice") + end_lattice).alias("score")).drop("rid")


def op4_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_scores(common.documents(spark, sf_dir))
