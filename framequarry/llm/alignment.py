"""Alignment of two tokenizers' tokens, and how often ids are linked across the corpus.

A is a byte-level BPE of the tokenizers library, B a sentencepiece model with byte fallback; both read a space and the
text. The libraries' own spans are the coarse cuts: A's character offsets, B's byte spans in the protocol buffer. Where a
token shares its last character with the next one, or stands for a single byte, its end comes from its decoded bytes.
Offsets where tokens of both end cut the text into groups; the two tokens that end there are a link.

A text is cut before spaces and line ends that follow on something else: no token of either tokenizer holds such a place
inside (looked up in B's vocabulary; A's rule sees to it), so the parts of a text are tokenized by themselves, a worker
remembers what it found for a part, and both tokenizers end where a part ends. Links go to a table; counts of id pairs are
summed from it and joined back.
"""

from __future__ import annotations

import gc
import itertools
import json
import os
import re
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .arrowtext import small_batches, text_bytes
from .bpe import byte_letters, default_path
from .bpe import runs as text_runs
from .memory import Memory

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of parts and what was found for them that a worker remembers; what an entry takes besides its contents.
PART_BYTES, PART_COST = 160_000_000, 300
#: Bytes of text that are cut at a time (one text at least), and new parts that are tokenized at a time.
SPLIT_BYTES, PARTS = 1 << 20, 20_000
#: Parts that go to the tokenizers as one string, and what stands before them.
TOGETHER, HEAD = 500, " a"
#: Id pairs whose counts are broadcast.
MAX_BROADCAST_PAIRS = 2_000_000
#: White space and what follows, up to the next space or line end behind something else. All of Python's white space is
#: kept together: A's library sees less of it.
PART = re.compile(r"\s+\S*(?:[^\S \n]\s*\S*)*")
SPACE = "▁"
#: What follows a token in the text of groups: within a group, behind its tokens of A, behind it, at the end of a part.
SIGNS = pa.array([b",", b"|", b";", b""])

_loaded: dict = {}


def refined(ends: np.ndarray, shared: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Offsets behind tokens: `ends`, or where `shared` the end of the token before plus the decoded bytes of this one."""
    if not shared.any():
        return ends
    total = np.cumsum(size)
    last = np.maximum.accumulate(np.where(shared, -1, np.arange(len(ends))))
    return np.where(last < 0, total, ends[last] - total[last] + total)


class Aligner:
    """Two tokenizers, the bytes of their tokens, and what was found for parts of texts."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a.no_truncation(), self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        with open(a_path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        if self.a.normalizer is not None or not vocab.keys() >= set(byte_letters()):
            raise ValueError("A must be a byte-level BPE over all bytes, so that its tokens have a text's own bytes")
        self.a_size = np.zeros(1 + max(vocab.values()), np.int64)
        self.a_size[list(vocab.values())] = [len(token) for token in vocab]  # a letter is a byte
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.single = np.array([self.b.is_byte(i) for i in range(len(pieces))])
        self.b_bytes = [bytes([int(p[3:5], 16)]) if one else p.replace(SPACE, " ").encode() for p, one in zip(pieces, self.single.tolist())]
        self.b_size = np.array([len(x) for x in self.b_bytes])
        self.decimal = pa.array([b"%d" % i for i in range(max(len(self.a_size), len(pieces)))])
        space = self.b.piece_to_id(SPACE)
        crossing = any(re.search(f"[^{SPACE}]{SPACE}|\n", p) for p in pieces)
        probe = "x  ﬁ\n Å "  # what a normal form or the removal of white space would change
        self.parts = not crossing and pieces[space] == SPACE and self.b.normalize(probe) == SPACE + probe.replace(" ", SPACE)
        self.known = Memory(PART_BYTES)

    def cut(self, text: str) -> list[str]:
        return PART.findall(" " + text) if self.parts else [" " + text]

    def a_tokens(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, byte offsets behind them in all strings together) by the library's character offsets."""
        told = self.a.encode_batch(strings, add_special_tokens=False)
        count = [len(x) for x in told]
        ids = np.fromiter(itertools.chain.from_iterable(x.ids for x in told), np.int64)
        spans = np.fromiter(itertools.chain.from_iterable(s for x in told for s in x.offsets), np.int64).reshape(-1, 2)
        spans += np.repeat(np.cumsum([0] + [len(x) for x in strings])[:-1], count)[:, None]
        letters = np.frombuffer("".join(strings).encode("utf-32-le"), "<u4")
        at = np.concatenate([[0], np.cumsum(1 + (letters > 0x7F) + (letters > 0x7FF) + (letters > 0xFFFF))])
        shared = np.append(spans[1:, 0] < spans[:-1, 1], False)
        return ids, refined(at[spans[:, 1]], shared, self.a_size[ids])

    def b_tokens(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of B, by its byte spans. The space that B adds is that at the start of a string."""
        told = [t.pieces for t in self.b.encode([x[1:] for x in strings], return_type="proto", num_threads=1)]
        both = np.array([(p.id, p.end) for t in told for p in t], np.int64)
        ids, ends = both[:, 0], both[:, 1] + 1
        ends += np.repeat(np.cumsum([0] + [len(x.encode()) for x in strings])[:-1], [len(t) for t in told])
        return ids, refined(ends, self.single[ids], self.b_size[ids])

    def aligned(self, parts: list[str]) -> Iterator[tuple]:
        """(tokens of A, of B, groups, links, whether the bytes are the part's) of each part."""
        for k in range(0, len(parts), PARTS):
            some = parts[k : k + PARTS]
            found = dict.fromkeys(some, (0, 0, b"", b"", False))
            plain = [p for p in some if SPACE not in p]  # B reads this letter as a space
            # parts may follow on each other unless they end with white space
            joined = [p for p in plain if not p[-1].isspace()] if self.parts else []
            alone = [p for p in plain if p[-1].isspace()] if self.parts else plain
            found.update(self.batch([joined[i : i + TOGETHER] for i in range(0, len(joined), TOGETHER)] + [[p] for p in alone]))
            yield from map(found.__getitem__, some)

    def batch(self, several: list[list[str]]) -> Iterator[tuple[str, tuple]]:
        """Each part with what `aligned` says of it; `several` are lists of parts that are tokenized as one string."""
        if not several:
            return
        # in front goes a part that every string can begin with; it goes again with its tokens
        strings = [HEAD + "".join(x) for x in several] if self.parts else [x[0] for x in several]
        parts = [p for x in several for p in ([HEAD, *x] if self.parts else x)]
        raw = b"".join([x.encode() for x in strings])
        b, b_ends = self.b_tokens(strings)
        if b"".join(map(self.b_bytes.__getitem__, b.tolist())) != raw:
            if len(several) > 1 or len(several[0]) > 1:
                for p in itertools.chain.from_iterable(several):
                    yield from self.batch([[p]])
            else:
                yield several[0][0], (0, 0, b"", b"", False)
            return
        a, a_ends = self.a_tokens(strings)
        part_ends = np.cumsum([len(p.encode()) for p in parts])
        in_a, in_b = (np.searchsorted(x, part_ends, "right") for x in (a_ends, b_ends))
        # tokens that end together close a group; where each token stands if a group's tokens of A come before those of B
        last_a = np.minimum(np.searchsorted(a_ends, b_ends), len(a) - 1)
        last_b = np.flatnonzero(a_ends[last_a] == b_ends)
        last_a = last_a[last_b]
        place_a = np.arange(len(a)) + np.append(0, last_b + 1)[np.searchsorted(last_a, np.arange(len(a)))]
        place_b = np.arange(len(b)) + last_a[np.searchsorted(last_b, np.arange(len(b)))] + 1
        ids, sign = np.empty(len(a) + len(b), np.int64), np.zeros(len(a) + len(b), np.int8)
        ids[place_a], ids[place_b] = a, b
        sign[place_a[last_a]], sign[place_b[last_b]] = 1, 2
        ends = in_a + in_b
        sign[ends - 1] = 3  # the last token of a part
        strings = pc.binary_join_element_wise(self.decimal.take(pa.array(ids)), SIGNS.take(pa.array(sign)), b"")
        groups = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), strings), b"").to_pylist()
        links = (a[last_a] << 32 | b[last_b]).astype("<i8").tobytes()
        at = 8 * np.searchsorted(last_b, np.append(0, in_b))
        for p, x, y, g, i, j in zip(parts, np.diff(in_a, prepend=0).tolist(), np.diff(in_b, prepend=0).tolist(), groups, at[:-1].tolist(), at[1:].tolist()):
            yield p, (x, y, g, links[i:j], True)

    def texts(self, texts: list[str]) -> Iterator[tuple[int, int, bytes, bytes]]:
        """(tokens of A, of B, groups, links) of each text."""
        collects = gc.isenabled()
        gc.disable()  # many small objects, none in a cycle
        try:
            cut = [self.cut(t) if t else [] for t in texts]
            known = self.known.known(set().union(*cut), self.aligned, lambda v: PART_COST // 2 + len(v[2]) + len(v[3]))
            for parts in cut:
                found = [known[p] for p in parts]
                if not all(map(itemgetter(4), found)):
                    found = []
                yield sum(map(itemgetter(0), found)), sum(map(itemgetter(1), found)), b";".join(map(itemgetter(2), found)), b"".join(map(itemgetter(3), found))
        finally:
            gc.enable() if collects else None


def loaded(a_path: str, b_path: str) -> Aligner:
    """The tokenizers of this worker process."""
    if (a_path, b_path) not in _loaded:
        _loaded[a_path, b_path] = Aligner(a_path, b_path)
    return _loaded[a_path, b_path]


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, groups and links of every row's text.

    Groups are `a1,a2|b1;a3|b2,b3`: A's and B's ids in order. Links hold the ids of the two tokens that end a group, as A's
    id times 2^32 plus B's. Null and empty texts, and those whose bytes either tokenizer changes, have no tokens: zeros and
    empty columns. Repeated rows give a row each; texts of any length are read whole; an empty table gives an empty
    result; further columns of `docs` are ignored.
    """
    a_path, b_path = a_path or default_path(A_FILE), b_path or default_path(B_FILE)
    small_batches(docs.sparkSession)
    d = docs.select("doc_id", "text")
    kind = d.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = loaded(a_path, b_path)
        for b in batches:
            _, off = text_bytes(b.column(1))
            for i, j in text_runs(off, SPLIT_BYTES):
                found = list(aligner.texts(b.column(1).slice(i, j - i).to_pylist()))
                ends = np.cumsum([0] + [len(x[3]) // 8 for x in found])
                links = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join([x[3] for x in found]), "<i8")))
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(i, j - i), *[pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)],
                    pa.array([x[2] for x in found], pa.binary()).cast(pa.string()), links], names=["doc_id", "n_a", "n_b", "groups", "links"])

    return d.mapInArrow(run, f"doc_id {kind}, n_a long, n_b long, groups string, links array<bigint>")


def pair_counts(links: DataFrame) -> DataFrame:
    """link, n, best: how many links of the table's `links` hold a pair of ids, and whether that is the most for its B id.

    Counts are combined before the shuffle. The highest counts are a row for each id of B's vocabulary, so they are broadcast.
    """
    counts = common.written(links.select(F.explode("links").alias("link")).groupBy("link").agg(F.count("*").alias("n")))
    b = F.col("link").bitwiseAND(F.lit(2**32 - 1))
    top = counts.groupBy(b.alias("b")).agg(F.max("n").alias("top"))
    return counts.join(F.broadcast(top), b == F.col("b")).select("link", "n", (F.col("n") == F.col("top")).alias("best"))


def link_sums(links: DataFrame, counts: DataFrame, most: int = MAX_BROADCAST_PAIRS) -> DataFrame:
    """row_no, n_best, count_sum of rows (row_no, links) with links.

    Up to `most` pairs are broadcast. Beyond that those are whose count is at least a `most`-th of all links (there can't be
    more than `most`); the others are joined by a shuffle, where no pair has more rows than that.
    """
    counts = common.written(counts)
    pairs, total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    sums = [F.sum(F.col("times") * F.col("best").cast("long")).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")]
    each = links.select("row_no", F.explode("links").alias("link"), F.lit(1).alias("times"))
    if pairs <= most:
        return each.join(F.broadcast(counts), "link").groupBy("row_no").agg(*sums)
    frequent = F.col("n") * most >= total
    some = each.join(F.broadcast(counts.where(frequent)), "link")
    rest = each.join(F.broadcast(counts.where(frequent).select("link")), "link", "left_anti")
    rest = rest.groupBy("row_no", "link").agg(F.sum("times").alias("times")).join(counts.where(~frequent), "link")
    both = some.groupBy("row_no").agg(*sums).unionAll(rest.groupBy("row_no").agg(*sums))
    return both.groupBy("row_no").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def alignment_digest(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, most: int = MAX_BROADCAST_PAIRS) -> DataFrame:
    """The columns of the contract for every row: counts of tokens, groups and links, the links' corpus-wide counts, a digest of the groups."""
    sha = F.when(F.col("groups") == "", F.lit("")).otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    found = align(docs, a_path, b_path).select(
        F.monotonically_increasing_id().alias("row_no"), "doc_id", "n_a", "n_b", F.size("links").cast("long").alias("n_groups"),
        F.size("links").cast("long").alias("n_links"), sha.alias("groups_sha256"), "links")
    found = common.written(found)
    links = found.select("row_no", "links")
    sums = link_sums(links, pair_counts(links), most)
    n = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")]
    return found.drop("links").join(sums, "row_no", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", *n, "groups_sha256")


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_digest(common.documents(spark, sf_dir))
