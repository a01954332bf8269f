"""Exact Jaccard join of documents' word shingles, by an inverted index that skips by relations between sets.

Equal sets are one class. Every class puts the head of its set, in an order from rare to frequent shingles, into index
lists; two sets over the threshold share a shingle of their heads. The order counts how many classes offer a shingle (up
to a large number); shingles of one class only need no list. Lists are sorted by set size and read in blocks; sizes and
positions tell which entries, and which whole blocks, can't reach the threshold. The first round compares entries with
their lists' leaders only; three more ask for one partner of each set outside its component. A set that links is so
similar that it takes over its partner's answers (its component); the last round asks only for what these answers leave
open: all pairs of different components. Lists whose entries are all of one component take part no more. Long lists are
split: in parts that are asked each by itself at first, and in the last round by size band and part, where the parts of
one large component don't meet. Candidates lose those whose bitmaps differ in too many bits (a lower bound of the sets'
difference); the rest is verified on the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .arrowtext import small_batches, text_bytes
from .quality_net import runs
from .shingles import mixed, shingle_sets

SHINGLE, PERCENT = 4, 85
#: Share of all shingles that come first in the order; sets under SMALL_SET shingles offer all of theirs to the index.
LEVEL_SHARE, SMALL_SET = 0.3, 64
#: Frequencies are counted up to this number; beyond it shingles are equally frequent, and their order is that of hashes.
MOST_COUNTED = 65_536
#: Entries of a list that one task takes; longer lists are split, those of a component over so many apart from the rest.
LIST_PART = 4096
#: Parity bitmaps have so many words of 64 bits; they stay sharp while two sets differ in fewer shingles than half their bits.
BITMAP_WORDS = 32
#: Entries of a list that are compared, or skipped, together.
BLOCK = 256
#: Texts to verify are found by a broadcast of their keys up to so many, else by a shuffled join.
MAX_BROADCAST_KEYS = 500_000


def sets_of(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    raw, off = text_bytes(column)
    for i, j in runs(off):
        yield from shingle_sets(raw[off[i] : off[j]], off[i : j + 1] - off[i], k)


def level(h: np.ndarray) -> np.ndarray:
    """0 for a fixed share of all shingles, 1 for the rest: the first part of the order."""
    return (mixed(h) >= np.uint64(int(2**64 * LEVEL_SHARE))).astype(np.int64)


def head_length(n, percent: int):
    return n - -(-percent * n // 100) + 1


def profiled(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, kd (row key), n, m0, m1 (shingles offered to the index by level), d1, d2 (digest of the set; null if empty), bits."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m0, m1, d1, d2, bits = [], [], [], [], [], []
            for s in sets_of(b.column(2), k):
                n.append(len(s))
                if not len(s):
                    m0.append(0), m1.append(0), d1.append(None), d2.append(None), bits.append(None)
                    continue
                x, y = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                d1.append(int(x)), d2.append(int(y))
                first = int((level(s) == 0).sum())
                m0.append(first), m1.append(len(s) - first if offers_all(len(s), first, percent) else 0)
                # parities: what two sets share cancels, so two bitmaps differ in no more bits than the sets do in shingles
                odd = np.bincount((s & np.uint64(BITMAP_WORDS * 64 - 1)).astype(np.int64), minlength=BITMAP_WORDS * 64) & 1
                bits.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), *[pa.array(x, pa.int64()) for x in (n, m0, m1, d1, d2)], pa.array(bits, pa.list_(pa.int64()))],
                names=["doc_id", "kd", "n", "m0", "m1", "d1", "d2", "bits"])

    return docs.select("doc_id", "kd", "text").mapInArrow(
        run, f"doc_id {kind}, kd long, n long, m0 long, m1 long, d1 long, d2 long, bits array<bigint>")


def offers_all(n: int, first: int, percent: int) -> bool:
    """Whether a set offers shingles of both levels: small ones, and those whose first level can't fill the head."""
    return n < SMALL_SET or first < head_length(n, percent)


def offered(docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """token, cid: the shingles that each class offers to the index."""
    d = docs.select("kd", "text").join(common.small(classes.select("kd", "cid"), MAX_BROADCAST_KEYS), "kd").select("cid", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cid = b.column(0).to_numpy()
            tokens = []
            for s in sets_of(b.column(1), k):
                first = level(s) == 0
                tokens.append(s if not len(s) or offers_all(len(s), int(first.sum()), percent) else s[first])
            t = np.concatenate([np.empty(0, np.uint64), *tokens]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(np.repeat(cid, [len(x) for x in tokens]))], names=["token", "cid"])

    return d.mapInArrow(run, "token long, cid long")


def shared_tokens(tokens: DataFrame) -> DataFrame:
    """token, cid, df: rows of tokens that two classes or more offer, with their number (up to MOST_COUNTED)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, cid, over = np.empty(0, np.int64), np.empty(0, np.int64), None
        out = lambda t, c, n: pa.RecordBatch.from_arrays([pa.array(t), pa.array(c), pa.array(np.minimum(n, MOST_COUNTED))], names=["token", "cid", "df"])
        for b in batches:
            token = np.concatenate([token, b.column(0).to_numpy()])
            cid = np.concatenate([cid, b.column(1).to_numpy()])
            if not len(token):
                continue
            cut = np.concatenate([[0], np.flatnonzero(token[1:] != token[:-1]) + 1])
            size = np.diff(np.append(cut, len(token)))
            if over == token[0]:
                size[0] = MOST_COUNTED
            n = np.repeat(size, np.diff(np.append(cut, len(token))))
            # the last token may go on, unless it is past counting already
            end = len(token) if size[-1] >= MOST_COUNTED else cut[-1]
            over = token[-1] if end == len(token) else None
            keep = n[:end] > 1
            if keep.any():
                yield out(token[:end][keep], cid[:end][keep], n[:end][keep])
            token, cid = token[end:], cid[end:]
        if len(token) > 1:
            yield out(token, cid, np.full(len(token), len(token)))

    return tokens.repartition("token").sortWithinPartitions("token").mapInArrow(run, "token long, cid long, df long")


def heads(shared: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """token, n, cid, pos: the shared shingles in the heads of the sets, rare ones first.

    A set's shingles that no other set offers stand before the shared ones of their level; their number is enough.
    """
    rows = shared.join(classes.select("cid", "n", "m0", "m1"), "cid").select("cid", "n", "m0", "m1", "token", "df")
    rows = rows.repartition("cid").sortWithinPartitions("cid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in chain(batches, [None]):
            x = None if b is None else [c.to_numpy() for c in b.columns]
            if held is not None:
                x = held if x is None else [np.concatenate([h, c]) for h, c in zip(held, x)]
            if x is None or not len(x[0]):
                continue
            # the last class may go on
            end = len(x[0]) if b is None else int(np.flatnonzero(np.append(x[0][-1] + 1, x[0]) != x[0][-1])[-1])
            held = [c[end:] for c in x]
            cid, n, m0, m1, token, df = (c[:end] for c in x)
            if not len(cid):
                continue
            lev = level(token.view(np.uint64))
            order = np.lexsort((token, df, lev, cid))
            cid, n, m0, m1, token, df, lev = (c[order] for c in (cid, n, m0, m1, token, df, lev))
            start = np.concatenate([[0], np.flatnonzero(cid[1:] != cid[:-1]) + 1])
            size = np.diff(np.append(start, len(cid)))
            in0 = np.add.reduceat((lev == 0).astype(np.int64), start)
            at = np.arange(len(cid)) - np.repeat(start, size)
            shared0 = np.repeat(in0, size)
            # before a shared one of level 0: the unshared of level 0; of level 1: all of level 0 and the unshared of level 1
            pos = np.where(lev == 0, m0 - shared0 + at, m0 + (m1 - np.repeat(size - in0, size)) + at - shared0)
            keep = pos < head_length(n, percent)
            yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in (token, n, cid, pos)], names=["token", "n", "cid", "pos"])

    return rows.mapInArrow(run, "token long, n long, cid long, pos long")


def can_link(n1, p1, n2, p2, percent: int):
    """Whether sets of n1 <= n2 shingles whose first common shingle lies at p1 and p2 can reach the threshold."""
    need = -(-percent * (n1 + n2) // (100 + percent))
    return (100 * n1 >= percent * n2) & (1 + np.minimum(n1 - p1, n2 - p2) - 1 >= need)


def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of each list with two entries or more, from batches sorted by the first column; lists may span batches."""
    held = None
    for b in batches:
        x = [np.array(c.flatten()).reshape(len(c), -1) if pa.types.is_list(c.type) else c.to_numpy(zero_copy_only=False) for c in b.columns]
        if held is not None and len(x[0]):
            x = [np.concatenate([h, c]) for h, c in zip(held, x)]
        key = x[0]
        if not len(key):
            continue
        cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
        held = [c[cuts[-1] :] for c in x]
        size = np.diff(cuts)
        for i in np.flatnonzero(size > 1):
            yield [c[cuts[i] : cuts[i + 1]] for c in x]
    if held is not None and len(held[0]) > 1:
        yield held


def unique_pairs(found: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)


def leader_pairs(entries: DataFrame, percent: int) -> DataFrame:
    """(a, b): list leaders with entries of other components that can link; (token, n, cid, pos, component), sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows = [], 0
        for _, n, cid, pos, comp, *_ in lists(batches):
            at = 0
            while at < len(n) - 1:
                # up to the first entry that is too large for this leader
                to = int(np.searchsorted(n * percent, 100 * n[at], "right"))
                i = np.arange(at + 1, to)
                i = i[(comp[i] != comp[at]) & can_link(n[at], pos[at], n[i], pos[i], percent)]
                found.append(np.stack([np.minimum(cid[at], cid[i]), np.maximum(cid[at], cid[i])], 1))
                rows += len(i)
                at = max(to, at + 1)
            if rows > 200_000:
                p = unique_pairs(found)
                found, rows = [], 0
                yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], names=["a", "b"])
        p = unique_pairs(found)
        yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1])], names=["a", "b"])

    return entries.mapInArrow(run, "a long, b long")


def one_partner(pairs: np.ndarray) -> np.ndarray:
    """Of pairs (a, b) one of each b, picked by a hash, so that no a stands in the way of all others."""
    order = np.lexsort((mixed(mixed(pairs[:, 0].view(np.uint64)) + pairs[:, 1].view(np.uint64)), pairs[:, 1]))
    return pairs[order][np.unique(pairs[order, 1], return_index=True)[1]]


def in_parts(entries: DataFrame, long_lists: DataFrame) -> DataFrame:
    """`entries` with long lists cut into parts, each a list of its own: what finds some partners of each set."""
    part = F.pmod(F.xxhash64("cid", "token"), F.ceil(F.col("entries") / LIST_PART))
    j = entries.join(long_lists, "token", "left")
    token = F.when(F.col("entries").isNull(), F.col("token")).otherwise(F.xxhash64("token", part))
    return j.select(token.alias("token"), *entries.columns[1:], F.lit(0).alias("side"), F.lit(False).alias("lower"))


def all_parts(entries: DataFrame, long_lists: DataFrame, percent: int) -> DataFrame:
    """`entries` with long lists cut so that every two that can link meet: in lists of one size band and of the next lower
    part of it (`lower`: entries of the lower band, one of which each pair needs), and there by parts (`side`)."""
    short = entries.join(long_lists, "token", "left_anti").select(*entries.columns, F.lit(0).alias("side"), F.lit(True).alias("lower"))
    # sets that link lie in one band or in neighbouring ones
    band = F.floor(F.ln("n") / F.ln(F.lit(100.0 / (percent - 1)))).cast("int")
    roles = F.array(F.struct(band.alias("band"), F.lit(True).alias("lower")), F.struct((band - 1).alias("band"), F.lit(False).alias("lower")))
    d = entries.join(long_lists, "token").withColumn("role", F.explode(roles))
    d = d.select(F.xxhash64("token", "role.band").alias("key"), *entries.columns[1:], F.col("role.lower").alias("lower"))
    large = d.groupBy("key", "component").agg(F.count("*").alias("m")).where(F.col("m") > LIST_PART).select("key", "component", (F.col("component") + 1).alias("ball"))
    d = d.join(common.small(common.written(large), MAX_BROADCAST_KEYS), ["key", "component"], "left").withColumn("ball", F.coalesce("ball", F.lit(0)))
    d = common.dealt(d, LIST_PART)
    return short.unionByName(d.select(F.xxhash64("key", "p", "q").alias("token"), *entries.columns[1:], F.col("part").alias("side"), "lower"))


def unsettled(entries: DataFrame) -> DataFrame:
    """Entries of lists with several components."""
    several = entries.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("token")
    return entries.join(several, "token")


def open_pairs(entries: DataFrame, percent: int, one_each: bool = False) -> DataFrame:
    """(a, b): entries of one list, of different components, that can link; (token, n, cid, pos, component, side, lower, bits), sorted.

    Two blocks are skipped if their sizes or the best of their positions rule all pairs out. Entries bring their
    bitmaps, so that a list of sets that resemble each other too little gives no pairs. With `one_each` only
    one a of each b stays.
    """
    chosen = lambda found: one_partner(unique_pairs(found)) if one_each else unique_pairs(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, rows = [], 0
        for _, n, cid, pos, comp, side, lower, bits in lists(batches):
            if (comp == comp[0]).all():
                continue
            two = (side != side[0]).any()
            edges = range(0, len(n), BLOCK)
            room = n - pos
            best = [room[i : i + BLOCK].max() for i in edges]
            for x, i in enumerate(edges):
                top = n[min(i + BLOCK, len(n)) - 1]
                for y, j in enumerate(edges):
                    if j < i:
                        continue
                    if 100 * top < percent * n[j]:
                        break
                    need = -(-percent * (n[i] + n[j]) // (100 + percent))
                    if min(best[x], best[y]) < need:
                        continue
                    p, q = np.meshgrid(np.arange(i, min(i + BLOCK, len(n))), np.arange(j, min(j + BLOCK, len(n))), indexing="ij")
                    p, q = p.ravel(), q.ravel()
                    ok = (p < q) & (comp[p] != comp[q]) & can_link(n[p], pos[p], n[q], pos[q], percent)
                    if not one_each:
                        ok &= lower[p] | lower[q]
                    if two:
                        ok &= side[p] != side[q]
                    p, q = p[ok], q[ok]
                    both = n[p] + n[q]
                    ok = np.bitwise_count((bits[p] ^ bits[q]).view(np.uint64)).sum(1) <= both - 2 * -(-percent * both // (100 + percent))
                    p, q = p[ok], q[ok]
                    found.append(np.stack([np.minimum(cid[p], cid[q]), np.maximum(cid[p], cid[q])], 1))
                    rows += len(p)
                    if rows > 200_000:
                        u = chosen(found)
                        found, rows = [], 0
                        yield pa.RecordBatch.from_arrays([pa.array(u[:, 0]), pa.array(u[:, 1])], names=["a", "b"])
        u = chosen(found)
        yield pa.RecordBatch.from_arrays([pa.array(u[:, 0]), pa.array(u[:, 1])], names=["a", "b"])

    pairs = entries.mapInArrow(run, "a long, b long")
    return pairs.groupBy("b").agg(F.min_by("a", F.xxhash64("a", "b")).alias("a")).select("a", "b") if one_each else pairs.distinct()


def first_open(entries: DataFrame, percent: int) -> DataFrame:
    """One pair for each set that can link beyond its component: few pairs join a group whose members mostly link."""
    return open_pairs(entries, percent, one_each=True)


def by_bitmap(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose bitmaps differ in no more bits than sets over the threshold may."""
    side = lambda x: classes.select(F.col("cid").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    j = pairs.join(side("a"), "a").join(side("b"), "b")
    differ = F.aggregate(F.zip_with("bits_a", "bits_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    both = F.col("n_a") + F.col("n_b")
    need = F.expr(f"({percent} * (n_a + n_b) + {99 + percent}) div {100 + percent}")
    return j.where(differ <= both - 2 * need).select("a", "b")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int, salts: int = 16) -> DataFrame:
    """The pairs (a, b) whose texts reach the threshold; a leader's texts go to `salts` groups at most."""
    salt = F.pmod(F.xxhash64("b"), F.lit(salts))
    p = pairs.withColumn("salt", salt)
    need = p.select(F.col("a").alias("leader"), "salt", F.lit(1).alias("role"), F.col("b").alias("cid")).unionAll(
        p.select(F.col("a").alias("leader"), "salt", F.lit(0).alias("role"), F.col("a").alias("cid")).distinct())
    need = need.join(classes.select("cid", "kd"), "cid")
    text = docs.select("kd", "text").join(common.small(need, MAX_BROADCAST_KEYS), "kd")
    rows = text.select("leader", "salt", "role", "cid", "text").repartition("leader", "salt").sortWithinPartitions("leader", "salt", "role", "cid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, lead, last = None, None, None
        for b in batches:
            leader, salt, role, cid = (b.column(i).to_numpy() for i in range(4))
            a_out, b_out = [], []
            for i, s in enumerate(sets_of(b.column(4), k)):
                if (leader[i], salt[i]) != key:
                    key, lead, last = (leader[i], salt[i]), s, None
                if role[i] == 0 or cid[i] == last:  # the leader, or a repeated row
                    continue
                last = cid[i]
                both = len(np.intersect1d(lead, s, assume_unique=True))
                if 100 * both >= percent * (len(lead) + len(s) - both):
                    a_out.append(leader[i]), b_out.append(cid[i])
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def jaccard_groups(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, row_key, kept of every row of `docs`.

    Null and empty texts, and those without words, have no shingles and link with nothing; texts under k words have
    one; repeated rows link; an empty table gives an empty result; texts of any length are read whole; further columns
    are ignored. A null id is never the smallest of a component that has others. `row_key` (see `row_key`) names rows of
    equal id and text; of each component those of one row key are `kept`, and all rows without shingles.
    """
    small_batches(docs.sparkSession)
    d = docs.select("doc_id", row_key().alias("kd"), "text")
    rows = common.written(profiled(d, k, percent))
    d = one_text(d, rows)
    classes = rows.where("n > 0").groupBy("d1", "d2").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "kd")).alias("low"), F.min("kd").alias("kd"), *[F.first(c).alias(c) for c in ("n", "m0", "m1", "bits")])
    classes = common.written(classes.withColumn("cid", F.monotonically_increasing_id()))
    tokens = offered(d, classes, k, percent)
    listed = common.written(heads(shared_tokens(tokens), classes, percent))
    long_lists = listed.groupBy("token").agg(F.count("*").alias("entries")).where(F.col("entries") > LIST_PART)
    long_lists = common.small(common.written(long_lists), MAX_BROADCAST_KEYS)
    label = classes.select("cid", F.col("cid").alias("component"))
    tested = None
    for ask in (first_leaders, first_open, first_open, first_open, open_pairs):
        # what components leave open; pairs that were tested before are settled
        entries = listed.join(label, "cid").select("token", "n", "cid", "pos", "component")
        entries = all_parts(unsettled(entries), long_lists, percent) if ask is open_pairs else in_parts(unsettled(entries), long_lists)
        if ask is not first_leaders:
            entries = entries.join(classes.select("cid", "bits"), "cid").select(*entries.columns, "bits")
        pairs = ask(entries.repartition("token").sortWithinPartitions("token", "n", "cid"), percent).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = common.written(by_bitmap(pairs, classes, percent) if ask is first_leaders else pairs)
        if pairs.isEmpty():
            continue
        tested = pairs if tested is None else tested.unionAll(pairs)
        label = common.written(merged(label, verified(pairs, classes, d, k, percent)))
    found = label.join(classes.select("cid", "d1", "d2", "low"), "cid")
    lowest = found.groupBy("component").agg(F.min("low").alias("first"))
    found = found.join(lowest, "component").select("d1", "d2", "first")
    out = rows.where("n > 0").select("doc_id", "n", "kd", "d1", "d2").join(found, ["d1", "d2"]).select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("first.doc_id").alias("component_id"), F.col("kd").alias("row_key"), (F.col("kd") == F.col("first.kd")).alias("kept"))
    return out.unionAll(rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"), "kd", F.lit(True).alias("kept")))


def one_text(d: DataFrame, rows: DataFrame) -> DataFrame:
    """kd, text: one row of each row key; the texts of keys that several rows have are written down."""
    many = common.written(rows.groupBy("kd").agg(F.count("*").alias("n")).where("n > 1").select("kd"))
    if many.isEmpty():
        return d.select("kd", "text")
    many = common.small(many, MAX_BROADCAST_KEYS)
    one = common.written(d.select("kd", "text").join(many, "kd").groupBy("kd").agg(F.first("text").alias("text")))
    return d.select("kd", "text").join(many, "kd", "left_anti").unionByName(one)


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """What names rows of equal id and text."""
    return F.xxhash64(doc_id, text)


def merged(label: DataFrame, links: DataFrame) -> DataFrame:
    """cid, component with the components joined that `links` (a, b) connect; links within one are left out first."""
    of = lambda x: label.select(F.col("cid").alias(x), F.col("component").alias(f"{x}_of"))
    between = links.join(of("a"), "a").join(of("b"), "b").where("a_of <> b_of").select("a_of", "b_of")
    comp = common.components(between, "a_of", "b_of").withColumnRenamed("component", "joined")
    return label.withColumnRenamed("component", "node").join(comp, "node", "left").select("cid", F.coalesce("joined", "node").alias("component"))


def first_leaders(entries: DataFrame, percent: int) -> DataFrame:
    """Of each entry's leaders the smallest: one pair for each set, after which groups of copies are one component."""
    return leader_pairs(entries, percent).groupBy("b").agg(F.min("a").alias("a")).select("a", "b")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(common.documents(spark, sf_dir))
