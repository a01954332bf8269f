"""Runs of periodic word sequences by a grammar of each text.

A run is a stretch of words that repeats with its smallest period q (words q apart are equal), of `least` words and
`times` periods at least, and that goes on neither to the left nor to the right. Words become ids; Re-Pair replaces the
most frequent pair of neighbours by a new symbol until no pair occurs twice, and what is left is paired up in a balanced
way. Every run crosses the boundary of the smallest symbol that holds it. So each symbol's boundary is looked at once, at
one place of its text: periods come from equal word grams next to the boundary, and how far each reaches comes from names
of all windows of 2, 4, 8 ... words, by which equal stretches are measured exactly. What is found for a symbol holds
wherever it is derived; intervals of one period that lie within another are parts of it.

Texts, or parts of them, that can't hold a run never come that far: in a run nearly every gram of words returns within a
period, so only stretches of grams that return soon enough for the stretch's own length are read at all.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .arrowtext import small_batches, text_bytes
from .bpe import runs as text_runs

LEAST, TIMES = 24, 3
#: Bytes of texts whose grams are sorted together (one text at least), and candidates that are measured together.
SPLIT_BYTES, CANDIDATES = 1 << 21, 200_000
RUN = "struct<start:bigint,length:bigint,period:bigint>"


class Grammar:
    """Re-Pair of a sequence, most frequent pair first and among equally frequent ones the oldest, so that it stays flat.

    For each symbol from `first` on: `left`, `right`, `size` in words, and `at`, one place where it stands.
    """

    def __init__(self, words: list[int]):
        n = len(words)
        self.first = max(words, default=-1) + 1
        self.left, self.right, self.at = [], [], []
        self.size = [1] * self.first
        sym, after, before = list(words), [*range(1, n), -1], list(range(-1, n - 1))
        places: dict[tuple[int, int], list[int]] = {}
        for i in range(n - 1):
            places.setdefault((sym[i], sym[i + 1]), []).append(i)
        count = {p: len(x) for p, x in places.items()}
        heap = [(-c, age, p) for age, (p, c) in enumerate(count.items()) if c > 1]
        heapq.heapify(heap)
        age = len(count)
        while heap:
            c, old, pair = heapq.heappop(heap)
            now = count.get(pair, 0)
            if now < 2:
                continue
            if now != -c:
                heapq.heappush(heap, (-now, old, pair))
                continue
            a, b = pair
            found = [i for i in sorted(places.pop(pair)) if sym[i] == a and after[i] >= 0 and sym[after[i]] == b]
            del count[pair]
            if a == b:  # of overlapping places the first counts
                apart, end = [], -1
                for i in found:
                    if i != end:
                        apart.append(i)
                        end = after[i]
                found = apart
            if len(found) < 2:
                continue
            new = self.symbol(a, b, found[0])
            made: dict = {}
            for i in found:
                j = after[i]
                p, k = before[i], after[j]
                if p >= 0:
                    old_pair = (sym[p], a)
                    if old_pair in count:
                        count[old_pair] -= 1
                if k >= 0:
                    old_pair = (b, sym[k])
                    if old_pair in count:
                        count[old_pair] -= 1
                    before[k] = i
                sym[i], sym[j], after[i] = new, -1, k
                if p >= 0:
                    made.setdefault((sym[p], new), []).append(p)
                if k >= 0:
                    made.setdefault((new, sym[k]), []).append(i)
            for pair, some in made.items():
                places.setdefault(pair, []).extend(some)
                count[pair] = count.get(pair, 0) + len(some)
                if count[pair] > 1:
                    heapq.heappush(heap, (-count[pair], age, pair))
                    age += 1
        row = [(i, sym[i]) for i in range(n) if sym[i] >= 0]
        self.repeated = len(self.size)  # symbols from here on stand in one place only
        while len(row) > 1:
            up = [(i, self.symbol(x, y, i)) for (i, x), (_, y) in zip(row[::2], row[1::2])]
            row = up + row[len(row) - len(row) % 2 :]
        self.root = row[0][1] if row else -1

    def symbol(self, a: int, b: int, at: int) -> int:
        self.left.append(a), self.right.append(b), self.at.append(at)
        self.size.append(self.size[a] + self.size[b])
        return len(self.size) - 1

    def places(self, least: int) -> dict[int, list[int]]:
        """All places of every symbol of at least so many words."""
        found: dict[int, list[int]] = {self.root: [0]}
        for s in range(len(self.size) - 1, self.first - 1, -1):
            if s in found:
                a, b = self.left[s - self.first], self.right[s - self.first]
                for child, move in ((a, 0), (b, self.size[a])):
                    if self.size[child] >= least:
                        found.setdefault(child, []).extend([p + move for p in found[s]] if move else found[s])
        return found


class Windows:
    """Names of all windows of 1, 2, 4, ... words: equal names are equal words. Windows cut off at the end equal none."""

    def __init__(self, words: np.ndarray):
        n = self.n = len(words)
        self.names = [np.append(np.unique(words, return_inverse=True)[1], -1)]
        while 2 << (len(self.names) - 1) <= n:
            last, half = self.names[-1], 1 << (len(self.names) - 1)
            behind = np.full(n, -1)
            behind[: n - half] = last[half:n]
            pair = last[:n] * (n + 2) + behind + 1
            self.names.append(np.append(np.unique(pair, return_inverse=True)[1], -1))

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that are equal from i and from j > i on."""
        i, j = i.copy(), j.copy()
        start = i.copy()
        for k in range(len(self.names) - 1, -1, -1):
            same = self.names[k][np.minimum(i, self.n)] == self.names[k][np.minimum(j, self.n)]
            same &= j < self.n
            i += same << k
            j += same << k
        return i - start

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that are equal before i and before j > i."""
        i, j = i.copy(), j.copy()
        start = i.copy()
        for k in range(len(self.names) - 1, -1, -1):
            step = 1 << k
            same = (self.names[k][np.maximum(i - step, 0)] == self.names[k][np.maximum(j - step, 0)]) & (i >= step)
            i -= same << k
            j -= same << k
        return start - i


def crossing(grammar: Grammar, windows: Windows, least: int, times: int, gram: int) -> Iterator[tuple]:
    """(symbol, start, end, period) of the runs within each symbol that cross its boundary, as arrays."""
    g = windows.names[gram.bit_length() - 1]
    held, count = [], 0
    for s in range(grammar.first, len(grammar.size)):
        n = grammar.size[s]
        if n < least:
            continue
        a = grammar.at[s - grammar.first]
        m, e, most = a + grammar.size[grammar.left[s - grammar.first]], a + n, n // times
        # from the boundary back, from a gram before it back, from the word before it ahead: see the tests on runs of all shapes
        for anchor, back, room in ((m, True, m - a if m + gram <= e else 0), (m - gram, True, m - gram - a), (m - 1, False, e - gram - m + 1)):
            room = min(room, most)
            if room < 1:
                continue
            near = g[anchor - room : anchor][::-1] if back else g[anchor + 1 : anchor + 1 + room]
            q = np.flatnonzero(near == g[anchor]) + 1
            if len(q):
                held.append((q, anchor - q if back else np.full(len(q), anchor), s, a, m, e))
                count += len(q)
        if count > CANDIDATES:
            yield measured(held, windows, least, times)
            held, count = [], 0
    if held:
        yield measured(held, windows, least, times)


def measured(held: list, windows: Windows, least: int, times: int) -> tuple:
    """The candidates that are runs; of one symbol's with equal ends that of the smallest period."""
    q, i = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
    s, a, m, e = (np.repeat([x[k] for x in held], [len(x[0]) for x in held]) for k in (2, 3, 4, 5))
    start = np.maximum(i - windows.behind(i, i + q), a)
    end = np.minimum(i + windows.ahead(i, i + q) + q, e)
    good = (end - start >= np.maximum(least, times * q)) & (start < m) & (end > m)
    return smallest(s[good], start[good], end[good], q[good])


def smallest(s: np.ndarray, start: np.ndarray, end: np.ndarray, q: np.ndarray) -> tuple:
    by = np.lexsort((q, end, start, s))
    s, start, end, q = s[by], start[by], end[by], q[by]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return s[new], start[new], end[new], q[new]


def word_runs(words: np.ndarray, least: int = LEAST, times: int = TIMES, gram: int = 0) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of ids, by start, then period."""
    gram = gram or gram_size(least)
    if len(words) < least:
        return []
    windows = Windows(words)
    grammar = Grammar(windows.names[0][:-1].tolist())
    found = list(crossing(grammar, windows, least, times, gram))
    if not found:
        return []
    s, start, end, q = (np.concatenate([f[k] for f in found]) for k in range(4))
    places = grammar.places(least)
    at = {x: np.array(places[x]) - grammar.at[x - grammar.first] for x in set(s.tolist())}
    moves = [at[x] for x in s.tolist()]
    times_each = [len(x) for x in moves]
    move = np.concatenate([np.empty(0, int), *moves]).astype(int)
    start, end, q = np.repeat(start, times_each) + move, np.repeat(end, times_each) + move, np.repeat(q, times_each)
    # intervals of one period that lie within another one are parts of it
    by = np.lexsort((-end, start, q))
    start, end, q = start[by], end[by], q[by]
    whole, reach, period = np.zeros(len(q), bool), -1, -1
    for i, (e, p) in enumerate(zip(end.tolist(), q.tolist())):
        if p != period:
            period, reach = p, -1
        if e > reach:
            whole[i], reach = True, e
    _, start, end, q = smallest(np.zeros(whole.sum(), int), start[whole], end[whole], q[whole])
    by = np.lexsort((q, start))
    return list(zip(start[by].tolist(), (end - start)[by].tolist(), q[by].tolist()))


def gram_size(least: int) -> int:
    """A power of two, at most a third of the shortest run."""
    return 1 << ((least // 3).bit_length() - 1)


def stretches(words: np.ndarray, off: np.ndarray, least: int, times: int, gram: int) -> Iterator[tuple[int, int, int]]:
    """(text, first, behind the last word) of what may hold runs; none of these overlap.

    A run of period q has at least `length - q - gram + 1` grams in a row that return q words later. So in a stretch of
    s such grams q is at most (s + gram - 1) / (times - 1), and grams that return later than that can't belong to a run.
    """
    n, text = len(words), np.repeat(np.arange(len(off) - 1), np.diff(off))
    if n < gram:
        return
    h = text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = h[: n - gram + 1]
    w = words.astype(np.uint64) + np.uint64(1)
    for k in range(gram):  # equal grams have equal hashes; others seldom, which only lets more through
        h = (h ^ w[k : n - gram + 1 + k]) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(29)
    by = np.argsort(h, kind="stable")
    gap = np.full(len(h), n)
    again = (h[by][1:] == h[by][:-1]) & (text[by][1:] == text[by][:-1])
    gap[by[:-1][again]] = np.diff(by)[again]
    ok = (gap < n) & (np.arange(len(h)) + gram <= off[1:][text[: len(h)]])
    fewest = least - least // times - gram + 1
    while True:
        edge = np.flatnonzero(np.diff(np.concatenate([[0], ok.astype(np.int8), [0]])))
        first, last = edge[::2], edge[1::2]
        # a stretch ends with its text
        cut = np.flatnonzero(text[first] != text[np.maximum(last - 1, 0)])
        if len(cut):
            inner = [off[text[first[c]] + 1 : text[last[c] - 1] + 1] for c in cut]
            first, last = np.sort(np.concatenate([first, *inner])), np.sort(np.concatenate([last, *inner]))
        size = last - first
        most = np.where(size >= fewest, (size + gram - 1) // (times - 1), 0)
        keep = np.zeros(len(h), bool)
        inside = np.repeat(np.arange(len(size)), size)
        where = np.flatnonzero(ok)
        keep[where] = gap[where] <= most[inside]
        if (keep == ok).all():
            break
        ok = keep
    now: list[int] = []
    for a, b in zip(first.tolist(), last.tolist()):
        t = int(text[a])
        end = min(int(off[t + 1]), b - 1 + (b - a + gram - 1) // (times - 1) + gram)
        if now and now[0] == t and a <= now[2]:
            now[2] = max(now[2], end)
            continue
        if now:
            yield tuple(now)
        now = [t, a, end]
    if now:
        yield tuple(now)


def found_in(split: list[list[bytes]], least: int = LEAST, times: int = TIMES) -> list[list[tuple[int, int, int]]]:
    """Runs of each of several texts, given as words."""
    number = {w: i for i, w in enumerate(set().union(*split))}
    off = np.cumsum([0] + [len(ws) for ws in split])
    words = np.fromiter((number[w] for ws in split for w in ws), np.int64, off[-1])
    out: list = [[] for _ in split]
    for t, a, b in stretches(words, off, least, times, gram_size(least)):
        out[t] += [(s + a - int(off[t]), n, q) for s, n, q in word_runs(words[a:b], least, times)]
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run holds after its first period, joined by spaces."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, int)
    for s, n, q in runs:
        edge[s + q] += 1
        edge[s + n] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()])


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and collapsed of every row's text.

    Words are what ASCII white space parts. Collapsed is the text without the words that a run holds after its first
    period, its words joined by one space. Null and empty texts have no words, no runs and an empty collapsed text;
    repeated rows give a row each; texts of any length are read whole; an empty table gives an empty result; further
    columns of `docs` are ignored. Runs take at least 3 words and `times` at least 3.
    """
    if least < 3 or times < 3:
        raise ValueError("runs of less than three words or periods aren't looked for")
    small_batches(docs.sparkSession)
    d = docs.select("doc_id", "text")
    kind = d.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = text_bytes(b.column(1))
            for i, j in text_runs(off, SPLIT_BYTES):
                data, at = raw[off[i] : off[j]].tobytes(), (off[i : j + 1] - off[i]).tolist()
                split = [data[x:y].split() for x, y in zip(at[:-1], at[1:])]
                found = found_in(split, least, times)
                ends = np.cumsum([0] + [len(x) for x in found])
                flat = np.array([r for x in found for r in x], np.int64).reshape(-1, 3)
                lists = pa.ListArray.from_arrays(
                    pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(i, j - i), pa.array([len(ws) for ws in split], pa.int64()), lists,
                    pa.array([collapsed(ws, x).decode() for ws, x in zip(split, found)], pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    return d.mapInArrow(run, f"doc_id {kind}, n_words long, runs array<{RUN}>, collapsed string")


def planted(doc_id: Column, text: Column) -> Column:
    """The contract's texts: one in ten, by the id's crc32, goes on periodically from some word on."""
    h = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(1))
    g = F.floor(h / 10)

    def periodic(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.when(n > 0, F.concat_ws(" ", F.slice(w, 1, a), F.transform(F.sequence(a, n - 1), lambda i: F.get(w, a + (i - a) % p)))).otherwise(F.lit(""))

    return F.when(h % 10 == 0, F.get(F.transform(F.array(common.words(text)), periodic), 0)).otherwise(text)


def digests(found: DataFrame) -> DataFrame:
    """The columns of the contract from those of `periodic_runs`."""
    greater = lambda best, r: best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])
    best = F.aggregate("runs", F.lit(None).cast(RUN), lambda best, r: F.when(greater(best, r), r).otherwise(best))
    line = F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]))
    sha = lambda x: F.sha2(x.cast("binary"), 256)
    lines = F.concat_ws("", F.transform(line, lambda x: F.concat(x, F.lit("\n"))))
    d = found.withColumn("best", best)
    return d.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        sha(lines).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return digests(periodic_runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))))
