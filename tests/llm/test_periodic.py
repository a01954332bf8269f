"""Runs of periodic words against their definition."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from framequarry.llm import periodic

SMALL = "/root/testdata/sf0.001"


def brute(words: list, least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """Every period in turn; of stretches with equal ends the smallest period counts."""
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def made(rng: random.Random) -> list[int]:
    k, out = rng.choice([1, 2, 3, 5, 50]), []
    for _ in range(rng.randint(1, 6)):
        kind = rng.random()
        if kind < 0.3:
            out += [rng.randrange(k) for _ in range(rng.randint(0, 40))]
        elif kind < 0.8:
            u = [rng.randrange(k) for _ in range(rng.randint(1, 30))]
            out += (u * 8)[: rng.randint(0, 5 * len(u) + 20)]
        elif out:
            out += out[rng.randrange(len(out)) :] * rng.randint(1, 3)
    return out[:500]


@pytest.mark.parametrize("least, times", [(24, 3), (9, 4), (3, 3), (10, 3), (30, 5)])
def test_shapes(least, times):
    """Random mixtures of periods, their repeats and noise over few words, alone and several texts together."""
    rng = random.Random(7 * least + times)
    texts = [made(rng) for _ in range(250)]
    want = [brute(t, least, times) for t in texts]
    assert [periodic.word_runs(np.array(t, int), least, times) for t in texts] == want
    assert sum(map(len, want)) > 100
    for i in range(0, len(texts), 50):
        assert periodic.found_in([[b"%d" % w for w in t] for t in texts[i : i + 50]], least, times) == want[i : i + 50]


def test_grammar():
    """Symbols expand to the words, at every place given for them, and the grammar of a long power stays flat."""
    rng = random.Random(3)
    for words in (made(rng), [1] * 1000, [rng.randrange(400) for _ in range(400)] * 5):
        g = periodic.Grammar(words)

        def expand(s: int, g=g) -> list[int]:
            return [s] if s < g.first else expand(g.left[s - g.first]) + expand(g.right[s - g.first])

        assert expand(g.root) == words
        for s, at in g.places(2).items():
            assert s < g.first or all(words[a : a + g.size[s]] == expand(s) for a in at)
        assert sum(g.size[g.first :]) < 40 * len(words)


def test_long():
    power, mixed = np.zeros(50_000, int), np.array(([0] * 999 + [1]) * 20)
    assert periodic.word_runs(power) == [(0, 50_000, 1)]
    got = periodic.word_runs(mixed)
    assert got[:2] == [(0, 999, 1), (0, 20_000, 1000)] and len(got) == 21
    u = list(range(9_000))
    assert periodic.word_runs(np.array([-5, *u, *u, *u, 4])) == [(1, 27_000, 9_000)]


def expected(doc_id, text) -> tuple:
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query(spark):
    """Digests of all documents but the longest, whose brute force takes too long."""
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    short = {r.doc_id for r in rows if len((r.text or "").split()) < 1500}
    got = periodic.op12_periodic_runs(spark, SMALL)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    got = {tuple(r) for r in got.collect()}
    assert len(got) == len(rows)
    assert {r for r in got if r[0] in short} == {expected(r.doc_id, r.text) for r in rows if r.doc_id in short}
    assert sum(r[1] > 0 for r in got) > len(rows) // 20


def test_frames(spark):
    """Nulls, repeats, clashing names, white space of all kinds, an empty table, and the outputs themselves."""
    line = "a b\t\vc\f" * 10
    rows = [(1, line, 1), (1, line, 1), (None, line + " end", 2), (2, None, None), (3, "", 3), (4, " \n ", 4), (5, "x " * 23, 5), (6, "x " * 24 + "\x1c ", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs long")
    got = sorted((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.periodic_runs(docs).collect())
    assert got == [
        (0, 31, [(0, 30, 3)], "a b c end"), (1, 30, [(0, 30, 3)], "a b c"), (1, 30, [(0, 30, 3)], "a b c"), (2, 0, [], ""), (3, 0, [], ""), (4, 0, [], ""),
        (5, 23, [], "x " * 22 + "x"), (6, 25, [(0, 24, 1)], "x \x1c ")]
    assert periodic.periodic_runs(docs.limit(0)).count() == 0
    ids = spark.createDataFrame([(i, "some words of a text that goes on " * (i % 7)) for i in range(200)] + [(None, "a b c"), (0, None)], "doc_id long, text string")
    want = sorted((expected(r.doc_id, r.text) for r in ids.collect()), key=str)
    got = periodic.digests(periodic.periodic_runs(ids.select("doc_id", periodic.planted(ids.doc_id, ids.text).alias("text")))).collect()
    assert sorted((tuple(r) for r in got), key=str) == want
    with pytest.raises(ValueError):
        periodic.periodic_runs(docs, times=2)
