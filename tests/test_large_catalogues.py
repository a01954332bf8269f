"""Matches against a catalogue that goes through the shuffle in blocks, and folds over recent rows, against plain versions."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framequarry.operators import identities, playback, stores

CATALOGUE = "ord int, id string, centroid array<double>, source_path string"


def clustered(rng, n, d, groups, spread):
    centers = rng.normal(size=(groups, d))
    return [(centers[rng.integers(groups)] + spread * rng.normal(size=d)).tolist() for _ in range(n)]


def brute(rows, cat, k):
    out = set()
    for key, v in rows:
        if not v:
            continue
        x = np.array(v)
        x = x / (np.linalg.norm(x) or 1)
        found = sorted((-float(x @ np.array(c)), o) for o, c in cat if len(c) == len(v))[:k]
        out |= {(key, rank, o, round(-s, 9)) for rank, (s, o) in enumerate(found, 1)}
    return out


@pytest.mark.parametrize(("k", "spread", "skew"), [(1, 0.05, False), (3, 0.05, False), (1, 3.0, True), (2, 0.3, True)])
def test_blocks_match_brute_force(spark, monkeypatch, k, spread, skew):
    """Tight and loose clusters, two lengths of vectors and one too rare for a pivot, vectors without direction, ties, and
    blocks cut into parts and copies."""
    if skew:
        monkeypatch.setattr(identities, "BLOCK_PART", 7)
        monkeypatch.setattr(identities, "ROWS_PART", 11)
    monkeypatch.setattr(identities, "PIVOTS", 12)
    rng = np.random.default_rng(k + int(10 * spread))
    vectors = clustered(rng, 150, 6, 9, spread) + clustered(rng, 60, 4, 3, spread) + [[1.0, 2.0, 3.0]]
    vectors = [(np.array(v) / np.linalg.norm(v) * rng.choice([1.0, 1.0, 0.5, 2.0])).tolist() for v in vectors] + [[0.0] * 6]
    vectors += vectors[:5]
    cat = list(enumerate(vectors))
    rows = clustered(rng, 150, 6, 9, 1.0) + clustered(rng, 40, 4, 3, 1.0) + [v for _, v in cat[::9]] + [[0.0] * 6, [0.0] * 4, [3.0, 2.0, 1.0], [1.0], [], None]
    rows = list(enumerate(rows))
    c = spark.createDataFrame([(o, f"i{o}", v, None) for o, v in cat], CATALOGUE)
    r = spark.createDataFrame(rows, "key long, v array<double>")
    got = identities.scores(r, "key", "v", c, k, most=100)
    # equal similarities may differ in their last digit: ties are compared by similarity, all others by who
    want = brute(rows, cat, k)
    got = {(x.key, x.rank, x.ord, round(x.sim, 9)) for x in got.collect()}
    assert {(a, b, d) for a, b, _, d in got} == {(a, b, d) for a, b, _, d in want}
    sims = {}
    for key, v in rows:
        if v:
            x = np.array(v) / (np.linalg.norm(v) or 1)
            sims[key] = [round(float(x @ np.array(u)), 9) for o, u in cat if len(u) == len(v)]
    assert all(g in want for g in got if sims[g[0]].count(g[3]) == 1)
    hits = identities.best_match(r, "key", "v", c, 0.9)
    assert {x.key for x in hits.collect()} == {a for a, b, _, d in brute(rows, cat, 1) if d >= 0.9 - 1e-12}


def test_blocks_are_pruned(spark, monkeypatch):
    """Rows of tight clusters meet few blocks, and nothing of the catalogue but its pivots comes to the driver."""
    monkeypatch.setattr(identities, "PIVOTS", 40)
    rng = np.random.default_rng(1)
    vectors = clustered(rng, 3000, 16, 40, 0.01)
    vectors = [(np.array(v) / np.linalg.norm(v)).tolist() for v in vectors]
    c = spark.createDataFrame([(o, f"i{o}", v, None) for o, v in enumerate(vectors)], CATALOGUE)
    r = spark.createDataFrame([(i, v) for i, v in enumerate(vectors[:300])], "key long, v array<double>")
    got = identities.scores(r, "key", "v", c, 1, most=1000)
    assert got.where("sim > 0.999").count() == 300
    assert {x.key: x.ord for x in got.where("key = ord").collect()}.keys() >= set(range(250))


def test_recent_values(spark):
    """Values of the last seconds within the last rows, with nulls and what isn't a number."""
    rng = random.Random(2)
    rows = [(u, 1000 * i + rng.randrange(500), rng.choice([None, 1.0, 2.5, float(rng.randrange(9))]), f"n{i}") for u in (1, 2) for i in range(200)]
    got = playback.recent_values(spark.createDataFrame(rows, "u long, us long, v double, note string"), ["u"], "v", "us", 0.02, most=15)
    assert got.columns == ["u", "us", "v", "note", "n", "median"]
    want = set()
    for u in (1, 2):
        mine = sorted(r for r in rows if r[0] == u)
        for i, r in enumerate(mine):
            near = sorted(x[2] for x in mine[max(0, i - 14) : i + 1] if x[1] >= r[1] - 20_000 and x[2] is not None)
            want.add((*r, len(near), (near[(len(near) - 1) // 2] + near[len(near) // 2]) / 2 if near else 0.0))
    assert {tuple(x) for x in got.collect()} == want


def test_latest_of_recent_puts(spark):
    rng = random.Random(3)
    log = [(u, i, rng.choice(["put", "put", "put", "invalidate", "tick", "tick", "other"]), rng.choice([None, *range(12)])) for u in ("a", "b") for i in range(400)]
    got = stores.latest_at_or_below(spark.createDataFrame(log, "k string, seq long, op string, frame long"), "k", recent=8)
    want = set()
    for u in ("a", "b"):
        puts: list = []
        for _, i, op, f in [x for x in log if x[0] == u and x[3] is not None]:
            if op == "put":
                puts = [*puts, [f, True]][-8:]
            elif op == "invalidate":
                puts = [[g, ok and g != f] for g, ok in puts]
            elif op == "tick":
                want.add((u, i, f, max((g for g, ok in puts if ok and g <= f), default=None)))
    assert {tuple(x) for x in got.collect()} == want
