"""Near-duplicate vectors against all pairs: counts, components, balls, blocks and recall at the threshold."""

from __future__ import annotations

import numpy as np
import pytest

from framequarry.llm import common, near_vectors

SCHEMA = "vec_id long, embedding array<float>"


def brute(ids: list, x: np.ndarray, threshold: float = 0.9) -> dict:
    x = x / np.sqrt((x * x).sum(1, keepdims=True))
    hit = x @ x.T >= threshold
    label = near_vectors.local_components(hit)
    return {i: (int(h.sum()) - 1, min(ids[j] for j in np.flatnonzero(label == k))) for i, h, k in zip(ids, hit, label)}


def table(spark, ids, x):
    return spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], SCHEMA)


def groups(rng, n_groups: int, size: int, noise: float, dim: int = 24) -> np.ndarray:
    c = rng.normal(size=(n_groups, dim))
    c /= np.sqrt((c * c).sum(1, keepdims=True))
    return (np.repeat(c, size, 0) + rng.normal(0, noise, (n_groups * size, dim))).astype(np.float32)


@pytest.mark.parametrize(("block", "hot"), [(2048, 0), (16, 0), (16, 400), (64, 400)])
def test_links_and_components(spark, block, hot):
    """All links, whether buckets are split, hot groups become balls, or vectors repeat."""
    rng = np.random.default_rng(9)
    x = np.concatenate([groups(rng, 60, 4, 0.05), groups(rng, 1, hot, 0.03), groups(rng, 1, hot // 4, 0.06), rng.normal(size=(150, 24)).astype(np.float32)])
    x = np.concatenate([x, x[:20], x[:5] * 4])
    ids = rng.permutation(len(x)).tolist()
    want = brute(ids, x.astype(float))
    got = near_vectors.near_vectors(table(spark, ids, x), recall=1 - 1e-9, block=block).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_hot_group_is_counted_not_compared(spark):
    """A group of near copies over a block lies in balls, whose parts never meet."""
    rng = np.random.default_rng(3)
    x = np.concatenate([groups(rng, 1, 600, 0.01), rng.normal(size=(100, 24)).astype(np.float32)])
    classes = table(spark, range(len(x)), x).selectExpr("vec_id AS cid", "1L AS m", "embedding AS e")
    plain = near_vectors.Hashing(4, 3, 0.9, [], 7)
    leaders = near_vectors.hot_leaders(classes, plain, 0.9, 64)
    assert leaders
    how = near_vectors.Hashing(4, 3, 0.9, leaders, 7)
    members = near_vectors.ball_members(classes, how).collect()
    assert {r.cid for r in members} >= set(range(600))
    rows = common.dealt(near_vectors.hashed(classes, how, 3), 64)
    assert rows.count() < 3 * len(x) * 4


def test_recall_at_the_threshold(spark):
    """Pairs of a cosine just over 0.9, the hardest: at least nine in ten are found, and none below it."""
    rng = np.random.default_rng(4)
    n, dim = 3000, 64
    a = rng.normal(size=(n, dim))
    a /= np.sqrt((a * a).sum(1, keepdims=True))
    b = rng.normal(size=(n, dim))
    b -= (b * a).sum(1, keepdims=True) * a
    b /= np.sqrt((b * b).sum(1, keepdims=True))
    c = rng.uniform(0.9005, 0.905, (n, 1))
    far = a[:500] * 0.899 + b[:500] * np.sqrt(1 - 0.899**2)
    x = np.concatenate([a, a * c + b * np.sqrt(1 - c * c), far]).astype(np.float32)
    want = brute(list(range(len(x))), x.astype(float))
    got = {r.vec_id: r.n_links for r in near_vectors.near_vectors(table(spark, range(len(x)), x)).collect()}
    assert all(got[i] <= k for i, (k, _) in want.items())
    share = sum(got.values()) / sum(k for k, _ in want.values())
    print(f"recall at the threshold {share:.3f}")
    assert share >= 0.92


def test_null_ids_and_doubles(spark):
    rows = [(None, [1.0, 0.0]), (None, [1.0, 0.01]), (5, [1.0, 0.02]), (None, [0.0, 1.0]), (None, [0.0, 0.0])]
    got = near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.n_links, r.component_id or -1, r.kept) for r in got) == [(0, -1, True), (0, -1, True), (2, 5, False), (2, 5, False), (2, 5, True)]
    assert near_vectors.near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
