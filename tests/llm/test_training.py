"""The quality network's training: gradients by finite differences, and the bounds of its sample."""

from __future__ import annotations

import zlib

import numpy as np

from framequarry.llm import quality_net


def test_gradients():
    rng = np.random.default_rng(4)
    m = quality_net.empty_model()
    for k, scale in (("w", 0.4), ("b", 0.3), ("h", 0.5), ("hb", 0.3), ("v", 0.7), ("vb", 0.3)):
        m[k] += rng.normal(0, scale, m[k].shape).astype(np.float32)
    texts = [bytes(rng.integers(97, 110, n).astype(np.uint8)) for n in (3, 200, 700, 0, 1500)]
    y = np.array([1, 0, 1, 0, 1], np.float32)

    def loss(m) -> float:
        p, _ = quality_net.gradients(m, texts, y)
        return float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))

    _, g = quality_net.gradients(m, texts, y)
    checked = 0
    for k in m:
        flat = np.argsort(-np.abs(g[k]).ravel())[:12]  # where there is something to compare
        for i in flat.tolist():
            if abs(g[k].ravel()[i]) < 1e-3:
                continue
            near = []
            for e in (2e-3, 5e-3):
                up, down = ({**m, k: m[k].copy()} for _ in range(2))
                up[k].ravel()[i] += e
                down[k].ravel()[i] -= e
                near.append((loss(up) - loss(down)) / (2 * e))
            assert min(abs(x - g[k].ravel()[i]) for x in near) < 0.03 * abs(g[k].ravel()[i]) + 3e-4, (k, i)
            checked += 1
    assert checked > 30


def test_sample_is_bounded_in_bytes(spark):
    """Whole texts in the order of the sample, as many as fit; the first always."""
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2]
    docs = spark.createDataFrame([(i, "x" * (i % 50 + 1)) for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    whole = quality_net.training_rows(docs, labels, 100)
    assert whole.count() == 100
    some = quality_net.training_rows(docs, labels, 100, max_bytes=600).collect()
    assert 0 < sum(len(r.text) for r in some) <= 600 and {tuple(r) for r in some} <= {tuple(r) for r in whole.collect()} and len(some) > 10
    assert {tuple(r) for r in quality_net.training_rows(docs, labels, 100, max_bytes=1000).collect()} >= {tuple(r) for r in some}
    assert len(quality_net.training_rows(docs, labels, 100, max_bytes=0).collect()) == 1
    assert quality_net.training_rows(docs.limit(0), labels, 100).count() == 0
