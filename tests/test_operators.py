"""Operators in cases that the tables don't bring: ties, bounds, streams, stores and jobs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from framequarry.functions import scalars as S
from framequarry.operators import detections, identities, jobs, playback, series, storage, stores
from framequarry.operators.versions import Table
from framequarry.plans.groups import by_group, folded
from framequarry.session import scratch
from framequarry.sources import frames
from framequarry.streaming import policies

CATALOGUE = "ord int, id string, centroid array<double>, source_path string, occurrences long, first_frame long, first_bbox string, ref_frame long, sex string, age int, det_score double"


def catalogue(spark, *rows):
    names = ("id", "centroid", "source_path", "occurrences", "first_frame", "first_bbox", "ref_frame", "sex", "age", "det_score")
    blank = dict.fromkeys(names) | {"occurrences": 1}
    return spark.createDataFrame([(i, *[(blank | r)[n] for n in names]) for i, r in enumerate(rows)], CATALOGUE)


def test_merge(spark):
    """The first listed survives and keeps its place; the earliest and the best bring what describes them."""
    c = catalogue(
        spark, {"id": "a", "centroid": [1.0, 0.0], "occurrences": 3, "source_path": "alice", "first_frame": 10, "det_score": 0.6, "age": 30},
        {"id": "b", "centroid": [0.0, 1.0], "occurrences": 1, "first_frame": 3, "first_bbox": "box", "det_score": 0.95, "age": 31, "sex": "F"},
        {"id": "c", "centroid": [1.0, 1.0], "occurrences": 7}, {"id": "d", "centroid": [1.0, 0.0], "source_path": "dora", "age": 5})
    pick = lambda df: {r.id: r for r in df.collect()}
    group = lambda *ids: spark.createDataFrame([(x, "g", i) for i, x in enumerate(ids)], "id string, grp string, pos int")
    m = pick(identities.merge(c, group("b", "a"), 2))
    assert m.keys() == {"b", "c", "d"} and m["b"].ord == 1
    assert (m["b"].occurrences, m["b"].source_path, m["b"].first_frame, m["b"].first_bbox, m["b"].det_score, m["b"].age, m["b"].sex) == (4, "alice", 3, "box", 0.95, 31, "F")
    assert m["b"].centroid == pytest.approx((np.array([3.0, 1.0]) / np.sqrt(10)).tolist())
    assert pick(identities.merge(c, group("c", "d"), 2))["c"].age is None  # unknown scores count as 0: the first of them stays
    assert pick(identities.merge(c, group("c", "nobody"), 2)) == pick(c)


@pytest.mark.parametrize(("rows", "want"), [
    ([(-400, 1), (-300, 1), (-200, 1), (-100, 1), (0, 1)], 10.0), ([(-10_000, 1), (-9_000, 1), (-100, 1), (0, 1)], 10.0),
    ([(-5_100, 1), (-5_000, 1), (-4_900, 0), (0, 0)], 0.2), ([(-60_000, 1), (0, 0)], 0.0), ([(0, 1)], 0.0), ([(-500, 1), (-500, 1), (0, 0)], 0.0),
])
def test_rate_with_decay(spark, rows, want):
    df = spark.createDataFrame([("s", ms * 1000 + 10**9, bool(e)) for ms, e in rows], "k string, us long, is_event boolean")
    got = series.rate_with_decay(df, ["k"]).orderBy("us").collect()[-1].rate
    assert got == pytest.approx(want)


def test_media_kinds(spark):
    paths = {"a.gif": "image", "A.JFIF": "image", "x/y.tga": "image", "b.3gp": "video", "c.M2TS": "video", "d.tar.rmvb": "video", ".gif": "other", "a": "other", "a.": "other", "mp4/a": "other"}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r.p: r.k for r in df.select("p", S.media_kind(F.col("p")).alias("k")).collect()} == paths
    own = df.select("p", S.media_kind(F.col("p"), video=[".GIF", ""], image=["3gp"]).alias("k")).collect()
    assert {r.p for r in own if r.k == "video"} == {"a.gif"} and {r.p for r in own if r.k == "image"} == {"b.3gp"}


def test_predictive_lead(spark):
    lead = lambda *cap: spark.range(1).select(S.predictive_lead(F.lit(30.0), F.lit(1.0), F.lit(8), F.lit(120), *[F.lit(c) for c in cap])).first()[0]
    assert (lead(), lead(2.0), lead(9.0)) == (120, 60, 120)


def test_scores_in_parts(spark):
    """A catalogue beyond the bound is met part by part; ties go to the smallest ord, also between blocks."""
    rng = np.random.default_rng(5)
    c = rng.normal(size=(300, 4))
    c[200] = c[7]
    c /= np.sqrt((c * c).sum(1, keepdims=True))
    q = np.concatenate([rng.normal(size=(40, 4)), c[[7, 200]]])
    cat = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "ord int, centroid array<double>")
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)] + [(99, None)], "k long, v array<double>")
    whole = sorted((r.k, r.rank, r.ord) for r in identities.scores(rows, "k", "v", cat, 3).collect())
    parts = sorted((r.k, r.rank, r.ord) for r in identities.scores(rows, "k", "v", cat, 3, most=200).collect())
    sim = (q / np.sqrt((q * q).sum(1, keepdims=True))) @ c.T
    want = [(i, k + 1, int(o)) for i, s in enumerate(sim) for k, o in enumerate(np.lexsort((np.arange(300), -np.round(s, 12)))[:3])]
    assert [x for x in whole if x[0] != 99] == [x for x in parts if x[0] != 99] == sorted(want)
    assert [x[2] for x in whole if x[0] == 99] == [0, 1, 2]


def clusters(vectors: list[list[float]], threshold: float) -> list[int]:
    means, n, out = [], [], []
    for v in vectors:
        v = np.array(v, float)
        v = v / (np.sqrt((v * v).sum()) or 1)
        best, at = -2.0, -1
        for i, m in enumerate(means):
            s = float(m @ v)
            if s >= threshold and s >= best:  # of equals the last
                best, at = s, i
        if at < 0:
            means.append(v), n.append(1)
            out.append(len(means) - 1)
        else:
            m = means[at] * n[at] + v
            means[at], n[at] = m / (np.sqrt((m * m).sum()) or 1), n[at] + 1
            out.append(at)
    return out


@pytest.mark.parametrize(("vectors", "counts"), [
    ([(1, 0, 0), (0.95, 0.05, 0)], [2]), ([(1, 0, 0), (0, 1, 0), (0, 0, 1)], [1, 1, 1]), ([(1, 0, 0), (0, 1, 0), (0.95, 0.05, 0)], [2, 1]),
    ([(1, 0.01 * i, 0) if i % 2 else (0, 1, 0.01 * i) for i in range(12)], [6, 6]), ([(1, 0), (0, 1), (1, 1)], [1, 2]),
])
def test_clustering_fixtures(spark, vectors, counts):
    rows = spark.createDataFrame([("t", i, 0, [float(x) for x in v]) for i, v in enumerate(vectors)], "target string, f long, pos int, v array<double>")
    got = [r.cluster for r in identities.online_clusters(rows, "target", "f", "pos", "v", 0.5).orderBy("f").collect()]
    assert got == clusters(vectors, 0.5) and [got.count(i) for i in range(len(counts))] == counts


def test_clustering_random(spark):
    rng = np.random.default_rng(6)
    vectors = {t: rng.normal(size=(120, 3)).tolist() for t in range(5)}
    rows = spark.createDataFrame([(t, i, 0, v) for t, vs in vectors.items() for i, v in enumerate(vs)], "target long, f long, pos int, v array<double>")
    got = identities.online_clusters(rows.repartition(3), "target", "f", "pos", "v", 0.6).orderBy("target", "f").collect()
    for t, vs in vectors.items():
        assert [r.cluster for r in got if r.target == t] == clusters(vs, 0.6)


def test_folds_stream_batches(spark):
    """Groups, null keys among them, that span many batches are folded as one, with the state alone carried on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.createDataFrame([(None if i % 3 == 0 else i % 3, i, i) for i in range(100)], "k long, seq long, x long")
        got = folded(df, ["k"], ["seq"], lambda: 0, lambda s, row: (s + row[1], [(row[0], s + row[1])]), "seq long, run long", lambda s: [(None, s)])
        for k in (None, 1, 2):
            rows = [r for r in got.collect() if r.k == k]
            want = list(np.cumsum([i for i in range(100) if (None if i % 3 == 0 else i % 3) == k]))
            assert [r.run for r in rows if r.seq is not None] == want and [r.run for r in rows if r.seq is None] == [want[-1]]
        sizes = by_group(df, ["k"], ["seq"], lambda x: x.iloc[:1].assign(seq=len(x)), df.schema).collect()
        assert sorted((r.seq, r.k or 0) for r in sizes) == [(33, 1), (33, 2), (34, 0)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_prune_counts(spark):
    items = spark.createDataFrame([(i, i % 5) for i in range(50)], "id long, age long")
    gone = lambda **x: sorted(r.id for r in storage.prune_to_count(items, 40, "age", "id", **x).collect())
    assert gone() == sorted(sorted(range(50), key=lambda i: (i % 5, i))[:10])
    assert gone(puts=150) == [] and len(gone(puts=200)) == 10 and gone(slack=1.3) == []


def test_latest_wins_stream_honours_generations(spark, tmp_path):
    rows = [("a", i, s, g) for i, (s, g) in enumerate([(5, 0), (3, 0), (1, 1), (9, 0), (2, 1), (2, 1), (0, 2)])]
    done = spark.createDataFrame(rows, "k string, at long, seq long, gen long")
    for i in range(0, 7, 3):
        done.where(F.col("at").between(i, i + 2)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(done.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = policies.latest_wins_stream(stream, "k", "at", "seq", "gen").writeStream.format("memory").queryName("newest").option(
        "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    want = sorted(r.at for r in policies.latest_wins(done, "k", "at", "seq", "gen").collect())
    assert sorted(r.at for r in spark.table("newest").collect()) == want == [0, 2, 4, 6]


def test_strategy_ways():
    """From the present frame into sequence and back, and giving up when sequence brings nothing."""
    p = policies.synced()
    tick = lambda target, done, latency: policies.Tick(0, target, 10, done, latency, None, 1, 0)
    state, seen = policies.START, []
    for target, done, latency in [(100, 90, 200.0), (200, 100, 20.0), (200, 100, 200.0), (210, 130, 0.0), (210, 181, 0.0), (300, 181, 200.0), (500, 181, 0.0), (600, 400, 99.0), (420, 400, 0.0), (500, 400, 99.0)]:
        state, _ = p(state, tick(target, done, latency))
        seen.append("back" if state[0] else "given up" if state[2] else "present")
    assert seen == ["present", "present", "back", "back", "present", "back", "given up", "given up", "present", "back"]


def test_frame_stores(spark, tmp_path):
    f = spark.range(10).select(F.col("id").alias("frame_index"))
    with stores.Session(spark, str(tmp_path)) as path:
        assert not Table(spark, path).exists() and stores.has(spark, path, "a", f).where("present").isEmpty()
        frames.save(f.where("frame_index < 8"), path, "a"), frames.save(f.where("frame_index < 3"), path, "b")
        stores.clear_from(spark, path, 5)
        assert sorted(r.frame_index for r in stores.has(spark, path, "a", f).where("present").collect()) == [0, 1, 2, 3, 4]
        assert frames.load(spark, path, "b").count() == 3
    assert not Table(spark, path).exists()


def test_holdings(spark):
    log = [("s", 0, "put", 1), ("s", 1, "put", 2), ("s", 2, "invalidate", 1), ("s", 3, "put", 1), ("s", 4, "invalidate", 2), ("s", 5, "put", 3), ("s", 6, "invalidate_from", 3), ("s", 7, "put", 5), ("s", 8, "evict", 5),
           ("t", 0, "put", 1), ("t", 1, "invalidate", 1), ("t", 2, "invalidate_all", None), ("t", 3, "put", 2)]
    got = stores.holdings(spark.createDataFrame(log, "k string, seq long, op string, frame long"), "k").collect()
    assert {(r.k, r.frame): r.state for r in got} == {("s", 1): "ready", ("s", 2): "invalid", ("s", 3): "gone", ("s", 5): "stored", ("t", 1): "gone", ("t", 2): "ready"}
    with pytest.raises(ValueError, match="SOMETIMES"):
        stores.readable(spark.range(1), "SOMETIMES")


def test_settings(spark, tmp_path):
    path = tmp_path / "settings.json"
    defaults = {"theme": "dark", "size": "3"}
    assert frames.settings(spark, str(path), defaults) == defaults
    path.write_text('{"theme": "light", "later": 1}')
    assert frames.settings(spark, str(path), defaults) == {"theme": "light", "size": "3"}
    path.write_text('{"theme": ')
    assert frames.settings(spark, str(path), defaults) == defaults and (tmp_path / "settings.json.bak").exists()


def test_save_whole_replaces(spark, tmp_path):
    p = str(tmp_path / "t")
    stores.save_whole(spark.range(3), p)
    stores.save_whole(spark.range(5), p)
    assert Table(spark, p).read().count() == 5 and Table(spark, p).read(1).count() == 3


def test_backends(spark):
    with pytest.raises(ValueError, match="unknown backend"):
        frames.video(spark, "tape")


def test_geometry_is_stored_whole_or_not(spark):
    g = lambda rows: detections.stored(spark.createDataFrame(rows, "i long, embedding array<double>, roll double")).collect()
    assert [r.embedding for r in g([(0, [0.1, 2049.0], 1.0), (1, [1.0, 65504.0], 2.0)])] == [[float(np.float16(0.1)), 2048.0], [1.0, 65504.0]]
    assert {r.embedding is None for r in g([(0, [0.1], 1.0), (1, [1.0, 2.0], 2.0)])} == {True}
    assert [(r.embedding, r.roll) for r in g([(0, [0.5], None), (1, [1.0], 2.0)])] == [([0.5], None), ([1.0], None)]


def test_playback_keeps_what_is_shown(spark):
    rows = [(0, 5, True, None, False, False), (1, 6, False, 4, False, False), (2, 7, False, 5, False, False), (3, 8, False, 7, True, False), (4, 9, False, 7, False, False), (5, 2, True, None, False, False), (6, 2, True, None, False, True)]
    t = spark.createDataFrame([("s", *r) for r in rows], "k string, seq long, target long, hit boolean, fallback long, paused boolean, seek boolean")
    assert [(r.seq, r.shown) for r in playback.ticks_shown(t, "k").orderBy("seq").collect()] == [(0, 5), (4, 7), (5, 2), (6, 2)]


def test_scratch_needs_a_shared_folder():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "local-cluster[2,1,1024]"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch(Session(), "x")
