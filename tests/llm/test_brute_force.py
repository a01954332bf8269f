"""Operators of the llm subpackage against plain Python versions, on small tables and in odd cases."""

from __future__ import annotations

import hashlib
import itertools
import json
import math
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent.parent.parent))

import corpus_pipeline
from framequarry.llm import common, jaccard_join, lattice_lm, line_dedup, mixing, packing, quality_net, quality_rules

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in rows], SCHEMA)


def poisson(u: float, rate: float) -> int:
    p = c = math.exp(-rate)
    k = 0
    while c <= u and k < rate + 12 * math.sqrt(rate) + 24:
        k += 1
        p *= rate / k
        c += p
    return k


def draw(doc_id, text, no, rate: float, seed: int) -> int:
    draws = max(1, math.ceil(rate / mixing.MOST_RATE))
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    us = [int(md5(f"{'null' if doc_id is None else doc_id}:{md5(text or '')}:{no}:{r}:{seed}")[:12], 16) / 2**48 for r in range(1, draws + 1)]
    return sum(poisson(u, rate / draws) for u in us)


@pytest.mark.parametrize("seed", [20, 21])
def test_mix_weights(spark, seed):
    """Counts of every row by weights, with repeated rows, null ids and a source without a weight."""
    rows = [(i if i % 3 else None, f"text {i % 40}", "en", ("a", "b", "c", None)[i % 4]) for i in range(400)] + [(7, "same", "en", "a")] * 50
    weights, total = {"a": 3.0, "b": 1.0}, 30_000.0
    got = Counter((r.doc_id, r.text, r.source) for r in mixing.mix(frame(spark, rows), weights, total, seed).collect())
    n = Counter(r[3] for r in rows)
    want: Counter = Counter()
    for (i, t, _, s), k in Counter(rows).items():
        rate = weights.get(s, 0.0) * total / 4 / n[s]
        want[i, t, s] += sum(draw(i, t, no, rate, seed) for no in range(1, k + 1))
    assert got == +want
    assert abs(sum(got.values()) - total) < 6 * math.sqrt(total)


@pytest.mark.parametrize("seed", [20, 21, 22])
def test_mix_null_ids(spark, seed):
    """Rows without an id, or equal in all columns, are drawn apart: targets hold in any seed, and rows spread over partitions."""
    rows = [(None, "one text", "en", "a")] * 2000 + [(None, f"text {i}", "en", "b") for i in range(1000)]
    got = mixing.mix(frame(spark, rows), seed=seed)
    n = {r.source: r["count"] for r in got.groupBy("source").count().collect()}
    assert all(abs(n[s] - 1500) < 6 * math.sqrt(1500) for s in "ab"), n
    assert len({r.p for r in got.select(F.spark_partition_id().alias("p")).distinct().collect()}) == got.rdd.getNumPartitions()


def test_mix_numbers_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "NUMBER_BLOCK", 7)
    rows = [(1, "t", "en", "a")] * 40 + [(2, "t", "en", "a")]
    docs = frame(spark, rows)
    got = mixing.numbered(docs, docs.columns).select("mix_doc.doc_id", "mix_no").collect()
    assert sorted((r.doc_id, r.mix_no) for r in got) == [(1, i) for i in range(1, 41)] + [(2, 1)]


def rule_limits(counts: list[dict], prior: int) -> dict:
    """Thresholds by (lang, source) from all ratios, without sketches but for the bucket ends."""

    def top(v: int) -> int:
        shift = max(0, v.bit_length() - 6)
        return v if v < 64 else (((v >> shift) + 1) << shift) - 1

    out = {}
    for rule, (a, b, scale, spread) in quality_rules.RULES.items():
        by: dict = defaultdict(Counter)
        for c in counts:
            if c["n_words"]:
                by[c["lang"], c["source"]][top(scale * c[a] // max(c[b], 1))] += 1
        langs: dict = defaultdict(Counter)
        for (lang, _), h in by.items():
            langs[lang].update(h)
        for (lang, source), h in by.items():
            mixed = Counter({v: 1000 * n for v, n in h.items()})
            mixed.update({v: prior * 1000 * n // sum(langs[lang].values()) for v, n in langs[lang].items()})
            total, up, q = sum(mixed.values()), 0, {}
            for v in sorted(mixed):
                up += mixed[v]
                for k in (1, 3):
                    if up * 4 >= total * k:
                        q.setdefault(k, v)
            out[lang, source, rule] = q[3] + 3 * max(q[3] - q[1], spread)
    return out


@pytest.mark.parametrize("prior", [0, 50])
def test_quality_rules_thresholds(spark, prior):
    """Every group, however small, has its own thresholds; its language's weigh as `prior` documents beside them."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        words = ["w" * int(rng.integers(1, 9)) + "!" * int(rng.integers(0, 3)) + "#" * int(rng.integers(0, 2 + i % 4)) for _ in range(int(rng.integers(0, 60)))]
        rows.append((i, " ".join(words), ("en", "de", None)[i % 3], ("a", "b", "c", "d", None)[int(rng.integers(0, 5)) if i % 7 else 0]))
    docs = frame(spark, rows)
    counts = [r.asDict() for r in quality_rules.counted(docs).collect()]
    want = rule_limits(counts, prior)
    source = {i: (lang, s) for i, _, lang, s in rows}
    for r in quality_rules.quality_rules(docs, prior).collect():
        if r.n_words:
            assert all(r[f"max_{rule}"] == want[(*source[r.doc_id], rule)] for rule in quality_rules.RULES)


def forward(m: dict, text: bytes) -> float:
    """The network's score by plain loops over chunks, places and filters."""
    n = int(quality_net.chunk_count(len(text)))
    step, size, logits = quality_net.STEP_BLOCKS * quality_net.BLOCK, quality_net.CHUNK, []
    # a chunk reads on into zeros, and its windows start in it; blocks behind the text's last are not looked at
    blocks = (len(text) + quality_net.WIDTH + quality_net.BLOCK - 1) // quality_net.BLOCK
    for k in range(n):
        end = min(k * step + size, blocks * quality_net.BLOCK)
        padded = text + bytes(size + quality_net.WIDTH)
        best = np.full(quality_net.FILTERS, -np.inf)
        for a in range(k * step, end):
            z = m["b"].astype(float).copy()
            for j in range(quality_net.WIDTH):
                z += m["w"][j][padded[a + j] if a + j < blocks * quality_net.BLOCK else 0]
            best = np.maximum(best, z)
        hid = np.tanh(np.maximum(best, 0) @ m["h"] + m["hb"])
        logits.append(float(hid @ m["v"] + m["vb"][0]))
    return 1 / (1 + math.exp(-np.mean(logits)))


def test_quality_net_forward(spark):
    rng = np.random.default_rng(8)
    m = {k: rng.normal(0, 0.3, v.shape).astype(np.float32) for k, v in quality_net.empty_model().items()}
    rows = [(1, "short"), (2, ""), (3, None), (4, "a longer text " * 30), (5, "x" * 256), (6, "y" * 193), (7, "ü€😀" * 100), (8, "z" * 58)]
    got = {r.doc_id: r.net_score for r in quality_net.quality_scores(spark.createDataFrame(rows, "doc_id long, text string"), m).collect()}
    for i, t in rows:
        assert got[i] == pytest.approx(forward(m, (t or "").encode()), abs=1e-5), i


def test_quality_net_odd_tables(spark, tmp_path):
    """The whole query with null and repeated ids, null and empty texts, no documents, and no labels."""
    rows = [(None, "no id", "en", "a"), (1, None, "en", "a"), (2, "", None, None), (3, "one text " * 40, "en", "a"), (3, "one text " * 40, "en", "a"), (3, "other", "en", "b")]
    for name, docs, labels in (("all", rows, [(1, 1, 0), (3, 0, 0), (3, 1, 0), (None, 1, 0), (9, None, 0)]), ("none", [], [(1, 1, 0)]), ("unlabelled", rows, [])):
        frame(spark, docs).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        got = quality_net.op3_quality_net(spark, f"{tmp_path}/{name}").collect()
        assert Counter(r.doc_id for r in got) == Counter(r[0] for r in docs)
        assert all(r.held_out is not None and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
        assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
        if name == "unlabelled":
            assert {r.score for r in got} == {0.5}


def test_lattice_document_scores(spark, tmp_path, monkeypatch):
    """Whole scores by a plain expectation step and a plain forward recursion, with frequent and rare words."""
    vocab = ["ab", "abc", "ca</w>", "b</w>", "abcab</w>", "cc"]
    (tmp_path / "v.json").write_text(json.dumps({"model": {"vocab": {v: i for i, v in enumerate(vocab)}}}))
    rng = np.random.default_rng(1)
    rows = [(i, " ".join("".join(rng.choice(list("abc"), int(rng.integers(1, 7)))) for _ in range(int(rng.integers(0, 30)))), "en", "a") for i in range(60)]
    rows += [(100, "a" * 90 + " abcab", "en", "a"), (101, None, "en", "a"), (102, "ABC abc", "en", "a")]
    pieces = lattice_lm.byte_pieces(str(tmp_path / "v.json"))
    p = {x: 1 / (i + 2.7) for i, x in enumerate(pieces)}
    longest = max(len(x) for x, _ in pieces)

    def sums(w: bytes, p: dict) -> tuple[list[float], list[float]]:
        n = len(w)
        f, b = [1.0] + [0.0] * n, [0.0] * n + [1.0]
        for j in range(1, n + 1):
            f[j] = sum(f[i] * p.get((w[i:j], j == n), 0.0) for i in range(max(0, j - longest), j))
        for i in range(n - 1, -1, -1):
            b[i] = sum(p.get((w[i:j], j == n), 0.0) * b[j] for j in range(i + 1, min(n, i + longest) + 1))
        return f, b

    words = {i: [w.encode() for w in WORDS.findall((t or "").lower())] for i, t, *_ in rows}
    train = [i for i in words if zlib.crc32(str(i).encode()) % 7 != 2]
    expected = dict.fromkeys(pieces, lattice_lm.ADDED)
    for w, c in Counter(w for i in train for w in words[i]).items():
        f, b = sums(w, p)
        for i in range(len(w)):
            for j in range(i + 1, min(len(w), i + longest) + 1):
                x = (w[i:j], j == len(w))
                if x in p:
                    expected[x] += c * f[i] * p[x] * b[j] / f[-1]
    end = lattice_lm.ADDED + len(train)
    total = sum(expected.values()) + end
    q = {x: v / total for x, v in expected.items()}
    want = {i: math.log10(end / total) + sum(math.log10(sums(w, q)[0][-1]) for w in ws) for i, ws in words.items()}
    for most in (200_000, 3):
        monkeypatch.setattr(lattice_lm, "MAX_FREQUENT", most)
        got = {r.doc_id: r.score for r in lattice_lm.lattice_scores(frame(spark, rows), str(tmp_path / "v.json")).collect()}
        assert got.keys() == want.keys()
        assert all(got[i] == pytest.approx(want[i], rel=1e-9) for i in want)


def test_packing_groups_are_packed_again(spark):
    """What small groups leave open is packed once more: hardly more sequences than one group needs, gapless and whole."""
    sizes = np.random.default_rng(2).integers(1, 1200, 3000).tolist()
    parts = spark.createDataFrame([(i, 0, 0, s, 0) for i, s in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    n = {}
    for group in (3000, 100):
        by = defaultdict(list)
        for r in packing.packed(parts, 2048, group).collect():
            by[r.sequence_id].append((r.offset, r.length))
        assert sum(len(x) for x in by.values()) == len(sizes)
        for x in by.values():
            ends = list(itertools.accumulate((k for _, k in sorted(x)), initial=0))
            assert [o for o, _ in sorted(x)] == ends[:-1] and ends[-1] <= 2048
        n[group] = len(by)
    best = math.ceil(sum(sizes) / 2048)
    assert best <= n[3000] <= best + 3 and n[100] <= 1.015 * best  # groups of 100 alone leave some 3 percent


def test_line_dedup_long_text(spark):
    """A text of very many lines, most of them removed, against a plain version."""
    common_lines = [f"line {i} of all" for i in range(3000)]
    rows = [(i, "\n".join(common_lines), "en", f"s{i}") for i in range(6)] + [(10, "\n".join([f"own {i}\n{x}\n" for i, x in enumerate(common_lines)]), "en", "s0"), (11, None, "en", "s1"), (12, "", "en", "s2")]
    got = {r.doc_id: r for r in line_dedup.line_dedup(frame(spark, rows)).collect()}
    assert got[0].text == rows[0][1] and got[1].text == "" and got[1].n_removed == 3000
    assert got[10].text == "\n".join(f"own {i}\n" for i in range(3000)) and got[10].n_removed == 3000
    assert got[11].text is None and got[12].text == ""


@pytest.mark.parametrize("sites", [19, 20, 21, 22, 18])
def test_line_dedup_site_border(spark, sites):
    """Near the threshold the sites are counted exactly, whatever the sketch estimates."""
    rows = [(i, f"shared line {k}", "en", f"site {i}") for k in range(5) for i in range(sites)] + [(900, "shared line 0", "en", None)] * 3
    got = line_dedup.line_dedup(frame(spark, rows), 20).collect()
    assert sum(r.n_removed for r in got) == (5 * (sites - 1) + 3 if sites >= 20 else 0)


ODD = [(1, "a text of some words that is long enough", "en", "a"), (1, "a text of some words that is long enough", "en", "a"), (1, "other words under the same id here", "en", "b"),
       (None, "a text without an id and some words", None, None), (None, "a text without an id and some words", None, None), (2, None, "en", "a"), (3, "", "de", "a"), (3, "", "de", "a"),
       (4, "x y z " * 30_000, "en", "a"), (5, "x y z " * 30_000, "en", "a"), (6, " \n\t\n", "en", "c"), (7, "line of all\nown words of seven", "en", "d")]
CLASH = ("net_score", "net_text", "kept_id", "row", "k1", "k2", "words", "kept", "row_key", "doc", "copy", "mix_doc", "mix_no", "dedup_gone", "n_removed", "first", "n", "item", "sequence_id_")


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stage_odd_rows(spark, tmp_path, stage):
    """Every stage: nulls, repeated rows and ids, empty and long texts, columns of clashing names, an empty table."""
    name, f = stage
    spark.createDataFrame([(i, 1, 0) for i in range(1, 8)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = frame(spark, ODD).selectExpr("*", *[f"array({i}) AS {c}" for i, c in enumerate(CLASH)])
    got = f(spark, docs, str(tmp_path))
    if name != "best_fit_packing":
        assert got.columns == docs.columns
    rows = got.collect()
    ids = Counter(r.doc_id for r in rows)
    if name == "line_dedup":
        assert ids == Counter(r[0] for r in ODD)
    elif name == "ngram_jaccard_join":
        assert ids == Counter([1, 1, None, 2, 3, 3, 4, 6, 7])
    elif name == "best_fit_packing":
        assert ids.keys() == {r[0] for r in ODD} and sum(r.length for r in rows if r.doc_id == 3) == 2
    else:
        assert ids.keys() <= {r[0] for r in ODD}
    assert f(spark, docs.limit(0), str(tmp_path)).collect() == []


def test_scratch_needs_a_shared_folder(monkeypatch):
    """On a cluster a folder of this machine is refused."""

    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        common.scratch_dir(Session())


def test_jaccard_kept_rows(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(None, text, "en", "a"), (5, text, "en", "a"), (5, text, "en", "a"), (5, text + " eleven", "en", "a"), (9, text, "en", "a"), (8, None, "en", "a")]
    got = jaccard_join.jaccard_groups(frame(spark, rows)).collect()
    assert {r.component_id for r in got} == {5, 8}
    kept = {r.row_key for r in got if r.kept and r.n_shingles}
    assert len(kept) == 1 and all((r.row_key in kept) == r.kept for r in got if r.n_shingles)


@pytest.mark.parametrize("most_together", [4096, 3])
def test_suffix_dedup_long_and_periodic_texts(spark, most_together):
    """Texts beyond a slice, with copies across its border, and periodic ones of several periods, against all substrings."""
    from framequarry.llm import suffix_dedup

    rng = np.random.default_rng(7)
    letters = lambda n: "".join(map(chr, rng.integers(97, 123, n).tolist()))
    part, big = letters(700), letters(1_100_000)
    rows = [(1, big[: 2**20 - 50] + part + big[2**20 - 50 :]), (2, "x" + part + "y" * 150), (3, big[2**20 - 300 : 2**20 + 900]), (4, "z" * 350), (5, ("abc" * 90) + part[:120]), (6, ("abcd" * 80)), (7, "bca" * 70)]
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), most_together=most_together).collect()
    seen: set[bytes] = set()
    want = {}
    for i, t in rows:
        b = t.encode()
        gone = np.zeros(len(b) + 1, np.int32)
        for k in range(len(b) - 99):
            h = hashlib.blake2b(b[k : k + 100], digest_size=12).digest()
            if h in seen:
                gone[k] += 1
                gone[k + 100] -= 1
            seen.add(h)
        out = np.cumsum(gone[:-1]) > 0
        kept = np.frombuffer(b, np.uint8)[~out].tobytes()
        want[i] = (len(b), int(out.sum()), int((out & ~np.concatenate([[False], out[:-1]])).sum()), hashlib.sha256(kept).hexdigest())
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want


def test_components(spark):
    """Long paths, stars, rings and no links at all, against a search."""
    rng = np.random.default_rng(5)
    edges = [(i, i + 1) for i in range(1000, 1040)] + [(5, i) for i in range(2000, 2100)] + [(i, 3000 + (i + 1) % 30 + 0) for i in range(3000, 3030)]
    edges += [tuple(map(int, rng.integers(4000, 4200, 2))) for _ in range(150)] + [(7, 7), (8, None)]
    order = rng.permutation(len(edges))
    low = {x: x for e in edges for x in e if x is not None and None not in e and e[0] != e[1]}
    for _ in range(60):
        for a, b in edges:
            if b is not None and a != b:
                low[a] = low[b] = min(low[a], low[b])
    got = common.components(spark.createDataFrame([edges[i] for i in order], "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == low
    assert common.components(spark.createDataFrame([], "a long, b long")).collect() == []
