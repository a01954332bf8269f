"""Operators of the llm subpackage against brute force, SQL, exact round trips and held-out labels."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent.parent))
from compare import duck_rows, spark_rows

import corpus_pipeline
from framequarry.llm import jaccard_join, lattice_lm, license_scan, line_dedup, mixing, near_vectors, packing, quality_net, quality_rules, registry, suffix_dedup

SMALL = "/root/testdata/sf0.001"
A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
ODD = [
    (1, "same words in this short text again and again", "en", "a", 45), (1, "same words in this short text again and again", "en", "a", 45), (2, None, None, None, None),
    (3, "", "en", "a", 0), (None, "a text without an id\nwith two lines", "en", None, 35), (4, LONG, "de", "b", len(LONG)), (5, LONG, None, "b", len(LONG)),
    (6, " \n\t\n ", "en", "c", 5), (7, "İK ſ under the MIT license ünïcode \U0001F600 tail", "fr", "c", 40), (8, "x" * 5000, "en", "d", 5000),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def texts(spark) -> list[tuple[int, str]]:
    return [(r.doc_id, r.text or "") for r in documents(spark).collect()]


def held(doc_id, n: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % n == 2


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, name):
    assert spark_rows(registry.QUERIES[name](spark, SMALL)) == duck_rows(SMALL, registry.ORACLES[name])


def removed(rows: list[tuple[int, str]], length: int) -> dict[int, tuple]:
    seen, out = set(), {}
    for doc, text in sorted(rows):
        b = text.encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            part = b[i : i + length]
            if part in seen:
                gone[i : i + length] = True
            seen.add(part)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k, _ in itertools.groupby(gone) if k)
        out[doc] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("most_together", [4096, 1])
def test_suffix_dedup(spark, most_together):
    rows = texts(spark)
    got = suffix_dedup.suffix_dedup(documents(spark), most_together=most_together).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == removed(rows, 100)


def test_suffix_dedup_overlaps(spark):
    rows = [(1, "ab" * 200), (2, "c" * 99), (3, "c" * 250), (4, "ab" * 60 + "z"), (5, "q" + "ab" * 60)]
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == removed(rows, 100)


def test_quality_net(spark):
    quality = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = registry.QUERIES["op3_quality_net"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == held(r.doc_id, 4) for r in got)
    out = [(r.score, quality[r.doc_id]) for r in got if r.held_out and quality.get(r.doc_id) is not None]
    good, bad = [s for s, q in out if q == 1], [s for s, q in out if q == 0]
    assert good and bad
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.85


def test_quality_net_samples_ids(spark):
    """A repeated id is one training row, however often it occurs, and ids without a document take no place."""
    ids = [i for i in range(1, 60) if not held(i, 4)]
    docs = spark.createDataFrame([(ids[0], f"text {k % 3}") for k in range(500)] + [(i, f"text of {i}") for i in ids[1:]], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids + [i + 1000 for i in range(400)]], "doc_id long, quality int")
    got = quality_net.training_rows(docs, labels, 40).collect()
    assert len(got) == len({r.doc_id for r in got}) == 40 and {r.doc_id for r in got} <= set(ids)
    every = quality_net.training_rows(docs, labels, 4000).collect()
    assert {r.doc_id: r.text for r in every} == {ids[0]: "text 0"} | {i: f"text of {i}" for i in ids[1:]}


def test_quality_net_reads_whole_texts(spark):
    """A passage teaches the network wherever it lies in a long text."""
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 25)], "doc_id long, quality int")
    rng = np.random.default_rng(4)
    texts = ["".join(map(chr, rng.integers(97, 110, 4000).tolist())) for _ in range(24)]

    def model(start: int):
        rows = [(i, t[:start] + ("ZQ" if i % 2 else "yx") * 100 + t[start + 200 :]) for i, t in enumerate(texts, 1)]
        return quality_net.fitted(spark.createDataFrame(rows, "doc_id long, text string"), labels)

    # the same texts but for a passage between two of six evenly spread chunks
    a, b = model(300), model(500)
    assert any(not np.allclose(a[k], b[k]) for k in a)


def test_lattice_sums_all_segmentations():
    pieces = [(b"a", False), (b"b", False), (b"ab", False), (b"ba", False), (b"a", True), (b"b", True), (b"ab", True), (b"aba", True)]
    scores = np.log(np.linspace(0.05, 0.2, len(pieces)))
    lattice = lattice_lm.Lattice(pieces, scores)
    by = {p: math.exp(s) for p, s in zip(pieces, scores)}
    for n in range(1, 7):
        for w in itertools.product(b"ab", repeat=n):
            word, total = bytes(w), 0.0
            for cuts in itertools.product([False, True], repeat=n - 1):
                at = [0, *[i + 1 for i, c in enumerate(cuts) if c], n]
                total += math.prod(by.get((word[i:j], j == n), 0.0) for i, j in zip(at[:-1], at[1:]))
            assert lattice.log_probability([word])[0] == pytest.approx(math.log(total))
            assert lattice.long_word(word) == pytest.approx(math.log(total))


def test_lattice_expects_pieces_of_long_words(spark):
    """Words of any length teach the pieces they hold: the linear way agrees with the one for short words, also in training."""
    pieces = [*[(bytes([b]), end) for end in (False, True) for b in range(256)], (b"ab", False), (b"ba", True), (b"abcab", False), (b"ab" * 12, False), (b"cab" * 9, True)]
    lattice = lattice_lm.Lattice(pieces, np.log(1 / (np.arange(len(pieces)) + 2.7)))
    for word in (b"a", b"abcab" * 9, b"ab" * 20 + b"cab" * 9, b"abcabx\xffba" * 7):
        want = lattice.expected(np.frombuffer(word, np.uint8)[None], np.array([3.0]))
        assert lattice.long_expected(word, 3.0) == pytest.approx(want, abs=1e-9)
        assert lattice.long_word(word) == pytest.approx(lattice.forward(np.frombuffer(word, np.uint8)[None])[-1, 0])
    words = spark.createDataFrame([(b"abcab" * 40 + b"ba", 1, 1)], "word binary, n long, c long")
    p = np.exp(lattice_lm.piece_scores(words, pieces, 1))
    of = {x: p[i] for i, x in enumerate(pieces)}
    assert of[b"abcab", False] > 5 * of[b"z", False] and of[b"ba", True] > 5 * of[b"b", True]


def test_lattice_keeps_long_pieces(tmp_path):
    (tmp_path / "v.json").write_text('{"model": {"vocab": {"artificialintelligence</w>": 0, "abc": 1}}}')
    assert (b"artificialintelligence", True) in lattice_lm.byte_pieces(str(tmp_path / "v.json"))


def test_lattice_base(spark):
    rows = texts(spark)
    tokens = {d: [*WORDS.findall(t.translate(A_Z)), None] for d, t in rows}
    count = Counter(t for d, _ in rows if not held(d, 7) for t in tokens[d])
    n, v = sum(count.values()), len(count)
    for r in registry.QUERIES["op4_lattice_lm"](spark, SMALL).collect():
        want = sum(math.log10((count[t] + 1) / (n + v + 1)) for t in tokens[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id, 7), len(tokens[r.doc_id]), sum(count[t] > 0 for t in tokens[r.doc_id]), n)
        assert r.base_score == pytest.approx(want, rel=1e-9) and r.score < 0


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = registry.QUERIES["op5_best_fit_packing"](spark, SMALL).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for d, text in texts(spark):
        ids = np.array([*t.encode(text, add_special_tokens=False).ids, 0], "<u4")
        want = [(k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by[d]) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for x in sequences.values():
        ends = list(itertools.accumulate((n for _, n in sorted(x)), initial=0))
        assert [o for o, _ in sorted(x)] == ends[:-1] and ends[-1] <= 2048
    assert len(sequences) <= math.ceil(sum(r.length for r in got) / 2048) * 1.05 + 1


def test_sum_of_squares_choice():
    """Each choice gives the smallest sum of squares, by trying every gap."""
    sizes = np.random.default_rng(1).integers(1, 12, 300)
    bins, offsets = packing.sum_of_squares(sizes, 12)
    fill: dict[int, int] = {}
    for s, b, o in zip(sizes.tolist(), bins.tolist(), offsets.tolist()):
        gaps = Counter(12 - x for x in fill.values() if x < 12)

        def after(gap, s=s, gaps=gaps):
            g = gaps.copy()
            if gap < 12 or g[12]:
                g[gap] -= gap in gaps
            if gap - s:
                g[gap - s] += 1
            return sum(n * n for n in g.values())

        choices = {g: after(g) for g in [*[g for g in gaps if g >= s], 12]}
        gap = 12 - fill.get(b, 0)
        assert fill.get(b, 0) == o and choices[gap] == min(choices.values())
        fill[b] = o + s


@pytest.mark.parametrize("part", [4096, 3])
def test_jaccard(spark, monkeypatch, part):
    """Against all pairs, with lists whole and with nearly all of them split."""
    monkeypatch.setattr(jaccard_join, "LIST_PART", part)
    rows = texts(spark)
    near = spark.createDataFrame([(10_000 + i, " ".join(w if (k + i) % 40 else f"new{i}" for k, w in enumerate(f"w{j}" for j in range(400)))) for i in range(12)], "doc_id long, text string")
    docs = documents(spark).select("doc_id", "text").unionAll(near)
    sets = {}
    for d, t in [*rows, *[tuple(r) for r in near.collect()]]:
        w = WORDS.findall(t.translate(A_Z))
        sets[d] = {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()
    low = {d: d for d in sets}
    changed = True
    links = [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    assert links
    while changed:
        changed = False
        for a, b in links:
            m = min(low[a], low[b])
            changed |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_groups(docs).collect()} == {d: (len(s), low[d]) for d, s in sets.items()}


def test_jaccard_bitmaps(spark):
    """Pairs over the threshold stay, whatever the sign of the words in which their bitmaps differ."""
    rng = np.random.default_rng(2)
    bits = rng.integers(-(2**63), 2**63, (400, jaccard_join.BITMAP_WORDS))
    bits[1::2] = bits[::2]
    bits[1::2, 0] ^= np.int64(-(2**63)) | np.int64(1) << rng.integers(0, 60, 200)  # two shingles differ, one of them by the top bit
    rows = [(i // 2, 100, i, 0, i, 0, True, bits[i].tolist()) for i in range(400)]
    entries = spark.createDataFrame(rows, "token long, n long, cid long, pos long, component long, side int, lower boolean, bits array<bigint>").coalesce(1)
    entries = entries.sortWithinPartitions("token", "n", "cid")
    for ask in (jaccard_join.open_pairs, jaccard_join.first_open):
        assert sorted(map(tuple, ask(entries, 85).collect())) == [(i, i + 1) for i in range(0, 400, 2)]


def test_near_vectors(spark):
    e =spark.read.parquet(f"{SMALL}/embeddings.parquet")
    rng = np.random.default_rng(5)
    base = [np.array(r.embedding, float) for r in e.orderBy("vec_id").limit(60).collect()]
    more = [(100_000 + 10 * i + k, (v + rng.normal(0, 0.03, len(v))).astype(np.float32).tolist()) for i, v in enumerate(base) for k in range(3)]
    df = e.select("vec_id", "embedding").unionAll(spark.createDataFrame(more, "vec_id long, embedding array<float>"))
    rows = df.collect()
    x = np.array([r.embedding for r in rows], float)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    want = dict(zip([r.vec_id for r in rows], (x @ x.T >= 0.9).sum(1) - 1))
    got = {r.vec_id: r for r in near_vectors.near_vectors(df).collect()}
    assert all(got[v].n_links <= n for v, n in want.items())
    assert sum(r.n_links for r in got.values()) >= 0.9 * sum(want.values()) > 0
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_near_vectors_odd(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, []), (8, [1.0, 0.0, 0.0])]
    got = near_vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 2, 1), (2, 2, 1), (2, 2, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 0, 8)]


OPERATORS = {
    "suffix_dedup": suffix_dedup.suffix_dedup, "quality_rules": quality_rules.quality_rules, "lattice": lattice_lm.lattice_scores, "packing": packing.best_fit_pack,
    "jaccard": jaccard_join.jaccard_groups, "lines": line_dedup.line_dedup, "mix": mixing.mix, "licenses": license_scan.license_scan,
    "quality_net": lambda d: quality_net.quality_scores(d, quality_net.empty_model()),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows(spark, name):
    """Nulls anywhere, empty and long texts, repeated rows and extra columns of any name: a result for each row."""
    clash = {c: f"array({i})" for i, c in enumerate(("copy", "n", "bits", "kd", "rid", "h1", "k1", "net_score", "n_removed", "held_out", "piece", "mix_rate", "cid", "w"))}
    df = spark.createDataFrame(ODD, SCHEMA).selectExpr("*", *[f"{v} AS {k}" for k, v in clash.items()])
    rows = OPERATORS[name](df).collect()
    if name == "mix":
        assert {r.doc_id for r in rows} <= {r[0] for r in ODD}
    elif name == "packing":
        assert {r.doc_id for r in rows} == {r[0] for r in ODD}
    else:
        assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in ODD)
    assert OPERATORS[name](df.limit(0)).collect() == []


def test_pipeline(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "line_dedup", "ngram_jaccard_join", "source_mixing", "best_fit_packing"]
    docs = documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, docs, SMALL)
        assert new.columns == documents(spark).columns, name
        docs = spark.createDataFrame(new.collect(), new.schema)
    assert corpus_pipeline.run(spark, SMALL).count() > 0


def test_pipeline_brute_force(spark, tmp_path):
    """run() against brute force: good documents of one source, among them pairs of a similarity between 0.80 and 0.85."""
    base = {i: [f"w{i}x{j}" for j in range(60)] for i in range(40)}
    rows = {i: w for i, w in base.items()}
    for i in range(40):  # a longer copy, one with a changed block, and one that stays below the threshold
        rows[100 + i] = base[i] + [f"more{i}x{j}" for j in range((10, 12, 13)[i % 3])]
        rows[200 + i] = base[i][:25] + [f"new{i}x{j}" for j in range(2 + i % 2)] + base[i][27 + i % 2 :]
        rows[300 + i] = base[i] + [f"far{i}x{j}" for j in range(20)]
    text = {i: " ".join(w) for i, w in rows.items()}
    spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in text.items()], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in text], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, w in rows.items()}
    share = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert sum(0.8 <= share(a, b) < 0.85 for a, b in itertools.combinations(rows, 2)) >= 40
    low = {i: i for i in rows}
    for a, b in sorted((a, b) for a, b in itertools.combinations(sorted(rows), 2) if share(a, b) >= 0.8) * 3:
        low[a] = low[b] = min(low[a], low[b])

    def copies(i: int) -> int:
        u = int(hashlib.md5(f"{i}:{hashlib.md5(text[i].encode()).hexdigest()}:1:1:20".encode()).hexdigest()[:12], 16) / 2**48
        return sum(sum(math.exp(-1) / math.factorial(k) for k in range(n + 1)) <= u for n in range(30))

    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in got) == +Counter({i: copies(i) for i in rows if low[i] == i})
