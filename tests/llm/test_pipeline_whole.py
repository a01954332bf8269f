"""The pipeline's rows by plain Python: bad texts, lines of many sites, near-duplicates, sources of different sizes, placements."""

from __future__ import annotations

import random
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
sys.path.insert(0, str(Path(__file__).parent.parent.parent))

from test_brute_force import draw

import corpus_pipeline
from framequarry.llm import line_dedup, mixing

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus() -> tuple[list[tuple], set[int]]:
    """(doc_id, text, source), and the ids of bad texts."""
    rng = random.Random(12)
    words = "the river runs past an old mill where farmers bring grain and children watch boats drift under stone bridges in autumn light".split()
    rows, bad = [], set()
    shared = "Subscribe to our letter for more"
    for i in range(240):
        source = "abcdefg"[min(6, int(14 * rng.random() ** 2))]
        if i % 4 == 3:
            bad.add(i)
            rows.append((i, "\n".join("".join(rng.choice("#$%&|<>{}@*") for _ in range(40)) for _ in range(rng.randint(4, 9))), source))
            continue
        lines = [" ".join(rng.choice(words) for _ in range(12)) + "." for _ in range(rng.randint(4, 9))]
        if i % 5 == 0:
            lines.insert(rng.randint(0, 3), shared)
        if i % 8 == 2:
            lines.append("Seen on few sites only")
        rows.append((i, "\n".join(lines), source))
    texts = {i: (t, s) for i, t, s in rows}
    for i in range(0, 120, 6):  # near copies elsewhere: a changed line end, and another boilerplate line on top
        t, s = texts[i]
        rows.append((1000 + i, shared + "\n" + t + " Indeed.", "abcdefg"[i % 7]))
    rows.append((5000, " ".join(rng.choice(words) for _ in range(5000)) + ".", "a"))
    few = {s for i, t, s in rows if "few sites" in t}
    keep = sorted(few)[:4]  # below the threshold
    return [(i, t if "few sites" not in t or s in keep else t.replace("\nSeen on few sites only", ""), s) for i, t, s in rows], bad


def test_whole_pipeline(spark, tmp_path):
    from tokenizers import Tokenizer

    rows, bad = corpus()
    spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i not in bad), 0) for i, _, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = [r for r in rows if r[0] not in bad]
    # lines that enough sites show stay in the first document only
    sites, first = defaultdict(set), {}
    for i, t, s in kept:
        for k, line in enumerate(t.split("\n")):
            if line.split():
                sites[line].add(s)
                first[line] = min(first.get(line, (i, k)), (i, k))
    gone = {line for line, s in sites.items() if len(s) >= line_dedup.MIN_SITES}
    assert len(gone) == 1 and any(len(s) == 4 for s in sites.values())
    kept = [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if x not in gone or first[x] == (i, k)), s) for i, t, s in kept]
    # one of each group of near-duplicates
    sets = {i: {tuple(w[j : j + 5]) for w in [t.lower().split()] for j in range(len(w) - 4)} for i, t, _ in kept}
    low = {i: i for i in sets}
    pairs = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert len(pairs) >= 15
    for a, b in pairs * 3:
        low[a] = low[b] = min(low[a], low[b])
    kept = [r for r in kept if low[r[0]] == r[0]]
    # as often as the source's share asks for
    n = Counter(s for _, _, s in kept)
    want = Counter({i: draw(i, t, 1, len(kept) / len(n) / n[s], mixing.SEED) for i, t, s in kept})
    assert len(n) == 7 and len(set(want.values())) > 2
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = Counter()
    for i, t, _ in kept:
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = np.array(ids[k : k + 2048], "<u4")
            pieces[i, k // 2048, k, len(part), zlib.crc32(part.tobytes())] += want[i]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == +pieces
    placed = defaultdict(list)
    for r in got:
        placed[r.sequence_id].append((r.offset, r.length))
    for some in placed.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(placed) <= -(-sum(r.length for r in got) // 2048) + 2
