"""Alignment of two tokenizers against whole texts, token by token."""

from __future__ import annotations

import hashlib
import json
import random
from collections import Counter

import pytest

from framequarry.llm import alignment
from framequarry.llm.bpe import byte_letters

public_tokenizers = pytest.importorskip("public_tokenizers")
SMALL = "/root/testdata/sf0.001"
A_PATH, B_PATH = public_tokenizers.path(alignment.A_FILE), public_tokenizers.path(alignment.B_FILE)


@pytest.fixture(scope="module")
def plainly():
    """(ids of A, of B, groups, links) of a whole text, by decoded bytes alone."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_lib, b_lib = Tokenizer.from_file(A_PATH), SentencePieceProcessor(model_file=B_PATH)
    a_lib.encode_special_tokens = True
    byte_of = {c: i for i, c in enumerate(byte_letters())}
    with open(A_PATH) as f:
        a_bytes = {i: bytes(byte_of[c] for c in t) for t, i in json.load(f)["model"]["vocab"].items()}

    def b_bytes(i: int) -> bytes:
        p = b_lib.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b_lib.is_byte(i) else p.replace("▁", " ").encode()

    def one(text):
        a, b = (a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)) if text else ([], [])
        if not text or any(b"".join(x) != (" " + text).encode() for x in (map(a_bytes.get, a), map(b_bytes, b))):
            return [], [], "", []
        ends_a, ends_b, n = {}, {}, 0
        for ends, ids, size in ((ends_a, a, a_bytes.get), (ends_b, b, b_bytes)):
            n = 0
            for k, i in enumerate(ids, 1):
                n += len(size(i))
                ends[n] = k
        groups, links, i, j = [], [], 0, 0
        for e in sorted(ends_a.keys() & ends_b.keys()):
            x, y = ends_a[e], ends_b[e]
            groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
            links.append((a[x - 1], b[y - 1]))
            i, j = x, y
        return a, b, ";".join(groups), links

    return one


def digest(plainly, rows: list[tuple]) -> list[tuple]:
    """The contract's rows."""
    found = [(i, *plainly(t or "")) for i, t in rows]
    count = Counter(x for f in found for x in f[4])
    top: dict = {}
    for (_, b), n in count.items():
        top[b] = max(n, top.get(b, 0))
    return sorted(((i, len(a), len(b), len(links), len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links),
                    hashlib.sha256(g.encode()).hexdigest() if g else "") for i, a, b, g, links in found), key=str)


def test_query(spark, plainly):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = alignment.op13_tokenizer_alignment(spark, SMALL)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == digest(plainly, rows)


@pytest.mark.parametrize("parts", [True, False])
def test_odd_texts(plainly, parts, monkeypatch):
    """White space of all kinds, letters of several bytes, byte fallback, B's own space letter, special tokens as text."""
    monkeypatch.setattr(alignment, "PARTS", 1000)
    aligner, rng = alignment.Aligner(A_PATH, B_PATH), random.Random(4)
    assert aligner.parts
    aligner.parts = parts
    letters = "aA bé́  \t\r\nσßİ'strev09!.,<|>endoftext\n\U0001f600中İẞ\x1c\x85\xa0 \x00ก　k"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["".join(rng.choice("ab \n\té中.▁") for _ in range(rng.randint(0, 20))) for _ in range(3000)]
    texts += [" ", "  ", "\n", " \n ", "a ", "a  ", "a \n", "<s>", "</s> <unk>", "<|endoftext|> x", "<0x0A>", "a" * 5000, "▁", "x ▁ y", None, ""]
    known = [chr(c) for c in range(1, 0x2FA20) if not 0xD800 <= c < 0xE000]
    texts += [" a".join(known[k : k + 60]) for k in range(0, len(known), 60 if parts else 600)]
    pairs = lambda raw: [divmod(int.from_bytes(raw[k : k + 8], "little"), 2**32) for k in range(0, len(raw), 8)]
    got = [(n_a, n_b, g.decode(), pairs(x)) for n_a, n_b, g, x in aligner.texts(texts)]
    assert got == [(len(a), len(b), g, links) for a, b, g, links in (plainly(t or "") for t in texts)]


@pytest.mark.parametrize("most", [2_000_000, 40])
def test_frames(spark, plainly, most):
    """Nulls, repeated rows and ids, clashing names, an empty table; pairs of ids broadcast and, but for the frequent ones, shuffled."""
    rng = random.Random(9)
    words = "the of a token tokens, naïve 中文 \U0001f600 2024 pre-trained\nline".split(" ")
    rows = [(k % 50, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30))), 1, "x") for k in range(120)] + [(7, "same text", 2, "y")] * 5
    rows += [(None, "no id here", 3, None), (3, None, None, None), (4, "", 1, ""), (5, "a ▁ b", 1, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, links long, row_no string")
    got = alignment.alignment_digest(docs, most=most).collect()
    assert sorted((tuple(r) for r in got), key=str) == digest(plainly, [r[:2] for r in rows])
    assert alignment.alignment_digest(docs.limit(0)).count() == 0
    one = alignment.align(docs.where("doc_id = 7 and text = 'same text'")).collect()
    assert len(one) == 5 and all((r.n_a, r.n_b, r.groups, [divmod(x, 2**32) for x in r.links]) == (len(a), len(b), g, links)
                                 for r in one for a, b, g, links in [plainly("same text")])
