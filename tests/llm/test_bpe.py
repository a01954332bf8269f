"""Byte-pair encoding and decoding against the library that the tokenizer file belongs to."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from framequarry.llm import bpe, memory

public_tokenizers = pytest.importorskip("public_tokenizers")
SMALL = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(bpe.TOKENIZER)


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def encoded(ranks, texts: list[str]) -> list[list[int]]:
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(t) for t in raw])])
    return [np.frombuffer(x, "<u4").tolist() for x in ranks.encoded(np.frombuffer(b"".join(raw), np.uint8), off)]


def test_query_against_library(spark):
    """Digests of all documents."""
    lib, want = library(), {}
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), lib.decode(ids, skip_special_tokens=False))]
        want[r.doc_id] = (len(ids), *sha)
    got = bpe.op11_bpe(spark, SMALL)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == want


def test_odd_texts():
    """Letters whose lower case or normal form is special, marks without a letter, all kinds of white space, special tokens."""
    rng, lib, ranks = random.Random(5), library(), bpe.Ranks(PATH)
    letters = "aA bé́  Σσςß İK'stredmlv09!.,<|>|endoftext\n\t\U0001f600中İKẞ\x1c\x85\xa0​ ﬁǅ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    texts += ["<|endoftext|>a", "x<|startoftext|><|endoftext|>'s", "<|endoftext", "́abc <|endoftext|>́", "", " \n ", "a" * 3000, "é" * 700 + " " + "ab" * 2000]
    known = [chr(c) for c in range(0x21, 0x2FA20) if not 0xD800 <= c < 0xE000]
    texts += ["a".join(known[k : k + 90]) for k in range(0, len(known), 90)]
    assert encoded(ranks, texts) == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_heap_and_matrix_agree():
    rng, ranks = random.Random(6), bpe.Ranks(PATH)
    for n in (1, 2, 3, 17, bpe.SHORT):
        pieces = list({bytes(rng.choice(b"aeinorst") for _ in range(n)) for _ in range(200)})
        assert ranks.short(pieces) == [ranks.long(p) for p in pieces]


def test_memory_turns_over():
    m, made = memory.Memory(8_000), []

    def make(keys):
        made.extend(keys)
        return [k * 2 for k in keys]

    for i in range(0, 400, 10):
        keys = {b"%d" % (i + k) for k in range(10)} | {b"stays"}
        got = m.known(keys, make)
        assert all(got[k] == k * 2 for k in keys) and len(m.now) + len(m.before) < 60
    assert made.count(b"stays") == 1 and len(made) == 401


def test_frames(spark):
    """Nulls, repeats, clashing names, ids that no vocabulary has, an empty table."""
    schema = "doc_id long, ids string, text string, `a.b` map<string,int>"
    rows = [(1, "x", "Some text", {"k": 1}), (1, "x", "Some text", {"k": 1}), (None, None, None, None), (2, None, "", None), (3, "y", "<|endoftext|>", None)]
    docs = spark.createDataFrame(rows, schema)
    lib = library()
    coded = bpe.bpe_encode(docs)
    assert sorted(coded.columns) == sorted(docs.columns)
    both = bpe.bpe_decode(coded, text="doc text").collect()
    assert sorted((r.doc_id or 0, r.ids, r["doc text"]) for r in both) == sorted(
        (i or 0, e.ids, lib.decode(e.ids, skip_special_tokens=False)) for i, _, t, _ in rows for e in [lib.encode(t or "", add_special_tokens=False)])
    assert [r["a.b"] for r in both if r.doc_id == 1] == [{"k": 1}] * 2
    own = bpe.bpe_encode(docs, ids="numbers", keep=["doc_id", "ids"])
    assert own.columns == ["doc_id", "ids", "numbers"]
    unknown = spark.createDataFrame([(1, [320, None, 10**6, -1, 49407]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert sorted(tuple(r) for r in bpe.bpe_decode(unknown, keep=["doc_id"]).collect()) == [(1, lib.decode([320, 49407], skip_special_tokens=False)), (2, ""), (3, "")]
    assert bpe.bpe_encode(docs.limit(0)).count() == 0 and bpe.bpe_decode(unknown.limit(0)).count() == 0
