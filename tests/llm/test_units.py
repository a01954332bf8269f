"""Units of texts against the tokenizer on whole texts: every plain character, odd words, cuts anywhere; nothing is asked twice."""

import random

import numpy as np
import pytest

from framequarry.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path(packing.TOKENIZER)


def encoded(texts: list[str]) -> list[bytes]:
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(t) for t in raw])]).astype(np.int64)
    return packing.encoded(np.frombuffer(b"".join(raw), np.uint8), off, PATH)


def plain(texts: list[str]) -> list[bytes]:
    from tokenizers import Tokenizer

    return [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(PATH).encode_batch_fast(texts, add_special_tokens=False)]


@pytest.fixture(autouse=True)
def new_worker(monkeypatch):
    monkeypatch.setattr(packing, "_loaded", {})


def test_every_character_in_context():
    some = [*range(1, 0x600), 0x1E9E, 0x2009, 0x2019, 0x212A, 0x3000, 0x4E2D, 0xAC00, 0xFB01, 0x1F600]
    texts = [f"{c} a{c}b A{c}1 {c}{c} .{c}. '{c} x'{c} é{c}́ <{c} {c}|" for c in map(chr, some)]
    assert encoded(texts) == plain(texts)


def test_random_words_and_text_ends(monkeypatch):
    monkeypatch.setattr(packing, "MAX_CACHE_BYTES", 20_000)
    parts = ["a", "Re", "Éa", "ß", "'s", "'S", "'ll", "''", "'", "1", "²", "½", ".", "!!", "¿", "«", "_", "\0", "\x1f", "\x85", "\xa0", "é", "́", "İ", "ſ", "Я", "ΣΣ", "中", "😀", "<|endoftext|>", "<|", "<|EndOfText|>", " ", "  ", "\n", "\t"]
    for size in (7, 60, 1 << 20):
        monkeypatch.setattr(packing, "SPLIT_BYTES", size)
        r = random.Random(size)
        texts = ["".join(r.choices(parts, k=r.randrange(0, 40))) for _ in range(400)] + ["", " ", "x" * 500, "中" * 200]
        assert encoded(texts) == plain(texts)
    assert encoded([]) == [] and encoded(["", ""]) == [b"", b""]


def test_the_tokenizer_is_asked_once_for_a_piece(monkeypatch):
    """Words that differ in case and marks only, met in several batches, are no new work for the tokenizer."""
    import tokenizers

    asked = []

    class Counting:
        def __init__(self, path):
            self.own = real.from_file(path)

        from_file = classmethod(lambda cls, path: cls(path))

        def encode_batch_fast(self, texts, **how):
            asked.extend(texts)
            return self.own.encode_batch_fast(texts, **how)

        def __getattr__(self, name):
            return getattr(self.own, name)

    real = tokenizers.Tokenizer
    stems = ["".join(random.Random(i).choices("abdeinorstuéü", k=9)) for i in range(300)]
    shapes = ["{}", "{},", "{}...", "({})", "{}!!", "«{}»", "{}***", "1{}2"]
    batches = [[" ".join(s.format(w.title() if i % 2 else w) for w in stems)] for i, s in enumerate(shapes * 2 + shapes[1:])]
    want = [plain(b) for b in batches]
    monkeypatch.setattr(tokenizers, "Tokenizer", Counting)
    assert [encoded(b) for b in batches] == want
    assert sum(map(len, asked)) < 1.2 * sum(len(w) + 1 for w in stems)
