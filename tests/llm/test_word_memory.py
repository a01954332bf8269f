"""The ids of texts stay those of the tokenizer while a worker's memory of words turns over."""

import numpy as np
import pyarrow.parquet as pq
import pytest

from framequarry.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_turnover(monkeypatch):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.TOKENIZER)
    texts = [t or "" for t in pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()]
    monkeypatch.setattr(packing, "MAX_CACHE_BYTES", 20_000)
    monkeypatch.setattr(packing, "_loaded", {})
    plain, turns, last = Tokenizer.from_file(path), 0, None
    for i in range(0, len(texts), 5):
        some = [t.encode() for t in texts[i : i + 5]]
        off = np.concatenate([[0], np.cumsum([len(t) for t in some])])
        got = packing.encoded(np.frombuffer(b"".join(some), np.uint8), off, path)
        now = packing.word_ids(path)[1]
        turns, last = turns + (last is not None and now is not last), now
        want = [np.array(e.ids, "<u4").tobytes() for e in plain.encode_batch_fast(texts[i : i + 5], add_special_tokens=False)]
        assert got == want
    assert turns > 1
