"""Texts as units that `word_bpe_49k.json` encodes one by one, found by arrays over whole blocks of text.

The tokenizer takes a normal form, lower case, and pieces that are a run of letters, one digit or a run of other marks;
no piece holds white space. In words of plain characters (`PLAIN`) all of that is told by each character alone, so that
their units are these pieces in lower case. Any other word, one with a contraction ('s) or with what may be a special
token, is a unit as it stands. The ids of a text are those of its units in turn; a worker asks the tokenizer for units
only that it doesn't remember.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterable
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

SPACE, LETTER, DIGIT, MARK, ODD = range(5)
#: Characters of two bytes up to this one (Latin, Greek, Cyrillic) may be plain: their class, normal form and lower case are told one by one.
PLAIN = 0x52F
#: Plain units that the tokenizer gets as one text.
JOINED = 100
#: Bytes that a remembered unit takes besides its own and its ids.
UNIT_COST = 180
#: How a piece's last token ends in the vocabulary; no other token does.
PIECE_END = "</w>"


def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class and lower case by byte, and by both bytes of characters of two."""
    kind, low = np.full(256, ODD, np.uint8), np.arange(256, dtype=np.uint8)
    for b in range(0x21, 0x7F):
        kind[b] = LETTER if chr(b).isalpha() else DIGIT if chr(b).isdigit() else MARK
        low[b] = ord(chr(b).lower())
    kind[[0x20, *range(0x09, 0x0E)]] = SPACE
    kind2, low2 = np.full(1 << 16, ODD, np.uint8), np.arange(1 << 16, dtype=np.uint16)
    for c in map(chr, range(0x80, PLAIN + 1)):
        of, small = {"L": LETTER, "N": DIGIT, "P": MARK, "S": MARK}.get(unicodedata.category(c)[0], ODD), c.lower()
        if of != ODD and len(small.encode()) == 2 and all(unicodedata.is_normalized("NFC", x) for x in (c, small)):
            code = int.from_bytes(c.encode(), "big")
            kind2[code], low2[code] = of, int.from_bytes(small.encode(), "big")
    return kind, low, kind2, low2


KIND, LOW, KIND2, LOW2 = tables()
#: Bytes that make a contraction behind an apostrophe.
CONTRACTS = np.isin(np.arange(256), list(b"strvmldSTRVMLD"))


def cut(raw: np.ndarray, first: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(units, place of each in `raw`, numbers of those that are no plain piece); texts begin at the places `first`."""
    n, first = len(raw), first[first < len(raw)]
    kind, low = KIND[raw], LOW[raw]
    a, b = raw[:-1], raw[1:]
    lead = np.flatnonzero((a >= 0xC2) & (a <= 0xD4) & (b >> 6 == 2))
    both = raw[lead].astype(np.uint16) << 8 | raw[lead + 1]
    kind[lead] = kind[lead + 1] = KIND2[both]
    low[lead], low[lead + 1] = LOW2[both] >> 8, LOW2[both] & 255
    solid = kind != SPACE
    start = np.ones(n, bool)
    start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    start[lead + 1] = False
    start[first] = True
    start &= solid
    odd = kind == ODD
    odd[:-1] |= (a == 0x27) & CONTRACTS[b] | (a == 0x3C) & (b == 0x7C)
    odd, whole = np.flatnonzero(odd), np.empty(0, np.int64)
    if len(odd):
        word = solid.copy()
        word[1:] &= ~solid[:-1]
        word[first] = solid[first]
        begin = np.flatnonzero(word)
        which = np.unique(np.searchsorted(begin, odd, "right") - 1)
        whole, step = begin[which], np.zeros(n + 1, np.int8)
        step[whole] = 1
        step[np.append(begin[1:], n)[which]] -= 1
        inside = np.cumsum(step[:-1], dtype=np.int8) > 0
        start &= ~inside
        start[whole] = True
        low = np.where(inside, raw, low)
    place = np.flatnonzero(start)
    ends = np.append(np.flatnonzero(start[solid]), np.count_nonzero(solid)).astype(np.int32)
    units = pa.Array.from_buffers(pa.binary(), len(place), [None, pa.py_buffer(ends), pa.py_buffer(low[solid])])
    return units, place, np.searchsorted(place, whole)


def spans(values: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """`count` values from each `start` on, in turn."""
    ends = np.cumsum(count)
    return values[np.repeat(start - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)]


class Known:
    """Units by number, and their ids as one array."""

    def __init__(self):
        self.number, self.ids, self.ends, self.size = {}, np.empty(0, "<u4"), np.zeros(1, np.int64), 0

    def find(self, units: np.ndarray) -> np.ndarray:
        """Number of each unit here, or -1."""
        return np.fromiter(map(self.number.get, units, repeat(-1)), np.int64, len(units))

    def of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each) of the units of these numbers in turn."""
        count = self.ends[at + 1] - self.ends[at]
        return spans(self.ids, self.ends[at], count), count

    def add(self, units: np.ndarray, ids: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Numbers of the units added."""
        at = np.arange(len(self.number), len(self.number) + len(units))
        self.number.update(zip(units, at.tolist()))
        self.ids, self.ends = np.concatenate([self.ids, ids]), np.concatenate([self.ends, self.ends[-1] + np.cumsum(count)])
        self.size += sum(map(len, units)) + 4 * len(ids) + UNIT_COST * len(units)
        return at


class Tokens:
    """A tokenizer file: the ids of units, asked of the library itself."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.last = np.zeros(1 + max(self.tokenizer.get_vocab().values()), bool)
        self.last[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith(PIECE_END)]] = True

    def coded(self, texts: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of each) of the texts in turn."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(ids), "<u4"), np.fromiter(map(len, ids), np.int64)

    def pieces(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of units that are one piece each: many go as one text, and a piece's last token shows its end."""
        ids, _ = self.coded([b" ".join(units[i : i + JOINED]) for i in range(0, len(units), JOINED)])
        return ids, np.diff(np.flatnonzero(self.last[ids]), prepend=-1)


def ids_of(units: pa.Array, odd: np.ndarray, tokens: Tokens, now: Known, before: Known) -> tuple[np.ndarray, np.ndarray]:
    """(ids, how many of each) of the units in turn; all of them are in `now` afterwards. odd: numbers of those that are no piece."""
    coded = units.dictionary_encode()
    each, kinds = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False)
    whole = np.zeros(len(kinds), bool)
    whole[each[odd]] = True
    at = now.find(kinds)
    new = np.flatnonzero(at < 0)
    old = before.find(kinds[new])
    for some, ids in (
        (new[old >= 0], lambda _: before.of(old[old >= 0])),
        (new[(old < 0) & ~whole[new]], tokens.pieces),
        (new[(old < 0) & whole[new]], tokens.coded),
    ):
        if len(some):
            at[some] = now.add(kinds[some], *ids(kinds[some]))
    return now.of(at[each])
