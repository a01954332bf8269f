"""Word shingles of many texts at a time, as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np

from .arrowtext import is_space, lowered

BASE = np.uint64(0xD6E8FEB86659FD93)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
BYTE = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACE = np.random.default_rng(12).integers(1, 2**63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {"base": np.ones(1, np.uint64), "inverse": np.ones(1, np.uint64)}


def powers(kind: str, n: int) -> np.ndarray:
    """n powers of the base or its inverse modulo 2**64."""
    if len(_powers[kind]) < n:
        p = np.full(max(n, 1 << 20), BASE if kind == "base" else INVERSE, np.uint64)
        p[0] = 1
        _powers[kind] = np.cumprod(p, dtype=np.uint64)
    return _powers[kind][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers spread over all places, one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in turn, offsets of each text's words); words lie between ASCII white space, A-Z in lower case."""
    n = len(raw)
    if n == 0:
        return np.empty(0, np.uint64), np.zeros(len(off), np.int64)
    b = lowered(raw)
    inside = ~is_space(b)
    first = np.zeros(n + 1, bool)
    first[off] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | first[1:n]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | first[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    c = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE[b] * powers("base", n), out=c[1:])
    h = mixed((c[e] - c[s]) * powers("inverse", n)[s] + (e - s).astype(np.uint64))
    return h, np.searchsorted(s, off)


def shingle_sets(raw: np.ndarray, off: np.ndarray, k: int = 4) -> list[np.ndarray]:
    """Sorted distinct k-word shingles of each text; with fewer words the whole sequence as one, without words none."""
    h, at = word_hashes(raw, off)
    g = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k if len(g) else 0):
        g += h[j : len(h) - k + 1 + j] * PLACE[j]
    g = mixed(g)
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        if b - a >= k:
            x = np.sort(g[a : b - k + 1])
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        elif b > a:
            w = h[a:b] * PLACE[: b - a] + np.uint64(b - a)
            out.append(mixed(np.array([w.sum(dtype=np.uint64)])))
        else:
            out.append(np.empty(0, np.uint64))
    return out
