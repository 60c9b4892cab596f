"""Word shingles of many texts at once, as 64-bit hashes, and SuperMinHash signatures of the sets (Ertl, 2017).

Words are runs of anything but blanks, with A-Z in lower case. A text's set has its distinct runs of ``k`` words; a text of fewer
words has its whole sequence as one; a text without words has none.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
GOLD = U(0x9E3779B97F4A7C15)
BASE = 0x2545F4914F6CDD1D
INVERSE = pow(BASE, -1, 1 << 64)
EMPTY = U(2**64 - 1)

_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]
#: Powers that a worker keeps; those of a longer text are computed for it and dropped.
KEPT_POWERS = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits depend on all input bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: A random word for each byte; capitals have that of their lower case.
BYTES = mix((np.arange(256, dtype=U) + U(1)) * GOLD)
BYTES[65:91] = BYTES[97:123]
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse, modulo 2^64."""
    def table(base, size):
        p = np.full(size, base, U)
        p[0] = 1
        return np.multiply.accumulate(p)

    if n > KEPT_POWERS:
        return table(BASE, n), table(INVERSE, n)
    if len(_powers[0]) < n:
        _powers[:] = [table(base, max(n, 1 << 16)) for base in (BASE, INVERSE)]
    return _powers[0][:n], _powers[1][:n]


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    flat = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    blank = BLANK[flat]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    up, down = powers(len(flat))
    total = np.concatenate([[U(0)], np.cumsum(BYTES[flat] * up)])
    word = mix((total[end] - total[start]) * down[start] + (end - start).astype(U) * GOLD)
    of = np.searchsorted(ends, start, side="right")
    count = np.bincount(of, minlength=len(texts))
    last = np.cumsum(count)
    run = chain([word[i:len(word) - k + 1 + i] for i in range(k)]) if len(word) >= k else np.zeros(0, U)
    out = []
    for n, b in zip(count.tolist(), last.tolist()):
        if n >= k:
            out.append(np.unique(run[b - n:b - k + 1]))
        else:
            out.append(chain([word[i:i + 1] for i in range(b - n, b)]) if n else np.zeros(0, U))
    return out


def chain(words: list[np.ndarray]) -> np.ndarray:
    """Hash of words in a row; its length is part of it."""
    h = np.full(len(words[0]), len(words), U)
    for w in words:
        h = mix(h * GOLD + w)
    return h


def super_minhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """One signature of ``m`` values per set (all EMPTY for an empty set).

    Each element deals the values r_j + j (r_j uniform, j = 0, 1, ...) to the places of a permutation of its own, and a place
    keeps the smallest it gets. The permutations grow by one place per round, for all elements at once. Rounds go up, so a set
    is finished as soon as every place has a value: that is the early stop. A value holds j in its high and r_j in its low half.
    """
    sig = np.full((len(sets), m), EMPTY)
    if not sets:
        return sig
    flat = sig.reshape(-1)
    h, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    swapped: list[np.ndarray] = []  # the place that round i changed with place i, per element
    table = None  # the permutations themselves, once few elements are left
    for j in range(m):
        if not len(h):
            break
        z = mix(h + U((j + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        k = j + (((z & U(0xFFFFFFFF)) * U(m - j)) >> U(32)).astype(np.int64)
        if table is None:
            place = k.copy()
            for i in range(j - 1, -1, -1):
                place[place == swapped[i]] = i
            swapped.append(k)
        else:
            each = np.arange(len(h))
            place = table[each, k].astype(np.int64)
            table[each, k] = table[:, j]
        np.minimum.at(flat, of * m + place, U(j << 32) | (z >> U(32)))
        open_ = np.zeros(len(sets), bool)
        left = np.unique(of)
        open_[left] = (sig[left] == EMPTY).any(axis=1)
        go = open_[of]
        if not go.all():
            h, of, swapped = h[go], of[go], [s[go] for s in swapped]
            table = table[go] if table is not None else None
        if table is None and j >= 11 and len(h):
            table = np.tile(np.arange(m, dtype=np.uint16), (len(h), 1))
            each = np.arange(len(h))
            for i, s in enumerate(swapped):
                table[each, s], table[each, i] = table[each, i].copy(), table[each, s].copy()
            swapped = []
    return sig


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    """Hash of each band of ``rows`` values, as signed 64-bit integers; the band's number is part of it."""
    n, m = sig.shape
    bands = sig.reshape(n, m // rows, rows)
    h = np.tile(np.arange(m // rows, dtype=U), (n, 1))
    for i in range(rows):
        h = mix(h * GOLD + bands[:, :, i])
    return h.view(np.int64)
