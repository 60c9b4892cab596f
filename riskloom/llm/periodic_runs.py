"""Stretches of words that repeat with a period, by Lyndon grouping.

A run is a maximal stretch of words in which words ``q`` apart are identical, ``q`` being its smallest period, at least ``least``
words and two periods long. Its first words that form a Lyndon word of length ``q`` are its root, in one of an order of the words
and the reverse order. Phase one of suffix sorting by grouping cuts the text into blocks, one to a word at first; blocks that
are equal form a group. The groups are taken from the highest down; each block of the group taken ends there, and goes to the end of
the block before it, whose group splits by how many it got. The length at which a block is taken is the longest Lyndon word
from its first word on. Both orders give roots, and common extensions to both sides give the runs. Extensions are found by
binary search over hashes of prefixes and then compared word by word, so that a collision cannot change a result.

A run holds ``least`` / 2 words in a row that occur again in its text. Only stretches covered by windows that occur twice can
therefore hold runs; all others are left out before the grouping. What is left is grouped whole, whatever its length.

Defined results: a null, empty or blank text has no words and no runs, and collapses to an empty text. Rows that repeat an id,
or have none, are each judged for themselves. Runs of one text that overlap are all returned. Further columns are not read. An
empty table gives an empty result. A row takes memory in proportion to its text; a task holds one step of about a megabyte of text
or one longer text at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import map_batches, steps, type_of

#: Shortest run, in words.
LEAST = 12
#: Modulus and base of the prefix hashes.
PRIME, BASE = (1 << 31) - 1, 1_000_003

#: What changes a row's words before they are searched: (id, words) -> words.
Change = Callable[[object, list[bytes]], list[bytes]]


def lyndon_lengths(ranks: list[int]) -> list[int]:
    """Length of the longest Lyndon word from each place on, the end counting as lower than every word.

    The places not yet taken form a linked list; a block reaches from its place to the next one in the list. Groups form another
    list, in order. A place changes its group at most once for each block taken after it, so what follows the first sort is linear.
    """
    n, numbers = len(ranks), {r: g for g, r in enumerate(sorted(set(ranks)))}
    left, right = list(range(-1, n)), list(range(1, n + 1))
    group = [numbers[r] for r in ranks]
    members: list[list[int]] = [[] for _ in numbers]
    for place, g in enumerate(group):
        members[g].append(place)
    count = [len(m) for m in members]
    below, above = list(range(-1, len(members) - 1)), list(range(1, len(members) + 1))
    lengths, top = [0] * n, len(members) - 1

    def put_above(g: int, places: list[int]) -> None:
        new, over = len(members), above[g]
        for p in places:
            group[p] = new
        members.append(places)
        count.append(len(places))
        below.append(g)
        above.append(over)
        below[over] = above[g] = new
        count[g] -= len(places)

    above[top:] = [top]  # never looked at, the highest group is the one taken
    while top >= 0:
        got: dict[int, int] = {}
        for place in members[top]:  # left to right: equal blocks before this one are taken already
            if group[place] == top:  # else it has moved
                before, after = left[place], right[place]
                lengths[place] = after - place
                left[after] = before
                if before >= 0:
                    right[before] = after
                    got[before] = got.get(before, 0) + 1
        if len(got) == 1:
            place, = got
            if count[group[place]] > 1:
                put_above(group[place], [place])
        elif got:
            parts: dict[tuple[int, int], list[int]] = {}
            for place, times in got.items():
                parts.setdefault((group[place], times), []).append(place)
            for g, times in sorted(parts, reverse=True):  # of one group, those that got most go highest
                if count[g] > len(parts[g, times]):
                    put_above(g, parts[g, times])
        top = below[top]
    return lengths


def stretches(words: list[list[bytes]], least: int) -> list[tuple[int, int, int]]:
    """(text, from, to) of what windows of ``least`` / 2 words that occur twice in their text cover, ``least`` words long at least."""
    sizes = np.array([len(w) for w in words], np.int64)
    n, width = int(sizes.sum()), -(-least // 2)
    if n <= width:
        return []
    codes = np.fromiter((h for w in words for h in map(hash, w)), np.int64, n).view(np.uint64)
    text = np.repeat(np.arange(len(words)), sizes)
    key = text[:n - width + 1].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(width):
        key += codes[k:n - width + 1 + k] * np.uint64(pow(0xD1342543DE82EF95, k + 1, 1 << 64))
    key[text[:n - width + 1] != text[width - 1:]] = 0
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    twice &= text[:n - width + 1] == text[width - 1:]
    at = np.flatnonzero(twice)
    if not len(at):
        return []
    new = (at[1:] > at[:-1] + width) | (text[at[1:]] != text[at[:-1]])
    first, last = at[np.r_[True, new]], at[np.r_[new, True]] + width
    base = np.cumsum(sizes) - sizes
    return [(int(t), int(a), int(b)) for t, a, b in zip(text[first], first - base[text[first]], last - base[text[first]]) if b - a >= least]


class Extensions:
    """Longest common extensions inside stretches of one sequence: binary search over hashes of prefixes."""

    def __init__(self, codes: np.ndarray):
        n, power = len(codes), np.ones(1, np.int64)
        while len(power) < n + 1:
            power = np.r_[power, power * pow(BASE, len(power), PRIME) % PRIME]
        self.codes, self.power = codes, power[:n + 1]
        self.sums = np.r_[0, np.cumsum((codes + 1) * power[:n] % PRIME) % PRIME]

    def same(self, x: np.ndarray, q: np.ndarray, length: np.ndarray) -> np.ndarray:
        s = self.sums
        return (s[x + length] - s[x]) % PRIME * self.power[q] % PRIME == (s[x + q + length] - s[x + q]) % PRIME

    def right(self, x: np.ndarray, q: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words from ``x`` on equal those from ``x + q`` on."""
        low, high = np.zeros_like(x), most.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            ok = self.same(x, q, middle)
            low, high = np.where(ok, middle, low), np.where(ok, high, middle - 1)
        return low

    def left(self, x: np.ndarray, q: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words before ``x`` equal those before ``x + q``."""
        low, high = np.zeros_like(x), most.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            ok = self.same(x - middle, q, middle)
            low, high = np.where(ok, middle, low), np.where(ok, high, middle - 1)
        return low

    def by_word(self, x: int, q: int, first: int, end: int) -> tuple[int, int]:
        """From and to of the stretch of period ``q`` around ``x``, word by word."""
        differ = np.flatnonzero(self.codes[first:end - q] != self.codes[first + q:end]) + first
        k = int(np.searchsorted(differ, x))
        return (int(differ[k - 1]) + 1 if k else first), (int(differ[k]) + q if k < len(differ) else end)


def runs_of(parts: list[list[int]], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """All runs (start, length, period) of each sequence of numbers, by start, then period."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in parts]
    if not parts:
        return found
    sizes = np.array([len(p) for p in parts], np.int64)
    ends = np.cumsum(sizes)
    codes = np.fromiter((c for p in parts for c in p), np.int64, int(ends[-1]))
    part = np.repeat(np.arange(len(parts)), sizes)
    first, end = (ends - sizes)[part], ends[part]
    places = np.arange(len(codes))
    pairs = []
    for sign in (1, -1):
        length = np.fromiter((x for p in parts for x in lyndon_lengths([sign * c for c in p])), np.int64, len(codes))
        ok = 2 * length <= end - first
        after, before = places + length, places - 1
        ok &= ((after < end) & (codes[np.minimum(after, len(codes) - 1)] == codes)) | ((before >= first) & (codes[before] == codes[after - 1]))
        pairs.append(np.stack([places[ok], length[ok]], 1))
    x, q = np.unique(np.concatenate(pairs), axis=0).T
    if not len(x):
        return found
    ext = Extensions(codes)
    r, left = ext.right(x, q, end[x] - x - q), ext.left(x, q, x - first[x])
    ok = (r + left >= q) & (r + left + q >= least)
    x, q, start, stop = x[ok], q[ok], (x - left)[ok], (x + q + r)[ok]
    for s, e, period in np.unique(np.stack([start, stop, q], 1), axis=0).tolist():
        k, low, high = int(part[s]), int(first[s]), int(end[s])
        if np.array_equal(codes[s:e - period], codes[s + period:e]):
            found[k].append((s - low, e - s, period))
            continue
        for at in x[(start == s) & (stop == e) & (q == period)].tolist():  # hashes collided
            a, b = ext.by_word(at, period, low, high)
            if b - a >= max(least, 2 * period):
                found[k].append((a - low, b - a, period))
    return [sorted(set(f), key=lambda t: (t[0], t[2])) for f in found]


def search(words: list[list[bytes]], least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """All runs of each text's words."""
    cuts, number = stretches(words, least), {}
    parts = [[number.setdefault(w, len(number)) for w in words[t][a:b]] for t, a, b in cuts]
    found: list[list[tuple[int, int, int]]] = [[] for _ in words]
    for (t, a, _), runs in zip(cuts, runs_of(parts, least)):
        found[t] += [(a + s, length, period) for s, length, period in runs]
    return found


def without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for s, length, period in runs:
        edge[s + period] += 1
        edge[s + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]


def _searched(batch: pa.RecordBatch, least: int, change: Change | None) -> Iterator[tuple[int, list[bytes], list[tuple[int, int, int]]]]:
    """(row, words, runs) of a batch (id, text as bytes), a step of texts at a time."""
    texts = [t or b"" for t in batch.column(1).to_pylist()]
    for a, b in steps(texts):
        words = [t.split() for t in texts[a:b]]  # at [\x20\x09-\x0D]+
        if change:
            words = [change(i, w) for i, w in zip(batch.column(0)[a:b].to_pylist(), words)]
        yield from zip(range(a, b), words, search(words, least))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col), F.col(text_col).cast("string").cast("binary").alias("text"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(id, start, length, period): every run, in words from 0."""
    def run(batch):
        rows = [(i, *r) for i, _, runs in _searched(batch, least, None) for r in runs]
        at, s, length, period = zip(*rows) if rows else ([], [], [], [])
        return {id_col: batch.column(0).take(pa.array(at, pa.int64())), "start": s, "length": length, "period": period}

    return map_batches(_texts(docs, id_col, text_col), run, {id_col: type_of(docs, id_col), "start": "long", "length": "long", "period": "long"})


def collapse(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(id, text): each run cut to its first period, the words left joined by one space."""
    def run(batch):
        return {id_col: batch.column(0), "text": [b" ".join(without_repeats(w, r)).decode() for _, w, r in _searched(batch, least, None)]}

    return map_batches(_texts(docs, id_col, text_col), run, {id_col: type_of(docs, id_col), "text": "string"})


def summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, change: Change | None = None) -> DataFrame:
    """A row per text: (id, n_runs; start, length, period, exponent_milli of its longest run; runs_sha256, collapsed_sha256).

    Of equally long runs the first, then the one with the smaller period. ``change`` may alter a row's words beforehand.
    """
    names = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")

    def run(batch):
        rows = []
        for _, words, runs in _searched(batch, least, change):
            listed = hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest()
            s, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
            rows.append((len(runs), s, length, period, 1000 * length // period if runs else None, listed,
                         hashlib.sha256(b" ".join(without_repeats(words, runs))).hexdigest()))
        return {id_col: batch.column(0), **dict(zip(names, zip(*rows)))}

    return map_batches(_texts(docs, id_col, text_col), run, {id_col: type_of(docs, id_col), **dict.fromkeys(names[:5], "long"), **dict.fromkeys(names[5:], "string")})
