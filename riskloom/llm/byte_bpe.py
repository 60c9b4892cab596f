"""Byte-level byte-pair encoding by ranks, with pre-tokenisation over arrays, and decoding by offsets.

Texts of a step become one array of code points. A table gives each its class; with its neighbours to the right the class becomes a
symbol, and every symbol is a function from states to states of a small automaton. Functions compose associatively: blocks
compose theirs side by side, a doubling scan composes blocks, and a second pass gives the state before each code point, hence
where slices begin. A slice of bytes is merged pair by pair, lowest rank first and leftmost among equals, and what came of it
is kept for its next occurrence. Each token keeps the offset of its bytes, and decoding copies all labels to their offsets at once.

Defined results: a null text counts as empty and has no tokens. Nothing is a special token. Decoding gives the bytes encoded; as
text, bytes that are no UTF-8 become U+FFFD. Rows that repeat an id, or have none, are encoded each for itself; further columns
are not read. An empty table gives an empty result. Whole texts are encoded: one longer than a step is cut before single spaces
between other characters, where a slice begins whatever surrounds it.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import STEP_BYTES, map_batches, type_of

#: Code points that \s matches (fixed values).
BLANKS = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Letters and numbers of Unicode 16.0 that Python's 15.1 tables do not have (fixed values).
NEWER_LETTERS = ((0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
                 (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
                 (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
                 (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0))
NEWER_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9),
                 (0x1E5F1, 0x1E5FA))
END = 0x110000  # stands after each text
NONE = np.iinfo(np.int64).max  # rank of a pair that makes no token

#: Symbols: letter, number, other; a blank before a blank or the end; a space, another blank before something else; an apostrophe
#: before one of s t m d, or re ve ll; the end; padding. The first three, INNER and STOP are classes too.
LETTER, NUMBER, OTHER, INNER, STOP, SPACE, BLANK, SHORT, LONG, PAD = range(10)
#: States: a slice must begin; in letters, numbers, others, blanks; after the space that begins a slice; one or two letters of a
#: shortened word to come.
FRESH, LETTERS, NUMBERS, OTHERS, BLANKED, SPACED, ONE, TWO = range(8)
STATES, BLOCK = 8, 256


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(state after, whether a slice begins) by symbol and state."""
    after, begins = np.zeros((10, STATES), np.uint8), np.ones((10, STATES), bool)
    for symbol, own in ((LETTER, LETTERS), (NUMBER, NUMBERS), (OTHER, OTHERS)):
        after[symbol] = own
        begins[symbol, [own, SPACED]] = False
    after[LETTER, [ONE, TWO]] = FRESH, ONE
    begins[LETTER, [ONE, TWO]] = False
    after[INNER], after[SPACE], after[BLANK], after[STOP] = BLANKED, SPACED, FRESH, FRESH
    begins[INNER, BLANKED] = False
    for symbol, own in ((SHORT, ONE), (LONG, TWO)):
        after[symbol] = own
        after[symbol, [OTHERS, SPACED]] = OTHERS
        begins[symbol, [OTHERS, SPACED]] = False
    after[PAD] = np.arange(STATES)
    return after, begins


AFTER, BEGINS = _automaton()
_loaded: dict = {}


def classes() -> np.ndarray:
    """Class of each code point."""
    if "classes" not in _loaded:
        kind = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(END + 1) if c < END), np.uint8, END)
        for symbol, ranges in ((LETTER, NEWER_LETTERS), (NUMBER, NEWER_NUMBERS)):
            for a, b in ranges:
                table[a:b + 1] = symbol
        table[list(BLANKS)] = INNER
        _loaded["classes"] = np.append(table, np.uint8(STOP))
    return _loaded["classes"]


def symbols(points: np.ndarray) -> np.ndarray:
    """Symbols of an array of code points that ends with END."""
    found = classes()[points]
    following = np.append(found[1:], np.uint8(STOP))
    last = (found == INNER) & (following != INNER) & (following != STOP)
    found[last] = np.where(points[last] == 0x20, SPACE, BLANK)
    mark = np.flatnonzero(points == 0x27)
    if len(mark):
        one, two = points[np.minimum(mark + 1, len(points) - 1)], points[np.minimum(mark + 2, len(points) - 1)]
        found[mark[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT
        pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        found[mark[pair]] = LONG
    return found


def states_before(found: np.ndarray) -> np.ndarray:
    """State before each symbol, from FRESH, by a scan over compositions of transition functions."""
    n = len(found)
    rows = max(1, -(-n // BLOCK))
    columns = np.full(rows * BLOCK, PAD, np.uint8)
    columns[:n] = found
    columns = np.ascontiguousarray(columns.reshape(rows, BLOCK).T).astype(np.intp) * STATES
    step = AFTER.ravel()
    whole = np.tile(np.arange(STATES, dtype=np.uint8), (rows, 1))
    for k in range(BLOCK):  # each block's function
        whole = step[columns[k][:, None] + whole]
    reach = 1
    while reach < rows:  # composed with those of all blocks before it
        whole[reach:] = np.take_along_axis(whole[reach:], whole[:-reach].astype(np.intp), 1)
        reach *= 2
    state = np.concatenate([[np.uint8(FRESH)], whole[:-1, FRESH]]).astype(np.uint8)
    out = np.empty((BLOCK, rows), np.uint8)
    for k in range(BLOCK):
        out[k] = state
        state = step[columns[k] + state]
    return out.T.ravel()[:n]


def slices(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, from, to, slices up to the end of each text) of the texts, one after another with a byte between."""
    joined = "\x00".join(texts) + "\x00"
    points = np.frombuffer(joined.encode("utf-32-le"), "<u4").copy()
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    points[ends] = END
    found = symbols(points)
    cut = np.flatnonzero(BEGINS[found, states_before(found)] | (found == STOP))
    size = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    size[ends] = 1
    at = (np.cumsum(size) - size)[cut]
    real = found[cut] != STOP
    upto = np.searchsorted(cut[real], ends)
    return joined.encode(), at[real], np.append(at[1:], at[-1])[real], upto


class Ranks:
    """A file of ranks, one token and its rank a line; compiled once per Python worker."""

    #: Slices whose tokens are kept; only speed depends on it.
    MEMO = 400_000
    #: Bytes from which on a slice is merged through a heap.
    HEAP_FROM = 48

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.labels = [b""] * (max(self.ranks.values()) + 1)
        for label, rank in self.ranks.items():
            self.labels[rank] = label
        self.decimals = [str(i) for i in range(len(self.labels))]
        self.sizes = np.array([len(x) for x in self.labels], np.int64)
        self.flat = np.frombuffer(b"".join(self.labels), np.uint8)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = sorted((left * len(self.labels) + right, rank) for label, rank in self.ranks.items() for i in range(1, len(label))
                       if (left := self.ranks.get(label[:i])) is not None and (right := self.ranks.get(label[i:])) is not None)
        self.pairs, self.made = (np.array(x, np.int64) for x in zip(*pairs))
        self.memo: dict[bytes, bytes] = {}  # slice -> ids

    def learn(self, new: set[bytes]) -> None:
        """Puts the tokens of slices into the memo: whole tokens at once, long slices one by one, all others side by side."""
        short = []
        for piece in new:
            whole = self.ranks.get(piece)
            if whole is not None:
                self.memo[piece] = whole.to_bytes(4, "little")
            elif len(piece) >= self.HEAP_FROM:
                self.memo[piece] = self._merged_by_heap(piece)
            else:
                short.append(piece)
        if short:
            self.memo.update(zip(short, self._merged_together(short)))

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of what two tokens make together, or NONE."""
        key = left * len(self.labels) + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.made[at], NONE)

    def _merged_together(self, slices: list[bytes]) -> list[bytes]:
        """Each round merges the leftmost pair of lowest rank of every slice that has one."""
        size = np.array([len(x) for x in slices], np.int64)
        token = self.single[np.frombuffer(b"".join(slices), np.uint8)]
        row = np.repeat(np.arange(len(slices)), size)
        out = [b""] * len(slices)
        rank = np.append(self._pair_ranks(token[:-1], token[1:]), NONE)
        rank[np.cumsum(size) - 1] = NONE
        while len(token):
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            least = np.minimum.reduceat(rank, first)
            ready = least == NONE
            count = np.diff(np.append(first, len(row)))
            if ready.any():
                listed = token.astype("<u4").tobytes()
                for r, a, n in zip(row[first[ready]].tolist(), first[ready].tolist(), count[ready].tolist()):
                    out[r] = listed[4 * a:4 * (a + n)]
            if ready.all():
                break
            at = np.flatnonzero((rank == np.repeat(least, count)) & (rank != NONE))
            at = at[np.append(True, row[at[1:]] != row[at[:-1]])]
            token[at] = rank[at]
            keep = np.repeat(~ready, count)
            keep[at + 1] = False
            moved = (np.cumsum(keep) - 1)[at]
            token, row, rank = token[keep], row[keep], rank[keep]
            for left in (moved, moved[(moved > 0) & (row[moved - 1] == row[moved])] - 1):
                right = np.minimum(left + 1, len(token) - 1)
                rank[left] = np.where((right > left) & (row[right] == row[left]), self._pair_ranks(token[left], token[right]), NONE)
        return out

    def _merged_by_heap(self, piece: bytes) -> bytes:
        """Parts are ends of a linked list; pairs in the heap that have changed since are passed over."""
        ranks, n = self.ranks, len(piece)
        end, before = list(range(1, n + 1)), list(range(-1, n))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, a, c = heapq.heappop(heap)
            b = end[a]
            if b <= a or b >= n or end[b] != c:
                continue
            end[a], end[b] = c, 0
            if c < n:
                before[c] = a
            for x in (before[a], a):
                if x >= 0 and end[x] < n:
                    stop = end[end[x]]
                    r = ranks.get(piece[x:stop])
                    if r is not None:
                        heapq.heappush(heap, (r, x, stop))
        out, a = [], 0
        while a < n:
            out.append(ranks[piece[a:end[a]]])
            a = end[a]
        return np.array(out, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        blob, low, high, upto = slices(texts)
        found = [blob[a:b] for a, b in zip(low.tolist(), high.tolist())]
        memo, new = self.memo, set(found)
        fresh = new.difference(memo)
        if len(memo) + len(fresh) > self.MEMO:
            memo.clear()
            fresh = new
        self.learn(fresh)
        out, a = [], 0
        for b in upto.tolist():
            out.append(np.frombuffer(b"".join(map(memo.__getitem__, found[a:b])), "<u4"))
            a = b
        return out

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset of each token, and of the end."""
        out = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(self.sizes[ids], out=out[1:])
        return out

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> bytes:
        """The labels, each copied to its offset."""
        if not len(ids):
            return b""
        start = offsets[:-1] - offsets[0]
        return self.flat[np.repeat(self.first[ids] - start, self.sizes[ids]) + np.arange(offsets[-1] - offsets[0])].tobytes()


def ranks_of(path: str) -> Ranks:
    if path not in _loaded:
        _loaded[path] = Ranks(path)
    return _loaded[path]


def pieces(text: str, most: int = STEP_BYTES) -> Iterator[str]:
    """A text, cut about every ``most`` characters before a single space between characters that are no blanks."""
    start = 0
    while len(text) - start > most:
        at = text.find(" ", start + most)
        while 0 <= at < len(text) - 1 and (text[at - 1].isspace() or text[at + 1].isspace()):
            at = text.find(" ", at + 1)
        if not 0 <= at < len(text) - 1:
            break
        yield text[start:at]
        start = at
    yield text[start:] if start else text


def _encoded(ranks: Ranks, texts: list[str | None]) -> Iterator[np.ndarray]:
    """Ids of each text, worked on a step at a time."""
    waiting: list[tuple[int, str]] = []
    parts: list[np.ndarray] = []
    open_row, size = 0, 0

    def flush() -> Iterator[np.ndarray]:
        nonlocal open_row, parts
        for (row, _), ids in zip(waiting, ranks.encode([t for _, t in waiting])):
            while open_row < row:
                yield np.concatenate(parts)
                parts, open_row = [], open_row + 1
            parts.append(ids)
        waiting.clear()

    for row, text in enumerate(texts):
        for piece in pieces(text or ""):
            waiting.append((row, piece))
            size += len(piece) + 1
            if size >= STEP_BYTES:
                yield from flush()
                size = 0
    if waiting:
        yield from flush()
    if parts:
        yield np.concatenate(parts)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids, offsets): ids as little-endian unsigned 32-bit integers; each token's byte offset in the text, and the end, as 64-bit ones."""
    def run(batch):
        ranks = ranks_of(path)
        ids = list(_encoded(ranks, batch.column(1).to_pylist()))
        return {id_col: batch.column(0), "n_tokens": [len(x) for x in ids], "ids": [x.tobytes() for x in ids], "offsets": [ranks.offsets(x).tobytes() for x in ids]}

    return map_batches(_texts(docs, id_col, text_col), run, {id_col: type_of(docs, id_col), "n_tokens": "long", "ids": "binary", "offsets": "binary"})


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", first: int = 0, last: int | None = None) -> DataFrame:
    """(id, text) from ids and offsets; of the tokens from ``first`` to before ``last`` only, where given."""
    def run(batch):
        ranks, out = ranks_of(path), []
        for ids, offsets in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            ids, offsets = np.frombuffer(ids or b"", "<u4")[first:last], np.frombuffer(offsets or bytes(8), "<i8")
            out.append(ranks.decode(ids, offsets[first:][:len(ids) + 1]).decode("utf-8", "replace"))
        return {id_col: batch.column(0), "text": out}

    return map_batches(encoded.select(id_col, "ids", "offsets"), run, {id_col: type_of(encoded, id_col), "text": "string"})


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256 of decimal ids joined by commas, decoded_sha256 of the decoded bytes): encodes and decodes in one pass."""
    def run(batch):
        ranks, rows = ranks_of(path), []
        for ids in _encoded(ranks, batch.column(1).to_pylist()):
            listed = ",".join(map(ranks.decimals.__getitem__, ids.tolist()))
            rows.append((len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(ranks.decode(ids, ranks.offsets(ids))).hexdigest()))
        n, a, b = zip(*rows)
        return {id_col: batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": a, "decoded_sha256": b}

    return map_batches(_texts(docs, id_col, text_col), run, {id_col: type_of(docs, id_col), "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"})
