"""Byte-pair encoding by a deterministic automaton over tokens, and decoding by its arc labels.

The automaton starts with one state and an arc per byte. Each merge (a, b), in order, is a gadget: the state that arcs `a`
lead to is copied without its arc `b`, arcs `a` now lead to the copy, and every state with an arc `a` gets an arc `ab` to where
`b` leads. After the last merge exactly the token sequences that the merges can produce are paths, so a word has one path.
All arcs with one label lead to one state; a state is the one before its gadget less one arc, and an arc `ab` younger than the
state is there if `a` is. Whether a state has an arc is told by the gadgets of the tokens that meet, from the last one back: as
many lookups as the two tokens have merges. These are the transition tables; pairs looked up are kept.

Defined results: a null text counts as empty and has no tokens. Special tokens of the file are found in the text first, as the
library does. Decoding gives the text back; bytes that are no UTF-8 become U+FFFD. Rows that repeat an id are encoded each for
itself; other columns are not read. An empty table gives an empty result. Whole texts are encoded, whatever their length.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from string import punctuation

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import map_batches, type_of

#: The public pre-split pattern of this family of vocabularies (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Chunks and words that a generation of a worker's memo holds, and state-token pairs that it keeps. Only speed depends on them.
MEMO_CHUNKS, MEMO_PAIRS = 300_000, 600_000
#: All letters below this are letters in every version of Unicode.
OLD_LETTERS = "\u0180"
#: Bytes by which the longest token that may follow is looked up. Only speed depends on them.
HEAD = 4
#: Ids that decoding works on at a time.
STEP_IDS = 1 << 16

_loaded: dict = {}


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of the bytes: printable Latin-1 stands for itself, the other bytes follow from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """States and arcs by successive merge gadgets; ``labels[token]`` are an arc's bytes."""

    def __init__(self, singles: dict[int, int], merges: list[tuple[int, int, int]], labels: dict[int, bytes]):
        """``singles``: byte -> token; ``merges``: (a, b, ab) in order."""
        self.labels, self.token = labels, {labels[t]: t for t in singles.values()}
        self.left: dict[int, int] = {}  # token -> token that it begins with
        self.born: dict[int, int] = dict.fromkeys(singles.values(), 0)  # token -> step from which its arcs exist
        self.target: dict[int, int] = dict.fromkeys(singles.values(), 0)  # token -> state its arcs lead to
        self.right: dict[int, int] = {}  # token -> token that it ends with
        self.gadget: dict[int, int] = {}  # pair of tokens -> step that merges it
        self.after, self.since = [-1], [0]  # by state: a token whose arcs led to it, and from which step on
        self.known: dict[int, int] = {}
        for step, (a, b, ab) in enumerate(merges, 1):
            if ab in self.born or a not in self.born or b not in self.born or not self.allows(self.target[a], b):
                continue  # the pair never meets, or the token has another derivation already
            self.left[ab], self.right[ab], self.born[ab] = a, b, step
            self.target[ab] = self.target[b]  # for 'aa' that is the state before the gadget: a third 'a' may follow
            self.token[labels[ab]] = ab
            self.gadget[a << 20 | b] = step
            self.after.append(a)
            self.since.append(step)
            self.target[a] = len(self.after) - 1
        self.reach: dict[bytes, int] = {}  # first HEAD bytes of tokens -> bytes of the longest that begins so
        self.size = {t: len(label) for label, t in self.token.items()}
        self.shorter: dict[int, int] = {}  # token -> longest other token that it begins with, or -1
        for label, t in self.token.items():
            if len(label) >= HEAD:
                self.reach[label[:HEAD]] = max(self.reach.get(label[:HEAD], 0), len(label))
            self.shorter[t] = next((x for k in range(len(label) - 1, 0, -1) if (x := self.token.get(label[:k])) is not None), -1)

    def allows(self, state: int, token: int) -> bool:
        """Whether ``state`` has an arc ``token``. Back in time from the state's gadget, the younger of the two tokens that meet is
        undone first; the arc is missing if a gadget took it away while they met."""
        if not state:
            return True
        a, upto, removed, born = self.after[state], self.since[state], self.gadget.get, self.born
        while True:
            if removed(a << 20 | token, upto + 1) <= upto:
                return False
            x, y = born[a], born[token]
            if y >= x:
                if not y:
                    return True
                if y < upto:
                    upto = y
                token = self.left[token]
            else:
                if x <= upto:
                    upto = x - 1
                a = self.right[a]

    def step(self, state: int, token: int) -> int:
        """The state after an arc, or -1."""
        key = state << 20 | token
        to = self.known.get(key)
        if to is None:
            to = self.target[token] if self.allows(state, token) else -1
            if len(self.known) >= MEMO_PAIRS:
                self.known.clear()
            self.known[key] = to
        return to

    def path(self, word: bytes) -> list[int]:
        """The one path that spells ``word``: the longest arc first, then the token that is its next shorter beginning, back where
        none leads on; a place that failed is not entered again."""
        token, step, known, reach, shorter, size = self.token.get, self.step, self.known.get, self.reach.get, self.shorter, self.size
        arc = token(word)
        if arc is not None:
            return [arc]
        at, state, n, states, arcs, failed, best = 0, 0, len(word), [], [], set(), {}
        while at < n:
            arc = best.get(at)
            if arc is None:
                top = at + reach(word[at:at + HEAD], HEAD - 1)  # no token at this place ends later
                for end in range(top if top < n else n, at, -1):
                    arc = token(word[at:end])
                    if arc is not None:
                        break
                best[at] = arc
            while True:
                while arc >= 0:
                    to = known(state << 20 | arc)
                    if to is None:
                        to = step(state, arc)
                    if to >= 0 and not (failed and (at + size[arc], to) in failed):
                        break
                    arc = shorter[arc]
                if arc >= 0:
                    break
                failed.add((at, state))
                state, arc = states.pop(), arcs.pop()
                at -= size[arc]
                arc = shorter[arc]
            arcs.append(arc)
            states.append(state)
            at += size[arc]
            state = to
        return arcs


class Memo(dict):
    """What ``make`` gives for a key, kept for one to two generations of ``MEMO_CHUNKS`` keys: what is in use outlives a full memo."""

    def __init__(self, make):
        self.make, self.before = make, {}

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= MEMO_CHUNKS:
            self.before = dict(self)
            self.clear()
        self[key] = value
        return value


class Codec:
    """A tokenizer file of byte-level BPE, compiled."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        labels = {t: bytes(alphabet[c] for c in s) for s, t in vocab.items() if all(c in alphabet for c in s)}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.automaton = Automaton({alphabet[s]: t for s, t in vocab.items() if s in alphabet}, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], labels)
        self.labels = labels | {t: s.encode() for s, t in self.special.items()}
        # labels one after another, for decoding: where each begins, and its size (-1: no such token)
        self.sizes = np.full(max(self.labels, default=-1) + 1, -1)
        for t, label in self.labels.items():
            self.sizes[t] = len(label)
        self.starts = np.cumsum(np.maximum(self.sizes, 0)) - np.maximum(self.sizes, 0)
        self.flat = np.frombuffer(b"".join(self.labels[t] for t in sorted(self.labels)), np.uint8)
        self.split = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.odd = regex.compile(r"\s (?:\s|$)")
        self.words = Memo(lambda word: array("I", self.automaton.path(word.encode())).tobytes())
        self.chunks = Memo(self.chunk)

    def segment(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.split.findall(text)))

    def chunk(self, chunk: str) -> bytes:
        """A blank and ``chunk``, which has none. Letters, and letters before one ASCII sign, are what the pattern makes of them."""
        body = chunk[:-1]
        if chunk.isalpha():
            if max(chunk) < OLD_LETTERS:
                return self.words[" " + chunk]
        elif body.isalpha() and chunk[-1] in punctuation and max(body) < OLD_LETTERS:
            return self.words[" " + body] + self.words[chunk[-1]]
        return self.segment(" " + chunk)

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids. A text is cut before its spaces, which is where the pattern cuts too, unless
        blanks meet; such texts and those with special tokens are split as a whole."""
        if self.cut and any(s in text for s in self.special):
            return b"".join(array("I", [self.special[x]]).tobytes() if x in self.special else self.segment(x) for x in self.cut.split(text))
        if self.odd.search(text):
            return self.segment(text)
        first, *rest = text.split(" ")
        return self.segment(first) + b"".join(map(self.chunks.__getitem__, rest))

    def decode(self, ids: bytes) -> str:
        """The labels of the arcs, in turn, a step of ids at a time."""
        found, out = np.frombuffer(ids, np.uint32), []
        for i in range(0, len(found), STEP_IDS):
            part = found[i:i + STEP_IDS]
            known = part < len(self.sizes)
            if not known.all() or (self.sizes[part] < 0).any():
                raise KeyError("an id that is not in the vocabulary")
            size = self.sizes[part]
            end = np.cumsum(size)
            out.append(self.flat[np.repeat(self.starts[part] - end + size, size) + np.arange(end[-1])].tobytes())
        return b"".join(out).decode("utf-8", "replace")


def codec(path: str) -> Codec:
    """One per Python worker and file."""
    if path not in _loaded:
        _loaded[path] = Codec(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids) with ids as little-endian unsigned 32-bit integers."""
    def run(batch):
        ids = [codec(path).encode(t or "") for t in batch.column(1).to_pylist()]
        return {id_col: batch.column(0), "n_tokens": [len(x) // 4 for x in ids], "ids": ids}

    return map_batches(docs.select(F.col(id_col), F.col(text_col).cast("string")), run, {id_col: type_of(docs, id_col), "n_tokens": "long", "ids": "binary"})


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from ids."""
    def run(batch):
        return {id_col: batch.column(0), "text": [codec(path).decode(x or b"") for x in batch.column(1).to_pylist()]}

    return map_batches(encoded.select(id_col, ids_col), run, {id_col: type_of(encoded, id_col), "text": "string"})


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encodes and decodes in one pass over the texts."""
    def run(batch):
        c, rows = codec(path), []
        for t in batch.column(1).to_pylist():
            ids = c.encode(t or "")
            rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(c.decode(ids).encode()).hexdigest()))
        n, a, b = zip(*rows)
        return {id_col: batch.column(0), "n_tokens": n, "ids_sha256": a, "decoded_sha256": b}

    return map_batches(docs.select(F.col(id_col), F.col(text_col).cast("string")), run,
                       {id_col: type_of(docs, id_col), "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"})
