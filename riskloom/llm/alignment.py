"""Which tokens of two tokenizers cover the same bytes, by merge-path partitioning.

Both tokenizers cut the same bytes, so their tokens' ends are two ascending lists. Merging them visits each pair of tokens that
overlap once, and every end that both lists have closes a group. The merge of a step of texts is one grid path; diagonals of
equal distance divide it into pieces of the same number of ends, whose corners are found by binary search on the diagonal. The pieces
advance side by side, each emitting the pairs it meets and counting the ends it closes; the counts of the pieces before
it give a piece's first group its number, so that a group which spans pieces is one again.

How often two ids are linked is counted over all texts in two steps. A task keeps the distinct pairs of a block of texts, with
their counts, and each text's links as numbers into that list. Blocks hold every pair once, so that the join of blocks with
total counts has no hot key; what it finds meets the block's texts again by the block's number. The first pass is written to the
shared folder, so neither step tokenises again.

Defined results: texts that are null, empty, or that either tokenizer does not give back byte for byte have no tokens: zeros, and an
empty string in place of the digest. Rows that repeat an id, or have none, are aligned each for themselves and count each.
Further columns are not read. An empty table gives an empty result. Whole texts are aligned; a task holds a block of texts and one
step of about a megabyte, or one longer text.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.bpe import PATTERN, byte_alphabet
from riskloom.llm.common import map_batches, map_partitions, small_batches, steps, type_of
from riskloom.session import materialise

#: Ends in a piece of the merge.
PIECE = 256
#: Bytes of text in a block.
BLOCK_BYTES = 4 << 20
#: Bits of the second id in a pair's number.
SHIFT = 32

_loaded: dict = {}


def corners(a: np.ndarray, b: np.ndarray, piece: int) -> np.ndarray:
    """How many ends of ``a`` come before each diagonal 0, piece, 2 * piece, ... of the merge; at ties ``a`` comes first."""
    d = np.arange(0, len(a) + len(b), piece)
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (low < high).any():
        middle, open_ = (low + high) // 2, low < high
        taken = open_ & (a[np.minimum(middle, len(a) - 1)] <= b[np.clip(d - 1 - middle, 0, len(b) - 1)])
        low, high = np.where(taken, middle + 1, low), np.where(open_ & ~taken, middle, high)
    return low


def merge(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(link_a, link_b, group_a, group_b) of two ascending lists of ends over the same bytes: the pairs that overlap, in order,
    and the number of each token's group. All pieces take their first end, then all their second, and so on."""
    n, m = len(a), len(b)
    if not n or not m:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(n, np.int64), np.zeros(m, np.int64))
    far = np.iinfo(np.int64).max
    i = corners(a, b, piece)
    d = np.arange(0, n + m, piece)
    j = d - i
    lanes, last = len(d), np.minimum(d + piece, n + m) - d
    enda, endb = np.append(a, far), np.append(b, far)
    starta, startb = np.insert(a, 0, 0), np.insert(b, 0, 0)
    at_a, at_b = np.empty((piece, lanes), np.int64), np.empty((piece, lanes), np.int64)
    kind = np.zeros((piece, lanes), np.uint8)  # 1: overlap, 2: takes from b, 4: closes a group, 8: a step
    for k in range(piece):
        ea, eb, sa = enda[i], endb[j], starta[i]
        live, from_b = k < last, ea > eb
        at_a[k], at_b[k] = i, j
        kind[k] = ((sa < eb) & (startb[j] < ea) & (i < n) & (j < m)) | (from_b.astype(np.uint8) << 1) | ((from_b & (sa == eb)).astype(np.uint8) << 2) | 8
        kind[k] *= live
        i, j = i + (live & ~from_b), j + (live & from_b)
    at_a, at_b, kind = at_a.T.ravel(), at_b.T.ravel(), kind.T
    closed = (kind & 4) > 0
    inside = np.cumsum(closed, 1) - closed  # groups closed in the piece before each step
    whole = closed.sum(1)
    group = (inside + (np.cumsum(whole) - whole)[:, None]).ravel()
    kind = kind.ravel()
    linked, takes_a, takes_b = (kind & 1) > 0, (kind & 10) == 8, (kind & 10) == 10
    return at_a[linked], at_b[linked], group[takes_a], group[takes_b]


class Sides:
    """Both tokenizers and the bytes of their tokens; loaded once per Python worker."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece

        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        with open(path_a, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        self.encode_a = self._by_ranks(spec, alphabet) or self._by_file(path_a)
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            self.bytes_a[i] = bytes(alphabet[c] for c in piece) if all(c in alphabet for c in piece) else piece.encode()
        self.bytes_b = [self._bytes_b(i) for i in range(self.b.get_piece_size())]
        self.size_a, self.size_b = (np.array([len(x) for x in s], np.int64) for s in (self.bytes_a, self.bytes_b))
        #: Ids as text with what follows: inside a group, and at the end of its half.
        self.written = [f"{i}{end}" for count, ends in ((len(self.bytes_a), ",|"), (len(self.bytes_b), ",;")) for end in ends for i in range(count)]

    @staticmethod
    def _by_ranks(spec: dict, alphabet: dict[str, int]):
        """An encoder four times as fast, where it gives the same ids: byte-level merges whose tokens have ids in the order of the
        merges, pre-split by the pattern of this family, nothing else done to the text."""
        import tiktoken

        vocab = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        singles = sorted(vocab[c] for c in alphabet if c in vocab)
        split = spec["pre_tokenizer"] or {}
        if (spec["normalizer"] or spec["model"].get("dropout") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True)
                or singles != list(range(256)) or any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges))):
            return None
        ranks = {bytes(alphabet[c] for c in piece): i for piece, i in vocab.items() if i < 256 + len(merges)}
        encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return lambda texts: [encode(t) for t in texts]

    @staticmethod
    def _by_file(path: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        return lambda texts: [x.ids for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _bytes_b(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def tokens(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of each text by both, or none where the bytes differ."""
        found = []
        for t, ids, y in zip(texts, self.encode_a([" " + t for t in texts]), self.b.encode(texts, num_threads=1)):
            whole = b" " + t.encode()
            same = t and b"".join(map(self.bytes_a.__getitem__, ids)) == whole == b"".join(map(self.bytes_b.__getitem__, y))
            found.append((ids, y) if same else ([], []))
        return found


class Step:
    """The alignment of a step of texts: per text n_a, n_b, n_groups, n_links; pairs in order of the texts; groups as text."""

    def __init__(self, sides: Sides, texts: list[str]):
        tokens = sides.tokens(texts)
        self.n_a, self.n_b = (np.array([len(t[k]) for t in tokens], np.int64) for k in (0, 1))
        a, b = (np.fromiter(chain.from_iterable(t[k] for t in tokens), np.int64, int(n.sum())) for k, n in ((0, self.n_a), (1, self.n_b)))
        link_a, link_b, group_a, group_b = merge(np.cumsum(sides.size_a[a]), np.cumsum(sides.size_b[b]))
        self.pairs = a[link_a] << SHIFT | b[link_b]
        of_a, n = np.repeat(np.arange(len(texts)), self.n_a), len(texts)
        self.n_links = np.bincount(of_a[link_a], minlength=n)
        new = np.append(group_a[1:] != group_a[:-1], True)[:len(a)]  # last token of its group
        self.n_groups = np.bincount(of_a[new], minlength=n)
        groups = int(new.sum())
        in_a, in_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a]] = a + len(sides.bytes_a) * new
        new = np.append(group_b[1:] != group_b[:-1], True)[:len(b)]
        order[np.arange(len(b)) + np.cumsum(in_a)[group_b]] = 2 * len(sides.bytes_a) + b + len(sides.bytes_b) * new
        self._order, self._upto, self._written = order, np.cumsum(self.n_a + self.n_b), sides.written

    def groups(self) -> Iterator[str]:
        """`a1,a2|b1;a3|b2,b3` of each text."""
        start = 0
        for stop in self._upto.tolist():
            yield "".join(map(self._written.__getitem__, self._order[start:stop].tolist()))[:-1]
            start = stop


def sides_of(path_a: str, path_b: str) -> Sides:
    if (path_a, path_b) not in _loaded:
        _loaded[path_a, path_b] = Sides(path_a, path_b)
    return _loaded[path_a, path_b]


def _rows(batch: pa.RecordBatch, sides: Sides) -> Iterator[tuple[pa.Array, int, Step]]:
    """(ids, bytes of text, alignment) of each step of a batch (id, text)."""
    texts = [t or "" for t in batch.column(1).to_pylist()]
    for a, b in steps(texts):
        yield batch.column(0)[a:b], sum(map(len, texts[a:b])), Step(sides, texts[a:b])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups): the groups of each text, as `a1,a2|b1;a3|b2,b3` in ids of both tokenizers."""
    def run(batch):
        found = list(_rows(batch, sides_of(path_a, path_b)))
        return {id_col: batch.column(0), **{c: [x for _, _, s in found for x in getattr(s, c).tolist()] for c in NUMBERS},
                "groups": [g for _, _, s in found for g in s.groups()]}

    return map_batches(_texts(docs, id_col, text_col), run, {id_col: type_of(docs, id_col), **dict.fromkeys(NUMBERS, "long"), "groups": "string"})


NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def blocks(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per text with its block and its links, compressed, as numbers into the block's list of pairs, which one of its rows holds."""
    schema = {id_col: type_of(docs, id_col), "block": "long", **dict.fromkeys(NUMBERS, "long"), "groups_sha256": "string", "links": "binary",
              "pairs": "array<long>", "times": "array<long>"}

    def run(batches):
        number, waiting, size = TaskContext.get().partitionId() << SHIFT, [], 0
        for batch in batches:
            for ids, text, step in _rows(batch, sides_of(path_a, path_b)):
                digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in step.groups()]
                waiting.append((ids, digests, {c: getattr(step, c) for c in NUMBERS}, step.pairs))
                size += text
                if size >= BLOCK_BYTES:
                    yield block(number, waiting)
                    number, waiting, size = number + 1, [], 0
        if waiting:
            yield block(number, waiting)

    def block(number, waiting):
        pairs, place, times = np.unique(np.concatenate([p for *_, p in waiting]), return_inverse=True, return_counts=True)
        often = np.argsort(-times, kind="stable")  # frequent pairs first: small numbers compress better
        rank = np.empty_like(often)
        rank[often] = np.arange(len(often))
        place, out, start = rank[place].astype("<u4"), [], 0
        counts = {c: np.concatenate([counts[c] for _, _, counts, _ in waiting]) for c in NUMBERS}
        zstd = pa.Codec("zstd")
        for n in counts["n_links"].tolist():
            part = place[start:start + n]
            out.append(zstd.compress((part & 0xFFFF).astype("<u2").tobytes() + (part >> 16).astype("<u2").tobytes(), asbytes=True))
            start += n
        rest = [None] * (len(out) - 1)
        return {id_col: pa.concat_arrays([ids for ids, *_ in waiting]), "block": np.full(len(out), number), **counts,
                "groups_sha256": [d for _, ds, *_ in waiting for d in ds], "links": out, "pairs": [pairs[often], *rest], "times": [times[often], *rest]}

    return map_partitions(_texts(docs, id_col, text_col), run, schema)


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, total) over all ``blocks``: how often two ids are linked."""
    one = found.where(F.col("pairs").isNotNull()).select(F.explode(F.arrays_zip("pairs", "times")).alias("p"))
    return one.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("total"))


def alignment(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256).

    ``n_best``: links whose pair is linked as often as any pair with its second id; ``count_sum``: sum of the links' counts.
    """
    found = materialise(blocks(docs, path_a, path_b, id_col, text_col))
    totals = materialise(pair_counts(found))
    second = F.col("pair").bitwiseAND((1 << SHIFT) - 1)
    highest = totals.groupBy(second.alias("second")).agg(F.max("total").alias("most"))  # a row per id of the second vocabulary
    known = totals.join(F.broadcast(highest), second == F.col("second")).select("pair", "total", (F.col("total") == F.col("most")).alias("best"))
    listed = found.where(F.col("pairs").isNotNull()).select(F.col("block").alias("of"), F.posexplode("pairs").alias("place", "pair"))
    numbered = listed.join(known, "pair").select("of", "place", "total", "best")
    texts = found.select(id_col, "block", *NUMBERS, "groups_sha256", "links")
    names = (*NUMBERS, "n_best", "count_sum", "groups_sha256")
    schema = f"{id_col} {type_of(docs, id_col)}, " + ", ".join(f"{c} {'string' if c == 'groups_sha256' else 'long'}" for c in names)
    small_batches(docs.sparkSession)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        total, best = np.zeros(right.num_rows, np.int64), np.zeros(right.num_rows, np.int64)
        place = right["place"].to_numpy()
        total[place], best[place] = right["total"].to_numpy(), right["best"].to_numpy()
        zstd, sums, bests = pa.Codec("zstd"), [], []
        for n, packed in zip(left["n_links"].to_pylist(), left["links"].to_pylist()):
            parts = np.frombuffer(zstd.decompress(packed, decompressed_size=4 * n, asbytes=True), "<u2").astype(np.int64)
            links = parts[:n] | parts[n:] << 16
            sums.append(int(total[links].sum()))
            bests.append(int(best[links].sum()))
        made = {"n_best": pa.array(bests, pa.int64()), "count_sum": pa.array(sums, pa.int64())}
        return pa.table({c: made[c] if c in made else left[c] for c in (id_col, *names)})

    return texts.groupBy("block").cogroup(numbered.groupBy("of")).applyInArrow(run, schema)
