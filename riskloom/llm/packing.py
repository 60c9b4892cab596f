"""Packing documents into token sequences of a fixed length, with a certificate per partition.

A document is its token ids and one end id. Documents longer than a sequence are cut into whole sequences and a rest; nothing
else is cut. Pieces are dealt into partitions of about ``group_rows`` rows, and each partition packs its own by best fit
decreasing. Dual feasible functions give a lower bound of the sequences any packing needs; a partition that reaches it is done.
Sequences with gaps are emptied: partitions exchange the documents in them and pack them again, until they fit into one
partition or an exchange gains nothing.

Defined results: a null or empty text is the end id alone. Rows that repeat an id are packed each for itself (its pieces stay
in order, ids may repeat). Columns other than the id and the text are not read. An empty table gives an empty result. A piece
lies in one sequence at ``offset``; sequence numbers are unique, and negative for sequences that one piece fills.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.bpe import byte_alphabet
from riskloom.llm.common import map_partitions, type_of
from riskloom.session import materialise

#: Distinct blank-separated words whose ids a task keeps. Only speed depends on it.
MEMO_WORDS = 300_000

_loaded: dict = {}


class WordEncoder:
    """Ids of whole texts by the tokenizers library, word by word.

    The file's own rules never join text across blanks (it drops them), so a text's ids are those of its words in turn, and a
    repeated word needs no second call. Words of plain letters, digits and marks are lower-cased and split here and go straight
    to the library's model; all other words, and those that may hold a special token, go through the library's whole chain.
    """

    #: Characters whose lower case and class need no table: ASCII, and the Latin-1 letters that have case.
    PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]*")
    SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.printable = {b: c for c, b in byte_alphabet().items()}
        self.memo: dict[bytes, bytes] = {}
        self.stems: dict[str, bytes] = {}

    def stem(self, stem: str) -> bytes:
        ids = self.stems.get(stem)
        if ids is None:
            if len(self.stems) >= MEMO_WORDS:
                self.stems.clear()
            shown = stem if stem.isascii() else stem.encode().decode("latin-1").translate(self.printable)
            ids = self.stems[stem] = array("I", [t.id for t in self.tokenizer.model.tokenize(shown)]).tobytes()
        return ids

    def word(self, raw: bytes) -> bytes:
        word = raw.decode()
        if self.PLAIN.fullmatch(word) and not any(s in word for s in self.special):
            return b"".join(map(self.stem, self.SPLIT.findall(word.lower())))
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def forget(self) -> None:
        self.memo.clear()
        self.stems.clear()

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        memo, out = self.memo, []
        for text in texts:
            words = text.split()
            try:
                out.append(b"".join(map(memo.__getitem__, words)))
            except KeyError:
                if len(memo) >= MEMO_WORDS:
                    memo.clear()
                for w in set(words):
                    if w not in memo:
                        memo[w] = self.word(w)
                out.append(b"".join(map(memo.__getitem__, words)))
        return out


def encoder(path: str) -> WordEncoder:
    """One per Python worker and file."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _loaded:
        _loaded[path] = WordEncoder(path)
    return _loaded[path]


def pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of every document."""
    schema = {id_col: type_of(docs, id_col), "piece": "int", "start": "long", "length": "long", "ids_crc32": "long"} | ({"ids": "binary"} if with_ids else {})
    end, width = array("I", [end_id]).tobytes(), 4 * capacity

    def cut(batches):
        try:
            for batch in batches:
                yield cut_batch(batch)
        finally:
            encoder(path).forget()  # the worker outlives its task, and other stages need the memory

    def cut_batch(batch):
        own, at, size, crc, ids = [], [], [], [], []
        texts = batch.column(1).cast("binary").to_pylist()
        encoder_ = encoder(path)
        for doc, text in zip(batch.column(0).to_pylist(), texts):
            all_ids = encoder_.encode([text or b""])[0] + end
            for i in range(0, len(all_ids), width):
                part = all_ids[i:i + width]
                own.append(doc)
                at.append(i // 4)
                size.append(len(part) // 4)
                crc.append(zlib.crc32(part))
                if with_ids:
                    ids.append(part)
        return {id_col: own, "piece": [x // capacity for x in at], "start": at, "length": size, "ids_crc32": crc, "ids": ids}

    return map_partitions(docs.select(F.col(id_col), F.col(text_col).cast("string")), cut, schema)


def bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that any packing needs, by dual feasible functions; ``counts[n]`` pieces have length n."""
    sizes = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int(counts @ sizes) // capacity)
    # threshold functions: above capacity - t counts whole, below t not at all
    weight = np.concatenate([[0], np.cumsum(counts * sizes)])
    number = np.concatenate([[0], np.cumsum(counts)])
    t = np.arange(1, capacity // 2 + 1)
    whole = number[-1] - number[capacity - t + 1]
    middle = weight[capacity - t + 1] - weight[t]
    best = max(best, int((whole + -(-middle // capacity)).max(initial=0)))
    for k in range(1, 33):  # rounding functions
        exact = (sizes * (k + 1)) % capacity == 0
        value = np.where(exact, sizes * k, (sizes * (k + 1) // capacity) * capacity)
        best = max(best, -(-int(counts @ value) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each piece, offset in it, filled tokens of each bin). Open bins are found by a bit mask of their free room."""
    order = np.argsort(-lengths, kind="stable")
    bin_of, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    filled: list[int] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i, size in zip(order.tolist(), lengths[order].tolist()):
        above = mask >> size
        if above:
            free = size + (above & -above).bit_length() - 1
            b = room[free].pop()
            if not room[free]:
                mask &= ~(1 << free)
        else:
            b, free = len(filled), capacity
            filled.append(0)
        bin_of[i], offset[i] = b, filled[b]
        filled[b] += size
        left = free - size
        if left:
            room[left].append(b)
            mask |= 1 << left
    return bin_of, offset, np.asarray(filled, np.int64)


def pack(parts: DataFrame, capacity: int = 2048, group_rows: int = 20_000, gap: int | None = None) -> DataFrame:
    """``parts`` with ``sequence_id`` and ``offset``. ``gap``: free tokens from which a sequence is emptied and exchanged."""
    gap = max(1, capacity // 64) if gap is None else gap
    numbered = materialise(parts).withColumn("__row", F.monotonically_increasing_id())
    done = [numbered.where(F.col("length") >= capacity).withColumn("sequence_id", -1 - F.col("__row")).withColumn("offset", F.lit(0).cast("long"))]
    pool = numbered.where(F.col("length") < capacity).withColumn("offset", F.lit(0).cast("long"))
    columns = pool.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pool.schema) + ", sequence_id bigint, open boolean"

    def fill(key: tuple[int, ...], rows: pd.DataFrame) -> pd.DataFrame:
        # ties by row number, so that a task that runs again gives the same rows
        rows = rows.sort_values("__row", kind="stable")
        lengths = rows["length"].to_numpy()
        bin_of, offset, filled = best_fit_decreasing(lengths, capacity)
        proven = len(filled) == bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        loose = capacity - filled >= gap
        if proven and loose.sum() > 1:  # a proven partition only hands on its emptiest sequence
            loose = np.arange(len(filled)) == filled.argmin()
        return rows.drop(columns="__group").assign(offset=offset, sequence_id=(int(key[0]) << 32) + bin_of, open=loose[bin_of])

    first, last_bins = 0, None
    while True:
        n = pool.count()
        if not n:
            break
        groups = -(-n // group_rows)
        dealt = pool.withColumn("__group", F.lit(first) + F.pmod(F.xxhash64("__row", F.lit(first)), F.lit(groups)))
        packed = materialise(dealt.groupBy("__group").applyInPandas(fill, schema))
        first += groups
        bins = packed.where("open").select("sequence_id").distinct().count()
        if groups == 1 or bins == 0 or (last_bins is not None and bins >= last_bins):
            done.append(packed.drop("open"))
            break
        done.append(packed.where("not open").drop("open"))
        pool, last_bins = packed.where("open").select(*columns), bins
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.drop("__row")


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    return pack(pieces(docs, path, capacity, end_id, id_col, text_col, with_ids), capacity)
