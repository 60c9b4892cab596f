"""Scoring by a hidden Markov language model over all words of the corpus.

States emit classes, classes emit words. The ``FREQUENT`` most frequent training words and the end of a text are classes of their
own; all other words share ``ENDINGS`` classes by their last two bytes, and within its class a word has its smoothed relative
frequency, counted over the whole training part. So the vocabulary is that of the corpus while a state's emissions stay bounded.

1. Words of the training texts are counted inside each task and summed over all of them.
2. Every text becomes a sequence of classes, written once; words outside the frequent ones are kept beside it.
3. Baum-Welch from a random tilt: each round runs forward and backward over all training sequences, sums expected counts inside
   each task, adds them over the tasks, and re-estimates. Rounds end when one gains too little likelihood, or after ``rounds``.
   For training alone, long texts are cut into segments of ``SEGMENT`` tokens.
4. A scaled forward recursion over each whole text gives its exact likelihood under the states; the words outside the frequent
   ones meet their counts in a join and add their share.

The table of frequent words is of fixed size, and no word outside it can be hot: it has less than 1/FREQUENT of the training tokens.

Defined results: a null or empty text is the end alone. Without training texts every word is unknown and scores are those of
the smoothed start. Rows that repeat an id are scored each for itself (a row has a number of its own); other columns are not
read. An empty table gives an empty result. Ties in frequency go by the word.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import map_partitions, type_of
from riskloom.session import materialise

FREQUENT, ENDINGS, SEGMENT = 40_000, 256, 128
#: Segments that Baum-Welch works on side by side, and steps between two scalings. Only speed depends on them.
BLOCK, GROUP = 512, 8
#: Classes whose expected counts go from task to task as one row; tokens that a task of a round has at least where there are as many,
#: as each task hands on the counts of all classes that it has met.
SLICE, TASK_TOKENS = 4096, 2_000_000
#: Bytes of rare words with their counts in a partition of the last join.
JOIN_BYTES = 16 << 20
#: Distinct words that a task counts before it hands its counts on.
HELD_WORDS = 200_000
#: Weight, in tokens per state, of the corpus frequencies in a state's emissions.
PRIOR = 200.0
END = b""  # no word is empty


def words_of(text: bytes | None) -> list[bytes]:
    """Words with A-Z in lower case, and the end."""
    return (text or b"").lower().split() + [END]


def ending(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % ENDINGS


def count_words(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, c) of all given texts; the end is the empty word."""
    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(words_of(text))
                if len(held) >= HELD_WORDS:
                    yield {"word": list(held), "c": list(held.values())}
                    held = Counter()
        if held:
            yield {"word": list(held), "c": list(held.values())}

    return map_partitions(docs.select(F.col(text_col).cast("string").cast("binary")), run, {"word": "binary", "c": "long"}).groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Lexicon:
    """Frequent words and their counts, and the totals. Class numbers: frequent words, then endings."""

    words: list[bytes]
    counts: np.ndarray
    tokens: int
    distinct: int
    ending_tokens: np.ndarray
    other_bytes: int

    @property
    def classes(self) -> int:
        return len(self.words) + ENDINGS

    def base(self, c: np.ndarray) -> np.ndarray:
        return np.log10((c + 0.1) / (self.tokens + 0.1 * (self.distinct + 1)))


def lexicon(counts: DataFrame, frequent: int) -> tuple[Lexicon, DataFrame, np.ndarray]:
    """The lexicon, (word, c) of the other words, and for each ending what a count in it is divided by."""
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    top = counts.orderBy(F.desc("c"), "word").limit(frequent).collect()
    words = [bytes(r.word) for r in top]
    if END not in words:
        words, top = [*words, END], [*top, *counts.where(F.length("word") == 0).collect()]
    c = np.array([r.c for r in top] + [0] * (len(words) - len(top)), float)
    last = top[frequent - 1] if len(top) >= frequent else None
    # the frequent ones are a prefix of the order by (count, word)
    other = counts.where(F.length("word") > 0)
    other = other.where((F.col("c") < last.c) | ((F.col("c") == last.c) & (F.col("word") > F.lit(bytes(last.word))))) if last else other.where(F.lit(False))
    other = other.withColumn("class", (F.crc32(F.expr("substring(word, -2, 2)")) % ENDINGS).cast("int"))
    per = other.groupBy("class").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), F.sum(F.length("word") + 64).alias("held")).collect()  # at most ENDINGS rows
    n, v = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for r in per:
        n[r["class"]], v[r["class"]] = r.n, r.v
    return Lexicon(words, c, total.n, total.v, n, sum(r.held for r in per)), other.select("word", "c"), n + 0.1 * (v + 1)


def encode(docs: DataFrame, lex: Lexicon, share: np.ndarray, trained: Column, id_col: str, text_col: str) -> DataFrame:
    """(row, id, trained, n_tokens, known, base, tail, seq, rare): classes as unsigned 16-bit integers; the base and, of rare words, the tail
    without the logarithms of their counts."""
    spark = docs.sparkSession
    below = math.log10(lex.tokens + 0.1 * (lex.distinct + 1))
    shared = spark.sparkContext.broadcast((lex.words, lex.counts, lex.base(lex.counts), -np.log10(share)))  # FREQUENT words at most
    kind = type_of(docs, id_col)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), trained.alias("trained"), F.col(text_col).cast("string").cast("binary").alias("text"))

    def run(batches):
        words, counts, base, of_class = shared.value
        at = {w: i for i, w in enumerate(words)}
        first = len(words)
        ends = {}
        for batch in batches:
            n, known, total, tails, seqs, rare = [], [], [], [], [], []
            for text in batch.column(3).to_pylist():
                own = words_of(text)
                seq, others = list(map(at.get, own)), []
                if None in seq:
                    for i, x in enumerate(seq):
                        if x is None:
                            w = own[i]
                            others.append(w)
                            e = w[-2:]
                            k = ends.get(e)
                            if k is None:
                                k = ends[e] = first + ending(w)
                            seq[i] = k
                ids = np.array(seq, np.uint16)
                often = ids[ids < first]
                n.append(len(own))
                known.append(int((counts[often] > 0).sum()))
                total.append(float(base[often].sum()) - below * len(others))
                tails.append(float(of_class[ids[ids >= first] - first].sum()) if others else 0.0)
                seqs.append(ids.tobytes())
                rare.append(b" ".join(others))
            yield {"row": batch.column(0), "id": batch.column(1), "trained": batch.column(2), "n_tokens": n, "known": known, "base": total, "tail": tails, "seq": seqs, "rare": rare}

    return map_partitions(rows, run, {"row": "long", "id": kind, "trained": "boolean", "n_tokens": "long", "known": "long", "base": "double", "tail": "double", "seq": "binary", "rare": "binary"})


@dataclass
class Model:
    """``start``: of a text, and of a later segment; ``move``: states x states; ``emit``: classes x states. ``prior``: class
    frequencies, that emissions are smoothed towards."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    prior: np.ndarray

    def from_counts(self, starts: np.ndarray, moves: np.ndarray, emits: np.ndarray) -> "Model":
        starts, moves, emits = starts + 1, moves + 1, emits + PRIOR * self.prior[:, None]
        return Model(starts / starts.sum(axis=1, keepdims=True), moves / moves.sum(axis=1, keepdims=True), emits / emits.sum(axis=0), self.prior)


def initial(weights: np.ndarray, states: int, seed: int = 5) -> Model:
    """Frequencies with a random tilt per state."""
    rng = np.random.default_rng(seed)
    prior = (weights + 0.1) / (weights + 0.1).sum()
    emit = prior[:, None] * rng.uniform(0.5, 1.5, (len(weights), states))
    move = rng.uniform(0.5, 1.5, (states, states)) + 4 * np.eye(states)
    return Model(np.full((2, states), 1 / states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0), prior)


def expected(seqs: list[np.ndarray], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, moves and emissions of the sequences, and their log likelihood as segments.

    Arrays are (steps x segments) x states: a step is a run of rows, the emissions of a class lie together and are fetched at once, and
    all steps of a state are one sum by class. A class's emissions are divided by their sum, so forward values shrink by moves alone and
    are scaled once in ``GROUP`` steps. Rows of segments that have ended emit nothing.
    """
    K, C = model.move.shape[0], len(model.emit)
    starts, moves, emits, total = np.zeros((2, K)), np.zeros((K, K)), np.zeros((K, C + 1)), 0.0  # class C: after the end
    if not seqs:
        return starts, moves, emits[:, :C].T, total
    length = np.array([len(s) for s in seqs])
    pieces = -(-length // SEGMENT)
    place = (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * SEGMENT
    size = np.minimum(np.repeat(length, pieces) - place, SEGMENT)
    order = np.argsort(-size, kind="stable")
    begin, size, later = (np.repeat(np.cumsum(length) - length, pieces) + place)[order], size[order], (place > 0).astype(int)[order]
    flat = np.concatenate([*seqs, np.zeros(SEGMENT, np.uint16)])
    norm = model.emit.sum(axis=1)
    emit = np.zeros((C + 1, K))
    np.divide(model.emit, norm[:, None], out=emit[:C])
    move, back = np.ascontiguousarray(model.move), np.ascontiguousarray(model.move.T)
    most = min(BLOCK, len(size))
    high = int(size[0]) * most
    near, alpha, beta = np.empty((high, K)), np.empty((high, K)), np.empty((GROUP * most, K))
    for low in range(0, len(size), most):
        ends, again = size[low:low + most], later[low:low + most]
        T, B = int(ends[0]), len(ends)
        active = [*np.searchsorted(-ends, -np.arange(T), side="left").tolist(), 0]  # longest first: a prefix is active
        ids = np.lib.stride_tricks.sliding_window_view(flat, T)[begin[low:low + B]].T.astype(np.intp, order="C")
        if ends[-1] < T:
            ids[np.arange(T)[:, None] >= ends] = C
        ids = ids.ravel()
        at = [slice(t * B, (t + 1) * B) for t in range(T)]
        np.take(emit, ids, axis=0, out=near[:T * B], mode="clip")  # emissions, which meet what follows on the way back
        np.multiply(model.start[again], near[at[0]], out=alpha[at[0]])
        scale = {}
        for t in range(1, T):
            now = alpha[at[t]]
            np.matmul(alpha[at[t - 1]], move, out=now)
            now *= near[at[t]]
            if t % GROUP == 0:
                scale[t] = now.sum(axis=1, keepdims=True)
                scale[t][active[t]:] = 1
                now /= scale[t]
                total += float(np.log(scale[t]).sum())
        last = alpha[(ends - 1) * B + np.arange(B)].sum(axis=1, keepdims=True)
        total += float(np.log(last).sum())
        for begun in range((T - 1) // GROUP * GROUP, -1, -GROUP):
            done = min(T, begun + GROUP)
            for t in range(done - 1, begun - 1, -1):
                now = beta[at[t - begun]]
                if t + 1 < T:
                    np.matmul(near[at[t + 1]], back, out=now)
                else:
                    now[:] = 0
                if active[t + 1] < active[t]:  # these end here
                    now[active[t + 1]:active[t]] = 1 / last[active[t + 1]:active[t]]
                near[at[t]] *= now
                if t in scale:
                    near[at[t]] /= scale[t]
            to = max(begun, 1)
            moves += alpha[(to - 1) * B:(done - 1) * B].T @ near[to * B:done * B]
            alpha[begun * B:done * B] *= beta[:(done - begun) * B]  # what is left in its place are the states' shares
        for x in range(2):
            starts[x] += alpha[at[0]][again == x].sum(axis=0)
        for k in range(K):
            emits[k] += np.bincount(ids, alpha[:T * B, k], C + 1)
    emits = emits[:, :C].T
    return starts, moves * move, emits, total + float(emits.sum(axis=1) @ np.log(norm))


def baum_welch(rows: DataFrame, model: Model) -> tuple[Model, float]:
    """One round over all given sequences (column ``seq``): the new model, and the log likelihood of the old one. Expected counts
    are summed inside tasks, then over tasks, ``SLICE`` classes to a row."""
    K, C = model.move.shape[0], len(model.emit)
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        starts, moves, emits, total = np.zeros((2, K)), np.zeros((K, K)), np.zeros((K, C)).T, 0.0
        for batch in batches:
            a, b, c, d = expected([np.frombuffer(s, np.uint16) for s in batch.column(0).to_pylist()], m)
            starts, moves, emits, total = starts + a, moves + b, emits + c, total + d
        # one table: emissions, starts, moves and the likelihood
        table = np.concatenate([emits, starts, moves, np.full((1, K), total)])
        some = np.flatnonzero(table.any(axis=1))
        cuts = np.split(some, np.searchsorted(some, range(SLICE, len(table), SLICE)))
        kept = [(i, x) for i, x in enumerate(cuts) if len(x)]
        yield {"slice": [i for i, _ in kept], "place": [(x - i * SLICE).astype(np.uint16).tobytes() for i, x in kept], "counts": [table[x].tobytes() for _, x in kept]}

    def add(batches):
        held = {}
        for batch in batches:
            for i, place, counts in zip(*(c.to_pylist() for c in batch.columns)):
                if i not in held:
                    held[i] = np.zeros((SLICE, K))
                held[i][np.frombuffer(place, np.uint16)] += np.frombuffer(counts).reshape(-1, K)
        yield {"slice": list(held), "counts": [x.tobytes() for x in held.values()]}

    counted = map_partitions(rows.select("seq"), run, {"slice": "int", "place": "binary", "counts": "binary"})
    found = map_partitions(counted.repartition("slice"), add, {"slice": "int", "counts": "binary"}).collect()  # a number per class and state
    table = np.zeros((-(-(C + K + 3) // SLICE), SLICE, K))
    for r in found:
        table[r["slice"]] = np.frombuffer(r["counts"]).reshape(SLICE, K)
    emits, rest = np.split(table.reshape(-1, K), [C])
    new = model.from_counts(rest[:2], rest[2:2 + K], emits)
    return new, float(rest[2 + K, 0])


def log10_likelihood(seqs: list[np.ndarray], model: Model) -> np.ndarray:
    """Scaled forward recursion over whole sequences, all texts a step at a time, longest first."""
    size = np.array([len(s) for s in seqs])
    order = np.argsort(-size, kind="stable")
    flat, begin = np.concatenate(seqs).astype(np.int64), np.cumsum(size) - size
    begin, length = begin[order], size[order]
    active = np.searchsorted(-length, -np.arange(length[0]), side="left")
    out = np.zeros(len(seqs))
    a = model.start[0] * model.emit[flat[begin]]
    for t, n in enumerate(active.tolist()):
        if t:
            a = (a[:n] @ model.move) * model.emit[flat[begin[:n] + t]]
        s = a.sum(axis=1)
        a /= s[:, None]
        out[:n] += np.log10(s)
    result = np.empty(len(seqs))
    result[order] = out
    return result


def likelihoods(rows: DataFrame, model: Model) -> DataFrame:
    """(row, id, trained, n_tokens, known, base, score) without the logarithms of the counts of rare words."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    keep = {"row": "long", "id": type_of(rows, "id"), "trained": "boolean", "n_tokens": "long", "known": "long", "base": "double"}

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                seqs = [np.frombuffer(s, np.uint16) for s in batch.column(len(keep)).to_pylist()]
                yield {k: batch.column(i) for i, k in enumerate(keep)} | {"score": log10_likelihood(seqs, shared.value) + batch.column(len(keep) + 1).to_numpy()}

    return map_partitions(rows.select(*keep, "seq", "tail"), run, keep | {"score": "double"})


def learn(train: DataFrame, model: Model, tokens: int, rounds: int, start_rounds: int, least_gain: float) -> Model:
    """Baum-Welch over all of ``train`` in every round. A tilted start gains slowly at first, so ``start_rounds`` run in any case
    (at most ``rounds``); after them a round that gains less than ``least_gain`` nats per token is the last."""
    before = -math.inf
    for number in range(rounds):
        model, total = baum_welch(train, model)
        if number >= start_rounds and total - before < least_gain * tokens:
            break
        before = total
    return model


def fit_and_score(docs: DataFrame, usable: Column, states: int = 8, rounds: int = 13, frequent: int = FREQUENT, start_rounds: int = 6, least_gain: float = 0.002, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, trained, n_tokens, n_known, train_tokens, base_score, score) of every row, learned from the usable ones."""
    counts = materialise(count_words(docs.where(usable), text_col))
    lex, others, share = lexicon(counts, frequent)
    rows = materialise(encode(docs, lex, share, usable, id_col, text_col))
    model = initial(np.concatenate([lex.counts, lex.ending_tokens]), states)
    if lex.tokens:
        train = rows.where("trained").coalesce(-(-lex.tokens // TASK_TOKENS))
        model = learn(train, model, lex.tokens, rounds, start_rounds, least_gain)
    scored = likelihoods(rows, model)
    rare = rows.where(F.length("rare") > 0).select("row", F.explode(F.split(F.col("rare").cast("string"), " ")).alias("w")).select("row", F.col("w").cast("binary").alias("word"))
    parts = -(-lex.other_bytes // JOIN_BYTES)  # so many that a task can look its words up without sorting
    if parts > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        rare, others = rare.repartition(parts, "word"), others.repartition(parts, "word")
    met = rare.join(others.hint("shuffle_hash"), "word", "left").select("row", F.coalesce("c", F.lit(0)).alias("c"))
    added = met.groupBy("row").agg(F.sum((F.col("c") > 0).cast("long")).alias("known"), F.sum(F.log10(F.col("c") + 0.1)).alias("base")).withColumn("score", F.col("base"))
    none = [F.lit(None).cast(scored.schema[c].dataType).alias(c) for c in ("id", "trained", "n_tokens")]
    both = scored.unionByName(added.select("row", *none, "known", "base", "score"))
    out = both.groupBy("row").agg(F.max("id").alias(id_col), F.max("trained").alias("trained"), F.max("n_tokens").alias("n_tokens"), F.sum("known").alias("n_known"),
                                  F.lit(lex.tokens).cast("long").alias("train_tokens"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
    return out.drop("row")
