"""Toxicity by a classifier over sentences that is trained to ignore identity terms.

A document is as toxic as its worst sentence. A sentence is the set of its words and of the beginnings of longer words (so that
families of words are learned), and logistic regression weighs them. Labels are given for documents, so each round of training
takes the sentences of a toxic document that the last round found worst as examples, and all sentences of a clean one. In every labelled sentence that names an identity, the term is swapped for the others of its group and for a neutral word, and
the squared change of the score is a penalty: a neutral mention then cannot raise the score. An L1 penalty of ``evidence``
quarter documents removes words that a few labels put there by chance, and only features that the toxic documents have at least
twice as often as the clean ones, as rates of each class, are weighed at all (identity terms always are). Rates do not depend on
the share of toxic labels.

Training reads labelled rows only, at most ``most_documents`` (by hash of the id). Scoring reads the text alone, all of it.

Defined results: a null or empty text has the score of a sentence without known words. Labels that are null teach nothing;
without labels every score is 0. Rows that repeat an id are scored each for itself; a label that repeats counts once per
distinct value. Other columns are not read. An empty table gives an empty result. A score of exactly 0.5 counts as toxic.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import keep_rows, map_batches, type_of
from riskloom.session import materialise

SENTENCE, WORD = re.compile(r"[.!?\n]+"), re.compile(r"\w+")
#: Groups of terms that may stand for each other in a neutral sentence.
IDENTITIES = (("women", "men"), ("woman", "man"), ("girls", "boys"), ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
              ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"), ("black", "white", "asian", "latino"),
              ("gay", "straight", "lesbian", "bisexual", "transgender"), ("immigrants", "refugees", "natives"), ("disabled", "deaf", "blind"))


NEUTRAL = "people"
#: Lengths of beginnings that are features of longer words; the mark tells them from words.
STEMS, MARK = range(3, 9), "\u2026"


def features(word: str) -> list[str]:
    return [word] + [word[:k] + MARK for k in STEMS if len(word) > k]


@dataclass
class Classifier:
    bias: float
    weights: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        self.heads = {f[:3] for f in self.weights}  # a word that begins otherwise has no weight

    def score(self, text: str | None) -> float:
        best = -math.inf
        if text:
            weights, heads = self.weights, self.heads
            for s in SENTENCE.split(text.lower()):
                words = {w for w in WORD.findall(s) if w[:3] in heads}
                z = sum(weights.get(f, 0.0) for f in {f for w in words for f in features(w)}) if words else 0.0
                best = max(best, z)
        return logistic(self.bias + (best if best > -math.inf else 0.0))


def logistic(z: float) -> float:
    return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def sentences_of(text: str | None) -> list[frozenset[str]]:
    """The distinct sentences of a text as sets of words, in a fixed order; one empty sentence where there is none."""
    return [frozenset(x) for x in sorted(map(sorted, {frozenset(WORD.findall(s)) for s in SENTENCE.split((text or "").lower())}))] or [frozenset()]


def swaps(present: frozenset[str], groups=IDENTITIES) -> list[frozenset[str]]:
    """The sentence's features with each identity term replaced by the others of its group, and by a neutral word."""
    return [present - set(features(term)) | set(features(other)) for group in groups for term in group if term in present for other in (*group, NEUTRAL) if other != term]


def count_features(rows: list[tuple[str | None, int]]) -> dict[str, list[int]]:
    """Feature -> [toxic documents that have it, documents that have it]."""
    have: dict[str, list[int]] = {}
    for text, label in rows:
        for f in {f for w in frozenset().union(*sentences_of(text)) for f in features(w)}:
            c = have.setdefault(f, [0, 0])
            c[0] += label == 1
            c[1] += 1
    return have


def telling(toxic: int | Column, all_: int | Column, base: float, evidence: float):
    """Whether a feature in so many toxic and so many documents is weighed, where ``base`` of the documents are toxic. Without clean
    documents no rate can be compared, and all frequent enough features are."""
    return (toxic > evidence) & (toxic * (1 - base) >= 2 * base * (all_ - toxic))


def reduced(text: str | None, kept: set[str]) -> dict[frozenset[str], int]:
    """A document's sentences by the features that are weighed, with how many sentences each stands for."""
    out: dict[frozenset[str], int] = {}
    for words in sentences_of(text):
        key = frozenset(f for w in words for f in features(w) if f in kept)
        out[key] = out.get(key, 0) + 1
    return out


def always_kept(groups) -> set[str]:
    return {t for g in groups for t in g}


def train(rows: list[tuple[str | None, int]], groups=IDENTITIES, penalty: float = 0.05, evidence: float = 2.0) -> Classifier | None:
    """``rows``: (text, 0 or 1)."""
    if not rows:
        return None
    base = sum(y for _, y in rows) / len(rows)
    kept = {f for f, (a, b) in count_features(rows).items() if telling(a, b, base, evidence)} | always_kept(groups)
    return fit([(reduced(t, kept), y) for t, y in rows], groups, penalty, evidence)


def fit(rows: list[tuple[dict[frozenset[str], int], int]], groups=IDENTITIES, penalty: float = 0.05, evidence: float = 2.0, rounds: int = 4, steps: int = 150) -> Classifier | None:
    """Proximal gradient steps with momentum on reduced documents; the step length comes from the steepest direction."""
    if not rows:
        return None
    label, n = np.array([y for _, y in rows], float), len(rows)
    sentences, owner, times = [], [], []
    for i, (own, _) in enumerate(rows):
        for key in sorted(own, key=sorted):
            sentences.append(key)
            owner.append(i)
            times.append(own[key])
    pairs = [(k, x) for k, present in enumerate(sentences) for x in swaps(present, groups)]
    place = {f: k for k, f in enumerate(sorted(frozenset().union(*sentences, *(x for _, x in pairs))))}
    m, owner, times = len(sentences), np.array(owner), np.array(times, float)
    toxic, size = label[owner] == 1, np.bincount(owner, times, n)

    def matrix(sets):
        return np.array([(k, place[f]) for k, present in enumerate(sets) for f in sorted(present)], np.int64).reshape(-1, 2).T

    row, col = matrix(sentences)
    pair_row, pair_col = matrix([x for _, x in pairs])
    origin = np.array([k for k, _ in pairs], np.int64)
    w, b = np.zeros(len(place)), math.log((label.sum() + 0.5) / (n - label.sum() + 0.5))

    def margins(x):
        return np.bincount(row, x[col], m)

    def sums(x):
        return np.bincount(col, x[row], len(w))

    def pull(x):
        """Gradient of the penalty on score changes."""
        if not len(origin):
            return 0.0
        change = 2 * penalty / len(origin) * (margins(x)[origin] - np.bincount(pair_row, x[pair_col], len(origin)))
        return sums(np.bincount(origin, change, m)) - np.bincount(pair_col, change[pair_row], len(w))

    for round_ in range(rounds if len(w) else 0):
        odds = margins(w)  # as logarithms: a probability near 1, as where most labels are toxic, would tell no sentences apart
        top = np.full(n, -np.inf)
        np.maximum.at(top, owner, odds)
        weight = times / size[owner]
        if round_:
            worst = np.where(toxic, (odds >= top[owner] - math.log(2)) * times, 0.0)
            share = np.bincount(owner, worst, n)[owner]
            weight = np.where(toxic, worst / np.where(share > 0, share, 1), weight)  # a toxic document counts once, by its worst sentences
        weight /= n
        y = toxic.astype(float)
        v, steep = np.ones(len(w)), 0.0
        for _ in range(20):
            v = 0.25 * sums(weight * margins(v)) + pull(v)
            steep = float(np.linalg.norm(v))
            v = v / steep if steep else v
        rate = 1 / (1.2 * steep + 0.25 * weight.sum() + 1e-9)
        near_w, near_b, t = w.copy(), b, 1.0
        for _ in range(steps):
            z = margins(near_w)
            g = weight * (1 / (1 + np.exp(-np.clip(z + near_b, -500, 500))) - y)
            new = near_w - rate * (sums(g) + pull(near_w))
            new = np.sign(new) * np.maximum(np.abs(new) - rate * evidence / (4 * n), 0)
            new_b, t2 = near_b - rate * g.sum(), (1 + math.sqrt(1 + 4 * t * t)) / 2
            near_w, near_b = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b)
            w, b, t = new, new_b, t2
    return Classifier(float(b), {f: float(w[i]) for f, i in place.items() if w[i]})


def learn(docs: DataFrame, labels: DataFrame, usable: Column, most_documents: int = 5000, groups=IDENTITIES, penalty: float = 0.05, evidence: float = 2.0,
          id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Classifier | None:
    """Train on a bounded sample of labelled texts.

    The ids are chosen among the labels first, so that only chosen texts travel. Tasks count the features and reduce sentences to
    the telling ones; the driver gets the telling features and the reduced sentences of at most ``most_documents`` documents.
    """
    chosen = labels.where(usable & F.col(label_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("label")).distinct()
    chosen = chosen.orderBy(F.xxhash64("__id"), "__id", "label").limit(most_documents)
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), F.col(id_col) == F.col("__id")).select("text", "label")
    rows = materialise(rows)
    n, positive = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not n:
        return None

    def count(batch):
        have = count_features(list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())))
        return {"f": list(have), "a": [c[0] for c in have.values()], "b": [c[1] for c in have.values()]}

    totals = map_batches(rows, count, {"f": "string", "a": "long", "b": "long"}).groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    kept = {r.f for r in totals.where(telling(F.col("a"), F.col("b"), positive / n, evidence)).select("f").collect()} | always_kept(groups)
    shared = docs.sparkSession.sparkContext.broadcast(kept)

    def cut(batch):
        found = [reduced(t, shared.value) for t in batch.column(0).to_pylist()]
        return {"label": batch.column(1), "sets": [[" ".join(sorted(s)) for s in x] for x in found], "times": [list(x.values()) for x in found]}

    taken = map_batches(rows, cut, {"label": "int", "sets": "array<string>", "times": "array<long>"}).collect()
    small = [({frozenset(s.split()): k for s, k in zip(r.sets, r.times)}, r.label) for r in taken]
    small.sort(key=lambda x: (x[1], sorted((sorted(s), k) for s, k in x[0].items())))
    return fit(small, groups, penalty, evidence)


def score(docs: DataFrame, model: Classifier | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most the words of the bounded sample

    def run(batch):
        m = shared.value
        return {id_col: batch.column(0), "score": [m.score(t) if m else 0.0 for t in batch.column(1).to_pylist()]}

    return map_batches(docs.select(F.col(id_col), F.col(text_col).cast("string")), run, {id_col: type_of(docs, id_col), "score": "double"})


def keep(docs: DataFrame, model: Classifier | None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that are not toxic, with all their columns. Without a model all stay."""
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return keep_rows(docs, text_col, lambda texts: [shared.value.score(t) < threshold for t in texts])


def classify(docs: DataFrame, labels: DataFrame, usable: Column, most_documents: int = 5000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Train on the usable labels, then score all rows."""
    return score(docs, learn(docs, labels, usable, most_documents, id_col=id_col, text_col=text_col, label_col=label_col), id_col, text_col)
