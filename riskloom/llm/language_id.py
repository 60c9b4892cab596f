"""Language identification by a convolutional network over bytes.

Bytes are embedded, filters of several widths run over them, each filter keeps its largest response (max pooling), and softmax
over a linear layer gives the languages. The network is trained here in numpy on labelled text. A text is cut into windows of a
fixed length that cover all of it; windows are scored in batches, and a text's probabilities are the mean of its windows',
weighted by their bytes.

For scoring, embedding and filters are folded into tables over pairs of bytes, which gives the same numbers.

Training reads labelled rows only, at most ``per_language`` documents of each language (by hash of the id), and from each at
most ``crops`` windows. Prediction uses the text alone.

Defined results: a text that is null or has no letter is ``und`` with score 0. Rows with a null language teach nothing. Without
labelled rows everything is ``und``. Rows that repeat an id are predicted each for itself; other columns are not read. An empty
table gives an empty result. Ties between languages go to the alphabetically first.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import STEP_BYTES, keep_rows, map_batches, steps, type_of, unused

WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4), 12, 8
LATIN = re.compile("[A-Za-z]")


@dataclass
class Network:
    """``embed`` 256 x E; ``filters[w]`` (w*E) x F; ``out`` (widths*F + 1) x languages, the last row being the bias."""

    languages: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    shift: np.ndarray
    out: np.ndarray

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Responses of the first two bytes and of the bytes after them, by pair of bytes."""
        E, n = self.embed.shape[1], 256
        first, second = np.zeros((n, n, len(WIDTHS) * FILTERS), np.float32), np.zeros((n, n, (len(WIDTHS) - 1) * FILTERS), np.float32)
        for j, (w, f) in enumerate(zip(WIDTHS, self.filters)):
            part = [self.embed @ f[k * E:(k + 1) * E] for k in range(w)]
            first[:, :, j * FILTERS:(j + 1) * FILTERS] = part[0][:, None] + part[1][None]
            if w == 3:
                second[:, :, :FILTERS] = part[2][:, None]
            if w == 4:
                second[:, :, FILTERS:] = part[2][:, None] + part[3][None]
        return first.reshape(n * n, -1), second.reshape(n * n, -1)


def windows(texts: list[bytes], length: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows x length bytes, text of each window, its bytes of text). Windows follow each other; the last is filled with blanks."""
    count = np.array([max(1, -(-len(t) // length)) for t in texts])
    flat = b"".join(t + b" " * (c * length - len(t)) for t, c in zip(texts, count.tolist()))
    of = np.repeat(np.arange(len(texts)), count)
    place = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    size = np.clip(np.array([len(t) for t in texts])[of] - place * length, 1, length)
    return np.frombuffer(flat, np.uint8).reshape(-1, length), of, size


def pooled(x: np.ndarray, first: np.ndarray, second: np.ndarray, shift: np.ndarray) -> np.ndarray:
    pair = x[:, :-1].astype(np.intp) << 8 | x[:, 1:]
    n = x.shape[1] - max(WIDTHS) + 1
    out = np.empty((len(x), first.shape[1]), np.float32)
    for i in range(0, len(x), 64):  # a block stays in the processor's cache
        r = first[pair[i:i + 64, :n]]
        r[:, :, FILTERS:] += second[pair[i:i + 64, 2:2 + n]]
        r.max(axis=1, out=out[i:i + 64])
    return np.maximum(out + shift, 0)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(rows: list[tuple[bytes, str]], steps_: int = 900, batch: int = 64, rate: float = 0.004, seed: int = 7) -> Network | None:
    """Adam on cross-entropy over windows; every second window is shortened, so that short texts are learned too."""
    languages = sorted({lang for _, lang in rows})
    if not languages:
        return None
    rng, pick = np.random.default_rng(seed), random.Random(seed)
    by_language: dict[str, list[bytes]] = {k: [] for k in languages}
    for i, (text, lang) in enumerate(sorted(rows)):
        by_language[lang].append(text[:WINDOW] if i % 2 == 0 else text[:pick.randint(8, 120)])
    x = [windows(by_language[k])[0] for k in languages]
    net = Network(languages, rng.normal(0, 0.5, (256, EMBED)), [rng.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS)) for w in WIDTHS],
                  np.zeros(len(WIDTHS) * FILTERS), np.zeros((len(WIDTHS) * FILTERS + 1, len(languages))))
    parts = [net.embed, *net.filters, net.shift, net.out]
    mean, square = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    n = WINDOW - max(WIDTHS) + 1
    for t in range(1, steps_ + 1):
        y = rng.integers(len(languages), size=batch)  # languages in equal shares
        b = np.stack([x[k][rng.integers(len(x[k]))] for k in y])
        e = net.embed[b]
        responses, best = [], []
        for w, f in zip(WIDTHS, net.filters):
            r = sum(e[:, k:k + n] @ f[k * EMBED:(k + 1) * EMBED] for k in range(w))
            best.append(r.argmax(axis=1))
            responses.append(r.max(axis=1))
        h = np.concatenate(responses, axis=1) + net.shift
        a = np.concatenate([np.maximum(h, 0), np.ones((batch, 1))], axis=1)
        d = softmax(a @ net.out)
        d[np.arange(batch), y] -= 1
        d /= batch
        back = (d @ net.out[:-1].T) * (h > 0)
        g_embed, g_filters = np.zeros_like(net.embed), []
        for j, (w, f) in enumerate(zip(WIDTHS, net.filters)):
            near = b[np.arange(batch)[:, None, None], best[j][:, :, None] + np.arange(w)]  # bytes under each filter's best place
            up = back[:, j * FILTERS:(j + 1) * FILTERS]
            patch = net.embed[near].reshape(batch, FILTERS, w * EMBED)
            g_filters.append(np.einsum("bfe,bf->ef", patch, up))
            np.add.at(g_embed, near, (up[:, :, None] * f.T[None]).reshape(batch, FILTERS, w, EMBED))
        grads = [g_embed, *g_filters, back.sum(axis=0), a.T @ d + 1e-4 * net.out]
        for p, g, m, s in zip(parts, grads, mean, square):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            p -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(s / (1 - 0.999 ** t)) + 1e-8)
    return net


def has_letter(text: str | None) -> bool:
    return bool(text) and (LATIN.search(text) is not None or any(map(str.isalpha, text)))


def labelled(docs: DataFrame, usable: Column, per_language: int, crops: int = 4, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[bytes, str]]:
    """A bounded sample of labelled rows as windows of text. The ids are chosen first; the chosen texts are cut at ``crops`` places
    (by hash of the id, anywhere in the whole text) inside the tasks, so that only windows travel."""
    ids = docs.where(usable & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    [chosen] = unused(docs, "__chosen")
    ids = ids.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language).select(F.col("id").alias(chosen)).distinct()
    # at most per_language ids of each language
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).join(F.broadcast(ids), F.col(id_col) == F.col(chosen))
    text = F.col(text_col).cast("string")
    places = [F.pmod(F.xxhash64(F.col(id_col), F.lit(i)), F.greatest(F.char_length(text) - WINDOW + 1, F.lit(1))) + 1 for i in range(crops)]
    cut = F.array_distinct(F.array(*[F.substring(text, p.cast("int"), F.lit(WINDOW)) for p in places]))
    taken = rows.select(F.explode(cut).alias("t"), F.col(lang_col).alias("l")).collect()
    return [(r.t.encode(), r.l) for r in taken if has_letter(r.t)]


def judge(texts: list[str | None], net: Network | None, tables) -> tuple[list[str], list[float]]:
    """Language and score of whole texts."""
    lang, score = ["und"] * len(texts), [0.0] * len(texts)
    ok = [i for i, t in enumerate(texts) if has_letter(t)] if net else []
    raw = [texts[i].encode() for i in ok]
    for a, b in steps(raw, STEP_BYTES // 2):
        x, of, size = windows(raw[a:b])
        p = softmax(pooled(x, *tables, net.shift.astype(np.float32)) @ net.out[:-1] + net.out[-1])
        total = np.zeros((b - a, p.shape[1]))
        np.add.at(total, of, p * size[:, None])
        total /= total.sum(axis=1, keepdims=True)
        for i, k in enumerate(total.argmax(axis=1).tolist()):
            lang[ok[a + i]], score[ok[a + i]] = net.languages[k], float(min(1.0, total[i, k]))
    return lang, score


def predict(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row; whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast((net, net.tables() if net else None))  # a few MB, whatever the corpus

    def run(batch):
        lang, score = judge(batch.column(1).to_pylist(), *shared.value)
        return {id_col: batch.column(0), "lang_pred": lang, "score": score}

    schema = {id_col: type_of(docs, id_col), "lang_pred": "string", "score": "double"}
    return map_batches(docs.select(F.col(id_col), F.col(text_col).cast("string")), run, schema)


def keep(docs: DataFrame, net: Network, least: float, text_col: str = "text") -> DataFrame:
    """The rows in some language with that probability or more, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast((net, net.tables()))

    def likely(texts):
        return [k != "und" and s >= least for k, s in zip(*judge(texts, *shared.value))]

    return keep_rows(docs, text_col, likely)


def identify(docs: DataFrame, usable: Column, per_language: int = 400, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Train on the usable labelled rows, then predict all rows."""
    return predict(docs, train(labelled(docs, usable, per_language, id_col=id_col, text_col=text_col, lang_col=lang_col)), id_col, text_col)
