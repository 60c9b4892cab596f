"""Language ID, toxicity and the language model: held-out results, brute force, and defined results for odd rows."""

import math
import random
import tracemalloc
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import hmm_lm, language_id, toxicity
from riskloom.llm.common import divisible


def test_language_held_out(docs):
    found = language_id.identify(docs, ~divisible("doc_id", 5)).join(docs.select("doc_id", "lang"), "doc_id").where(divisible("doc_id", 5)).collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) > 0.95 and all(0 <= r.score <= 1 for r in found)


def test_tables_give_the_network(docs):
    rows = [(r.text.encode()[:256], r.lang) for r in docs.limit(60).collect()]
    net = language_id.train(rows, steps_=30)
    x = language_id.windows([t for t, _ in rows])[0]
    n = x.shape[1] - 3
    e = net.embed[x]
    want = np.concatenate([sum(e[:, k:k + n] @ f[k * 8:k * 8 + 8] for k in range(w)).max(axis=1) for w, f in zip(language_id.WIDTHS, net.filters)], axis=1)
    assert np.allclose(language_id.pooled(x, *net.tables(), net.shift.astype(np.float32)), np.maximum(want + net.shift, 0), atol=1e-3)


def test_language_odd(odd, none):
    found = language_id.identify(odd, ~divisible("doc_id", 5)).collect()
    assert len(found) == odd.count() and all(r.lang_pred == "und" and r.score == 0 for r in found if r.doc_id in (1, 2, 3))
    assert language_id.identify(none, F.lit(True)).count() == 0
    assert {r.lang_pred for r in language_id.predict(odd, None).collect()} == {"und"}


def test_toxicity_learns_and_ignores_identities(spark):
    rng, filler = random.Random(2), [f"w{i}x" for i in range(300)]
    rows = []
    for i in range(600):
        words = [rng.choice(filler) for _ in range(20)]
        toxic = i % 6 == 0
        if toxic:
            words[5] = rng.choice(["scum", "moron"])
        if rng.random() < (0.9 if toxic else 0.1):
            words[8] = rng.choice(["women", "muslims"])
        rows.append((" ".join(words[:10]) + ". " + " ".join(words[10:]) + ".", int(toxic)))
    fair, free = toxicity.train(rows), toxicity.train(rows, penalty=0.0)
    margin = lambda m, text: math.log(m.score(text) / (1 - m.score(text)))
    change = lambda m: max(abs(margin(m, f"w1x {a}") - margin(m, f"w1x {b}")) for g in toxicity.IDENTITIES for a in g for b in g)
    assert change(fair) < 0.7 * change(free)
    assert all(fair.score(f"w1x w2x {t} w3x w4x.") < 0.5 for g in toxicity.IDENTITIES for t in g)
    assert all(fair.score(f"w1x w2x {w} w3x.") >= 0.5 for w in ("scum", "moron"))


@pytest.mark.parametrize("tenths", [1, 5, 8])
def test_toxicity_learns_at_any_share_of_toxic_labels(spark, tenths):
    rng, filler = random.Random(3), [f"w{i}x" for i in range(300)]
    rows = []
    for i in range(600):
        words = [rng.choice(filler) for _ in range(20)]
        if i % 10 < tenths:
            words[5] = rng.choice(["scum", "moron"])
        elif i % 10 == 9 and rng.random() < 0.1:
            words[5] = "scum"  # a few clean documents have the word, too
        rows.append((i, " ".join(words[:10]) + ". " + " ".join(words[10:]) + ".", int(i % 10 < tenths)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.learn(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"), F.lit(True))
    for m in (model, toxicity.train([r[1:] for r in rows])):
        assert all(m.score(f"w1x w2x {w} w3x.") >= 0.5 for w in ("scum", "moron"))
        assert np.mean([m.score(f"w{k}x w{k + 1}x w{k + 2}x w{k + 3}x.") < 0.5 for k in range(290)]) > 0.95


def test_toxicity_odd(spark, odd, none, small):
    labels = spark.createDataFrame([(4, 1), (4, 1), (6, 0), (7, None), (99, 1)], "doc_id long, toxic int")
    found = toxicity.classify(odd, labels, F.lit(True)).collect()
    assert len(found) == odd.count() and all(0 <= r.score <= 1 for r in found)
    assert {r.score for r in toxicity.classify(odd, labels.where("false"), F.lit(True)).collect()} == {0.0}
    assert toxicity.classify(none, labels, F.lit(True)).count() == 0 and toxicity.keep(none, None).count() == 0
    assert toxicity.keep(odd, toxicity.Classifier(5.0)).count() == 0 and toxicity.keep(odd, toxicity.Classifier(-5.0)).columns == odd.columns


def test_forward_is_the_sum_over_all_paths():
    rng = np.random.default_rng(3)
    K, C = 3, 5
    norm = lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    m = hmm_lm.Model(norm(rng.random((2, K)), 1), norm(rng.random((K, K)), 1), norm(rng.random((C, K)), 0), np.full(C, 0.2))
    seqs = [rng.integers(0, C, n).astype(np.uint16) for n in (1, 4, 2, 5)]
    for s, got in zip(seqs, hmm_lm.log10_likelihood(seqs, m)):
        want = sum(m.start[0, z[0]] * np.prod([m.emit[x, k] for x, k in zip(s, z)]) * np.prod([m.move[a, b] for a, b in zip(z, z[1:])]) for z in product(range(K), repeat=len(s)))
        assert math.isclose(got, math.log10(want), rel_tol=1e-9)
    starts, moves, emits, total = hmm_lm.expected(seqs, m)
    assert math.isclose(emits.sum(), sum(map(len, seqs))) and math.isclose(moves.sum(), sum(len(s) - 1 for s in seqs)) and math.isclose(starts.sum(), len(seqs))
    assert math.isclose(total / math.log(10), hmm_lm.log10_likelihood(seqs, m).sum(), rel_tol=1e-9)


def step_by_step(seqs, m, segment):
    """Expected counts a segment at a time, every step scaled."""
    K = len(m.move)
    starts, moves, emits, total = np.zeros((2, K)), np.zeros((K, K)), np.zeros((len(m.emit), K)), 0.0
    for s in seqs:
        for low in range(0, len(s), segment):
            x = s[low:low + segment]
            alpha, scale = [m.start[int(low > 0)] * m.emit[x[0]]], []
            for t in range(len(x)):
                if t:
                    alpha.append((alpha[-1] @ m.move) * m.emit[x[t]])
                scale.append(alpha[-1].sum())
                alpha[-1] = alpha[-1] / scale[-1]
            beta = np.ones(K)
            for t in range(len(x) - 1, -1, -1):
                emits[x[t]] += alpha[t] * beta
                if t:
                    near = beta * m.emit[x[t]] / scale[t]
                    moves += np.outer(alpha[t - 1], near) * m.move
                    beta = m.move @ near
                else:
                    starts[int(low > 0)] += alpha[0] * beta
            total += np.log(scale).sum()
    return starts, moves, emits, total


@pytest.mark.parametrize("block, group", [(512, 8), (3, 8), (2, 1), (5, 200)])
def test_expected_counts_at_any_block_and_group(monkeypatch, block, group):
    """Segments of all lengths, classes of 1e-12, and moves that are all but ruled out: the counts of steps that are scaled one by one."""
    rng, norm = np.random.default_rng(4), lambda x, axis: x / x.sum(axis=axis, keepdims=True)
    K, C = 4, 30
    m = hmm_lm.Model(norm(rng.random((2, K)), 1), norm(rng.random((K, K)) ** 40 + 1e-9, 1), norm(10.0 ** rng.uniform(-12, 0, (C, K)), 0), np.full(C, 1 / C))
    seqs = [rng.integers(0, C, n).astype(np.uint16) for n in (1, 2, 7, 8, 9, 16, 127, 128, 129, 300, 64, 1, 257, 128)]
    monkeypatch.setattr(hmm_lm, "BLOCK", block)
    monkeypatch.setattr(hmm_lm, "GROUP", min(group, 16))
    for got, want in zip(hmm_lm.expected(seqs, m), step_by_step(seqs, m, hmm_lm.SEGMENT)):
        assert np.allclose(got, want, rtol=1e-9, atol=1e-12)
    assert all(not np.any(x) for x in hmm_lm.expected([], m))


def test_rounds_work_in_little_memory():
    """What a round passes over again and again stays in a cache that workers share: under 12 MB for some 300,000 tokens (before: 28)."""
    rng = np.random.default_rng(7)
    m = hmm_lm.initial(np.ones(300), 8)
    seqs = [rng.integers(0, 300, 512).astype(np.uint16) for _ in range(600)]
    tracemalloc.start()
    try:
        hmm_lm.expected(seqs, m)
        assert tracemalloc.get_traced_memory()[1] < 12 << 20
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("frequent", [20, 40_000])
def test_base_scores(docs, frequent):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    words = {i: hmm_lm.words_of((t or "").encode()) for i, t in rows}
    trained = {i for i in words if zlib.crc32(str(i).encode()) % 10}
    c = Counter(w for i in trained for w in words[i])
    N, V = sum(c.values()), len(c)
    found = {r.doc_id: r for r in hmm_lm.fit_and_score(docs, ~divisible("doc_id", 10), states=3, start_rounds=3, frequent=frequent).collect()}
    assert found.keys() == words.keys()
    for i, w in words.items():
        r = found[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.trained) == (len(w), sum(c[x] > 0 for x in w), N, i in trained)
        assert math.isclose(r.base_score, sum(math.log10((c[x] + 0.1) / (N + 0.1 * (V + 1))) for x in w), rel_tol=1e-9)
        assert r.score < 0


def test_language_model_odd(odd, none):
    found = hmm_lm.fit_and_score(odd, ~divisible("doc_id", 10), states=2, start_rounds=1).collect()
    assert len(found) == odd.count() and all(r.score < 0 for r in found)
    assert {r.n_tokens for r in found if r.doc_id in (1, 2, 3)} == {1}
    assert hmm_lm.fit_and_score(none, F.lit(True), states=2).count() == 0
    assert hmm_lm.fit_and_score(odd, F.lit(False), states=2).count() == odd.count()


def test_every_round_reads_all_training_texts(spark):
    """The same scores as rounds over all sequences at once, with more texts than any sample held."""
    rng = random.Random(6)
    texts = [" ".join(rng.choices([f"{t}{k}" for k in range(12)], k=rng.randint(3, 9))) for t in ("ab", "cd", "ef") for _ in range(700)]
    c = Counter(w for t in texts for w in hmm_lm.words_of(t.encode()))
    order = sorted(c, key=lambda w: (-c[w], w))
    seqs = [np.array([order.index(w) for w in hmm_lm.words_of(t.encode())], np.uint16) for t in texts]
    model = hmm_lm.initial(np.array([c[w] for w in order] + [0] * hmm_lm.ENDINGS, float), 3)
    for _ in range(5):
        model = model.from_counts(*hmm_lm.expected(seqs, model)[:3])
    found = hmm_lm.fit_and_score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5), F.lit(True), states=3, rounds=5, start_rounds=5)
    want = hmm_lm.log10_likelihood(seqs, model)
    assert all(math.isclose(r.score, want[r.doc_id], rel_tol=1e-9) for r in found.collect())


def test_counts_of_a_round_meet_in_slices(spark, monkeypatch):
    """The same model whatever the slices, with tasks that have not met all classes."""
    rng = np.random.default_rng(8)
    seqs = [rng.integers(k, k + 9, n).astype(np.uint16) for k, n in zip(range(0, 30, 3), (1, 4, 90, 200, 3, 5, 140, 2, 33, 128))]
    model = hmm_lm.initial(np.ones(40), 3)
    rows = spark.createDataFrame([(bytearray(x.tobytes()),) for x in seqs], "seq binary").repartition(4)
    *counts, total = hmm_lm.expected(seqs, model)
    want = model.from_counts(*counts)
    for size in (7, 43, 4096):
        monkeypatch.setattr(hmm_lm, "SLICE", size)
        new, got = hmm_lm.baum_welch(rows, model)
        assert math.isclose(got, total, rel_tol=1e-12)
        assert all(np.allclose(getattr(new, f), getattr(want, f), rtol=1e-12, atol=0) for f in ("start", "move", "emit"))


@pytest.mark.parametrize("join_bytes", [16 << 20, 64])
def test_rare_words_look_up_their_counts(spark, monkeypatch, join_bytes):
    """Scores of words outside the frequent ones, known and unknown; no sort in their join, and small tables in few tasks of a round."""
    monkeypatch.setattr(hmm_lm, "JOIN_BYTES", join_bytes)
    learned, learn = [], hmm_lm.learn
    monkeypatch.setattr(hmm_lm, "learn", lambda train, *more: learned.append((train.rdd.getNumPartitions(), learn(train, *more))) or learned[-1][1])
    rng = random.Random(9)
    texts = [" ".join(rng.choices([f"w{k}" for k in range(60)], k=rng.randint(0, 30))) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(40)
    out = hmm_lm.fit_and_score(docs, F.col("doc_id") < 20, states=2, rounds=2, frequent=9)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
    (tasks, model), words = learned[0], [hmm_lm.words_of(t.encode()) for t in texts]
    assert tasks == 1
    c = Counter(w for x in words[:20] for w in x)
    often = sorted(c, key=lambda w: (-c[w], w))[:9]
    per = {e: [c[w] for w in c if w not in often and hmm_lm.ending(w) == e] for e in range(hmm_lm.ENDINGS)}
    N, V = sum(c.values()), len(c)
    for r in out.collect():
        own = words[r.doc_id]
        seq = np.array([often.index(w) if w in often else len(often) + hmm_lm.ending(w) for w in own], np.uint16)
        share = [math.log10((c[w] + 0.1) / (sum(x) + 0.1 * (len(x) + 1))) for w in own if w not in often for x in [per[hmm_lm.ending(w)]]]
        assert math.isclose(r.score, hmm_lm.log10_likelihood([seq], model)[0] + sum(share), rel_tol=1e-9)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.1) / (N + 0.1 * (V + 1))) for w in own), rel_tol=1e-9)
        assert r.n_known == sum(c[w] > 0 for w in own)
