"""Near-duplicate groups against all pairs; signatures against the plain algorithm."""

import random
from collections import Counter

import numpy as np
import pytest

from riskloom.llm import near_dedup, shingles


def brute(rows, k, percent=80):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (i, _) in enumerate(rows):
        for y, (j, _) in enumerate(rows[:x]):
            a, b = sets[x], sets[y]
            if a and b and i is not None and j is not None and 100 * len(a & b) >= percent * len(a | b):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q) if p != q else parent[max(p, q)]
    return Counter((i, len(s), find(i) if i is not None else None, find(i) == i if i is not None else True) for (i, _), s in zip(rows, sets))


@pytest.fixture(scope="module")
def chains(spark):
    """A base text in 150 versions that drift apart, so that links form chains; and texts that share a passage only."""
    rng, words = random.Random(8), [f"w{i}" for i in range(400)]
    base, rows = [rng.choice(words) for _ in range(120)], []
    for i in range(150):
        if i % 3 == 0:
            base = list(base)
            base[rng.randrange(120)] = rng.choice(words)
        other = list(base)
        for _ in range(rng.randrange(6)):
            other[rng.randrange(120)] = rng.choice(words)
        rows.append((1000 - i, " ".join(other)))
    shared = " ".join(rng.choice(words) for _ in range(60))
    rows += [(2000 + i, shared + " " + " ".join(rng.choice(words) for _ in range(40))) for i in range(60)]
    rows += [(3000 + i, rows[5][1].upper()) for i in range(20)]
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("words", [2, 5])
@pytest.mark.parametrize("block", [None, 20])
def test_groups_match_all_pairs(chains, words, block, monkeypatch):
    if block:
        monkeypatch.setattr(near_dedup, "BLOCK_ROWS", block)
    found = near_dedup.near_groups(chains, words).collect()
    assert Counter(map(tuple, found)) == brute([tuple(r) for r in chains.collect()], words)


def test_odd_rows(odd, none):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert Counter(map(tuple, near_dedup.near_groups(odd, 2).collect())) == brute(rows, 2)
    assert near_dedup.near_groups(none, 2).count() == 0
    kept = near_dedup.keep_first(odd, 2)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {None, 1, 2, 3, 4, 5, 7, 8}


def test_documents(docs):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert Counter(map(tuple, near_dedup.near_groups(docs, 2).collect())) == brute(rows, 2)


def test_signature_is_the_plain_algorithm():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (0, 1, 2, 7, 40, 300)]
    found = shingles.super_minhash(sets, 36)
    for s, sig in zip(sets, found):
        want = [shingles.EMPTY] * 36
        for h in s:
            p = list(range(36))
            for j in range(36):
                z = int(shingles.mix(np.array([h]) + shingles.U((j + 1) * int(shingles.GOLD) % 2**64))[0])
                k = j + ((z & 0xFFFFFFFF) * (36 - j) >> 32)
                p[j], p[k] = p[k], p[j]
                want[p[j]] = min(want[p[j]], shingles.U(j << 32 | z >> 32))
        assert list(sig) == want


def test_signature_estimates_similarity():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 500).astype(np.uint64)
    b = np.concatenate([a[:400], rng.integers(0, 2**63, 100).astype(np.uint64)])
    s = shingles.super_minhash([np.unique(a), np.unique(b)], 288)
    assert abs((s[0] == s[1]).mean() - 400 / 600) < 0.1


def test_one_python_worker_per_task(spark, monkeypatch):
    """Links are contracted where they are found: a second Python step in a task would hold a second worker, and its memory."""
    plans, write = [], near_dedup.materialise
    monkeypatch.setattr(near_dedup, "materialise", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or write(df))
    near_dedup.near_groups(spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i % 2, 60))) for i in range(6)], "doc_id long, text string")).count()
    assert plans and max(p.count("MapInArrow ") for p in plans) == 1
