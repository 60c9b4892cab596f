"""Lyndon lengths, runs and collapsed texts against brute force."""

import hashlib
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from riskloom.llm import periodic_runs
from riskloom.llm.queries import op11_periodic_runs


def brute_lengths(ranks):
    out = []
    for i in range(len(ranks)):
        j = i + 1
        while j < len(ranks) and ranks[j:] > ranks[i:]:
            j += 1
        out.append(j - i)
    return out


def brute_runs(words, least):
    """Every maximal stretch of every period; of equal stretches the smallest period."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            s = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            if i > s and i + q - s >= max(least, 2 * q):
                found.setdefault((s, i + q), q)
            i += 1
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text, least=12, change=True):
    w = (text or "").encode().split()
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if change and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w, least)
    kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + m for s, m, q in runs)]
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest())


COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_lyndon_lengths(ranks):
    assert periodic_runs.lyndon_lengths(ranks) == brute_lengths(ranks)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=30), st.integers(1, 4)), max_size=4), st.integers(2, 12))
def test_runs_of_several_texts(parts, least):
    words = [w * times for w, times in parts]
    assert periodic_runs.search(words, least) == [brute_runs(w, least) for w in words]


def test_hash_collisions_change_nothing(monkeypatch):
    monkeypatch.setattr(periodic_runs, "PRIME", 3)
    words = [b"abcabcabdabcabcabdx"[i:i + 1] for i in range(19)] * 3
    assert periodic_runs.search([words], 4) == [brute_runs(words, 4)]


def test_query_against_brute_force(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    texts = {r.doc_id: r.text for r in rows}
    found = {tuple(r[c] for c in COLUMNS) for r in op11_periodic_runs(spark, small).collect()}
    short = {i for i, t in texts.items() if len((t or "").split()) <= 2000}
    assert len(short) > 150 and {r[0] for r in found} == set(texts)
    assert {r for r in found if r[0] in short} == {brute_row(i, texts[i]) for i in short}
    assert sum(r[1] > 0 for r in found) > 10


def test_odd_rows(odd, none):
    found = periodic_runs.summary(odd).collect()
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    assert sorted(tuple(r[c] for c in COLUMNS)[1:] + (str(r.doc_id),) for r in found if r.doc_id != 7) == sorted(
        brute_row(i, t, change=False)[1:] + (str(i),) for i, t in rows if i != 7)
    long, = (r for r in found if r.doc_id == 7)
    assert (long.n_runs, long.start, long.length, long.period) == (1, 0, 60_000, 2)
    assert [tuple(r) for r in periodic_runs.find(odd).collect()] == [(7, 0, 60_000, 2)]
    cut = {r.doc_id: r.text for r in periodic_runs.collapse(odd).collect()}
    assert cut[7] == "Ab cd." and cut[5] == "One two three" and cut[1] == cut[2] == cut[3] == ""
    for f in (periodic_runs.summary, periodic_runs.find, periodic_runs.collapse):
        assert f(none).count() == 0
