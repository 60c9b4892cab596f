"""Exact groups, packing and byte-pair encoding against brute force and the libraries."""

import hashlib
import random
import re
import zlib
from array import array
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskloom.llm import bpe, exact_dedup, packing
from riskloom.llm.queries import BYTE_BPE, WORD_BPE, vocabulary

tokenizers = pytest.importorskip("tokenizers")


def library(name):
    return tokenizers.Tokenizer.from_file(vocabulary(name))


def brute_groups(rows):
    norm = [re.sub("[\x20\x09-\x0d]+", " ", t or "") for _, t in rows]
    groups = {}
    for (i, _), n in zip(rows, norm):
        groups.setdefault(n, []).append(i)
    keep = {n: min((x for x in v if x is not None), default=None) for n, v in groups.items()}
    return Counter((i, keep[n], len(groups[n]), i == keep[n]) for (i, _), n in zip(rows, norm))


@pytest.mark.parametrize("weak", [False, True])
def test_exact_groups(spark, odd, weak):
    """A digest that many texts share must change nothing: whole texts are compared."""
    rows = odd.select("doc_id", "text").collect()
    digest = (lambda body: F.substring(F.sha2(body.cast("binary"), 256), 1, 1)) if weak else exact_dedup.sha256
    found = exact_dedup.exact_groups(odd, salts=3, digest=digest).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in found) == brute_groups([tuple(r) for r in rows])


def test_keep_one_keeps_columns_and_one_row(odd, none):
    kept = exact_dedup.keep_one(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 3, 4, 5, 6, 7, 8])
    assert exact_dedup.exact_groups(none).count() == 0 and exact_dedup.keep_one(none).count() == 0


def test_keep_one_shuffles_whole_rows_once(spark):
    """The join's places serve for the last step too, null ids included: two shuffles of texts for the groups, one of rows, one of keys."""
    rows = [(i, t, 1) for i, t in [(1, "a  b"), (2, "a b"), (2, "a b"), (None, "a b"), (None, "c"), (None, "c"), (0, "d"), (None, "d")]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __own int")
    kept = exact_dedup.keep_one(docs)
    assert Counter(tuple(r)[:2] for r in kept.collect()) == Counter([(1, "a  b"), (None, "c"), (0, "d")])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = exact_dedup.keep_one(docs)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 4


def check_packing(rows, texts, capacity):
    """Every document whole and in order, sequences without gaps or overlap."""
    tokenizer, places = library(WORD_BPE), {}
    want = Counter()
    for i, t in texts:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        for k, a in enumerate(range(0, len(ids), capacity)):
            part = ids[a:a + capacity]
            want[i, k, a, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(k[3] * n for k, n in want.items())
    return len(places), -(-total // capacity)


def test_packing_odd_and_empty(odd, none):
    rows = packing.pack_documents(odd, vocabulary(WORD_BPE), capacity=64).collect()
    check_packing(rows, [tuple(r) for r in odd.select("doc_id", "text").collect()], 64)
    assert packing.pack_documents(none, vocabulary(WORD_BPE)).count() == 0


def test_packing_reaches_the_bound(docs):
    parts = packing.pieces(docs, vocabulary(WORD_BPE), with_ids=True)
    rows = packing.pack(parts, group_rows=40).collect()
    used, least = check_packing(rows, [tuple(r) for r in docs.select("doc_id", "text").collect()], 2048)
    whole = packing.bound(np.bincount([r.length for r in rows], minlength=2049), 2048)
    assert least <= whole <= used <= whole + 1
    assert all(len(r.ids) == 4 * r.length for r in rows)


@given(st.lists(st.integers(1, 20), max_size=12))
@settings(max_examples=60, deadline=None)
def test_bound_never_exceeds_the_best(sizes):
    def best(left, bins=()):
        if not left:
            return len(bins)
        out = len(sizes)
        for k in range(len(bins)):
            if bins[k] + left[0] <= 20:
                out = min(out, best(left[1:], (*bins[:k], bins[k] + left[0], *bins[k + 1:])))
        return min(out, best(left[1:], (*bins, left[0]))) if len(bins) + 1 < out else out
    sizes = sorted(sizes, reverse=True)[:8]
    lengths = np.array(sizes, np.int64)
    assert packing.bound(np.bincount(lengths, minlength=21), 20) <= best(sizes)
    bin_of, offset, filled = packing.best_fit_decreasing(lengths, 20)
    assert (filled <= 20).all() and filled.sum() == lengths.sum()


def test_merge_gadgets_agree_with_merging():
    """Automata of small random merge lists against merging pairs in order."""
    rng = random.Random(4)
    for _ in range(40):
        labels, merges, seen = {0: b"a", 1: b"b", 2: b"c"}, [], {b"a": 0, b"b": 1, b"c": 2}
        for _ in range(rng.randint(1, 10)):
            a, b = rng.choice(list(labels)), rng.choice(list(labels))
            text = labels[a] + labels[b]
            if text in seen or len(text) > 6:
                continue
            labels[len(labels)] = text
            seen[text] = len(labels) - 1
            merges.append((a, b, seen[text]))
        machine = bpe.Automaton({97: 0, 98: 1, 99: 2}, merges, labels)
        for _ in range(60):
            word = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 12)))
            ids = [seen[bytes([x])] for x in word]
            for a, b, ab in merges:
                out = []
                for x in ids:
                    if out and out[-1] == a and x == b and out[-1] is not None:
                        out[-1] = ab
                    else:
                        out.append(x)
                ids = out if a != b else pairs(ids, a, ab)
            assert machine.path(word) == ids


def pairs(ids, a, ab):
    out, i = [], 0
    while i < len(ids):
        if ids[i] == a and i + 1 < len(ids) and ids[i + 1] == a:
            out.append(ab)
            i += 2
        else:
            out.append(ids[i])
            i += 1
    return out


def test_round_trip_against_the_library(spark, docs, odd, none):
    tokenizer = library(BYTE_BPE)
    for table in (docs, odd):
        texts = [tuple(r) for r in table.select("doc_id", "text").collect()]
        want = Counter()
        for i, t in texts:
            ids = tokenizer.encode(t or "", add_special_tokens=False).ids
            decoded = tokenizer.decode(ids, skip_special_tokens=False)
            want[i, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] += 1
        assert Counter(map(tuple, bpe.round_trip(table, vocabulary(BYTE_BPE)).collect())) == want
    back = bpe.decode(bpe.encode(odd, vocabulary(BYTE_BPE)), vocabulary(BYTE_BPE))
    assert Counter(tuple(r) for r in back.collect()) == Counter((r[0], r[1] or "") for r in odd.select("doc_id", "text").collect())
    assert bpe.round_trip(none, vocabulary(BYTE_BPE)).count() == 0


@given(st.lists(st.sampled_from(list("aabe \n\t\r\x0b\x0c\x1c\x85\xa0'!<|>.,1²éßñ日ǅ\u0301😀stİΣς") + ["  ", "'s", "<|endoftext|>", "the ", "aaaa"]), max_size=30).map("".join))
@settings(max_examples=300, deadline=None)
def test_any_text_encodes_as_the_library(text):
    assert bpe.codec(vocabulary(BYTE_BPE)).encode(text) == array("I", TOKENIZERS[0].encode(text, add_special_tokens=False).ids).tobytes()
    assert packing.encoder(vocabulary(WORD_BPE)).encode([text.encode()])[0] == array("I", TOKENIZERS[1].encode(text, add_special_tokens=False).ids).tobytes()


TOKENIZERS = (library(BYTE_BPE), library(WORD_BPE))


def test_arcs_are_looked_up_and_not_walked(monkeypatch):
    """Steps to judge an arc stay as few as the two tokens have merges, however many merges begin with the token before it, and ids
    are decoded in steps."""
    c = bpe.codec(vocabulary(BYTE_BPE))
    machine, looked = c.automaton, []

    class Counted(dict):
        def get(self, key, other=None):
            looked.append(key)
            return super().get(key, other)

    monkeypatch.setattr(machine, "gadget", Counted(machine.gadget))
    states = [s for s in range(len(machine.after)) if s][-500:]
    for s in states:
        machine.allows(s, machine.token[b"e"])
    assert len(looked) <= 40 * len(states)
    monkeypatch.setattr(bpe, "STEP_IDS", 3)
    text = "na\u00efve \U0001f600 words, and <|endoftext|> more"
    assert c.decode(c.encode(text)) == text and c.decode(b"") == ""
    with pytest.raises(KeyError):
        c.decode(array("I", [10**6]).tobytes())


def test_words_in_use_outlive_a_full_memo(monkeypatch):
    """Words that every text has are encoded once however many others pass by, and the memo holds two generations at most."""
    monkeypatch.setattr(bpe, "MEMO_CHUNKS", 40)
    c, paths = bpe.Codec(vocabulary(BYTE_BPE)), Counter()
    path = c.automaton.path
    monkeypatch.setattr(c.automaton, "path", lambda word: paths.update([word]) or path(word))
    for i in range(60):
        text = "in thrablioque, and in ofenonbly" + "".join(f" x{chr(97 + i % 26)}{chr(97 + i // 26)}{chr(97 + k)}q" for k in range(9))
        assert c.encode(text) == array("I", TOKENIZERS[0].encode(text, add_special_tokens=False).ids).tobytes()
    assert max(paths.values()) == 1
    assert all(len(m) <= 40 and len(m.before) <= 40 for m in (c.words, c.chunks))


def test_chunks_that_need_no_pattern_are_what_it_makes():
    c = bpe.codec(vocabulary(BYTE_BPE))
    bodies = ["", "a", "Word", "été", "ª", "º", "ſ", "ƀ", "ǅ", "ʰ", "日本", "é", "a1", "1", "²", "ab's", "s", "×", "÷"]
    for chunk in [b + x for b in bodies for x in ["", *map(chr, range(33, 128)), "\n", " ", "’", "é"]]:
        assert c.chunk(chunk) == c.segment(" " + chunk) == array("I", TOKENIZERS[0].encode(" " + chunk, add_special_tokens=False).ids).tobytes(), chunk
