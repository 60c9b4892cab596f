"""Alignment of two tokenizers against brute force over byte ranges."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from riskloom.llm import alignment
from riskloom.llm.bpe import byte_alphabet
from riskloom.llm.queries import BYTE_BPE, PIECE_BPE, op13_alignment, vocabulary

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def brute_merge(a, b):
    """Links by comparing all pairs; groups by common ends."""
    links = [(i, j) for i in range(len(a)) for j in range(len(b)) if max(a[i - 1] if i else 0, b[j - 1] if j else 0) < min(a[i], b[j])]
    common = sorted(set(a) & set(b))
    return links, [sum(c < x for c in common) for x in a], [sum(c < x for c in common) for x in b]


def sizes(total, cuts):
    return sorted({c % total for c in cuts if c % total} | {total})


@settings(max_examples=500, deadline=None)
@given(st.integers(1, 60), st.lists(st.integers(0, 59), max_size=40), st.lists(st.integers(0, 59), max_size=40), st.integers(1, 9))
def test_merge_equals_all_pairs(total, a, b, piece):
    a, b = sizes(total, a), sizes(total, b)
    la, lb, ga, gb = (x.tolist() for x in alignment.merge(np.array(a), np.array(b), piece))
    assert (list(zip(la, lb)), ga, gb) == brute_merge(a, b)


def brute(rows):
    a = tokenizers.Tokenizer.from_file(vocabulary(BYTE_BPE))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECE_BPE))
    alphabet, found, counts = byte_alphabet(), [], Counter()
    for i, t in rows:
        ida, idb = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        ba = [bytes(alphabet[c] for c in a.id_to_token(x)) for x in ida]
        bb = [bytes([int(b.id_to_piece(x)[3:-1], 16)]) if b.is_byte(x) else b.id_to_piece(x).replace("▁", " ").encode() for x in idb]
        if not t or not b"".join(ba) == b"".join(bb) == b" " + t.encode():
            ida = idb = ba = bb = []
        ends_a, ends_b = np.cumsum([len(x) for x in ba]).astype(int).tolist(), np.cumsum([len(x) for x in bb]).astype(int).tolist()
        links, j = [], 0
        for x in range(len(ida)):
            start = ends_a[x - 1] if x else 0
            while ends_b[j] <= start:
                j += 1
            k = j
            while k < len(idb) and (ends_b[k - 1] if k else 0) < ends_a[x]:
                links.append((ida[x], idb[k]))
                k += 1
        groups, pa, pb = [], 0, 0
        for c in sorted(set(ends_a) & set(ends_b)):
            qa, qb = ends_a.index(c, pa) + 1, ends_b.index(c, pb) + 1
            groups.append(",".join(map(str, ida[pa:qa])) + "|" + ",".join(map(str, idb[pb:qb])))
            pa, pb = qa, qb
        counts.update(links)
        found.append((i, len(ida), len(idb), links, groups))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return Counter((i, na, nb, len(g), len(x), sum(counts[p] == best[p[1]] for p in x), sum(counts[p] for p in x),
                    hashlib.sha256(";".join(g).encode()).hexdigest() if g else "") for i, na, nb, x, g in found)


def test_both_encoders_give_the_same_ids():
    """Each code point between letters, numbers, marks and blanks, and each token's own text."""
    own = alignment.sides_of(vocabulary(BYTE_BPE), vocabulary(PIECE_BPE))
    library = alignment.Sides._by_file(vocabulary(BYTE_BPE))
    assert "_by_ranks" in own.encode_a.__qualname__
    texts = [f" a{chr(c)}a1{chr(c)}1!{chr(c)}! {chr(c)} x" for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts += [x.decode("utf-8", "replace") for x in own.bytes_a]
    for k in range(0, len(texts), 50_000):
        assert own.encode_a(texts[k:k + 50_000]) == library(texts[k:k + 50_000])


def test_query_against_brute_force(spark, small, monkeypatch):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    found = Counter(tuple(r[c] for c in COLUMNS) for r in op13_alignment(spark, small).collect())
    assert found == brute([tuple(r) for r in rows])


def test_odd_rows_many_blocks_and_groups(spark, odd, none):
    a, b = vocabulary(BYTE_BPE), vocabulary(PIECE_BPE)
    more = odd.select("doc_id", "text", "lang", "row", "keys").union(spark.createDataFrame(
        [(20, "▁ is a mark", "en", 1, "k"), (21, "<s> </s> <unk> <0x41> <|endoftext|>", "en", 1, "k"), (22, " two  blanks ", "en", 1, "k"), (23, "漢字 \U0001f600́", "en", 1, "k")],
        "doc_id long, text string, lang string, row long, `keys` string")).repartition(5)
    rows = [tuple(r) for r in more.select("doc_id", "text").collect()]
    want = brute(rows)
    assert Counter(tuple(r[c] for c in COLUMNS) for r in alignment.alignment(more, a, b).collect()) == want
    groups = alignment.align(more, a, b).collect()
    assert Counter((r.doc_id, r.n_a, r.n_groups, hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") for r in groups) == Counter(
        {(k[0], k[1], k[3], k[7]): n for k, n in want.items()})
    assert {k[0]: k[1] for k in want}[20] == 0
    assert alignment.alignment(none, a, b).count() == 0 and alignment.align(none, a, b).count() == 0
