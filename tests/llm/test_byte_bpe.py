"""Pre-tokenisation over arrays, merges and decoding against the library."""

import base64
import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from riskloom.llm import byte_bpe
from riskloom.llm.queries import RANKED_BPE, op12_byte_bpe, vocabulary

tiktoken = pytest.importorskip("tiktoken")
regex = pytest.importorskip("regex")


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    with open(vocabulary(RANKED_BPE), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.Ranks(vocabulary(RANKED_BPE))


def cut(texts):
    import public_tokenizers
    blob, low, high, upto = byte_bpe.slices(texts)
    found, a = [], 0
    for b in upto.tolist():
        found.append([blob[x:y].decode() for x, y in zip(low[a:b], high[a:b])])
        a = b
    assert found == [regex.findall(public_tokenizers.PATTERN, t) for t in texts]


PARTS = st.lists(st.sampled_from(["'", "s", "t", "re", "ve", "ll", "l", "d", " ", "  ", "\n", "\t", " ", " ", "\x1c", "1", "٣", "a", "é", "ß", "漢", "!", "…", "\x00", "😀", "'S"]), max_size=12).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(PARTS, min_size=1, max_size=5))
def test_slices_of_marks_and_blanks(texts):
    cut(texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=("Cs", "Cn")), max_size=30), min_size=1, max_size=4))
def test_slices_of_any_text(texts):
    cut(texts)


def test_every_code_point_has_the_librarys_class():
    """A letter, number or mark before a code point of its own class makes one slice, which a rank can tell."""
    import public_tokenizers
    ranks = {bytes([i]): i for i in range(256)}
    for first in b"a1!":
        ranks |= {bytes([first, x]): len(ranks) + x - 128 for x in range(128, 256)}
    own, table = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), byte_bpe.classes()
    for c in (c for c in range(128, 0x110000) if not 0xD800 <= c < 0xE000):
        same = [own.encode_ordinary(first + chr(c))[0] >= 256 for first in "a1!"]
        assert table[c] == (same.index(True) if any(same) else byte_bpe.INNER), hex(c)


def test_scan_equals_stepping():
    found = np.random.default_rng(0).integers(0, byte_bpe.PAD, 5000).astype(np.uint8)
    state, want = byte_bpe.FRESH, []
    for s in found:
        want.append(state)
        state = byte_bpe.AFTER[s, state]
    assert (byte_bpe.states_before(found) == want).all()


@settings(max_examples=200, deadline=None)
@given(PARTS, st.text(st.characters(exclude_categories=("Cs", "Cn")), max_size=80), st.integers(1, 12))
def test_ids_and_bytes_equal_the_library(ranks, library, parts, text, times):
    texts = [parts, text, (parts + text) * times, ""]
    for t, ids in zip(texts, ranks.encode(texts)):
        assert ids.tolist() == library.encode_ordinary(t)
        assert ranks.decode(ids, ranks.offsets(ids)) == t.encode()


def test_long_slices_and_full_memo(ranks, library, monkeypatch):
    monkeypatch.setattr(byte_bpe.Ranks, "MEMO", 3)
    for t in ("a" * 5001, "ab" * 3000, "=" * 900 + "x" * 77, " " * 4000 + "b", "une école à Genève " * 40):
        assert ranks.encode([t])[0].tolist() == library.encode_ordinary(t)


@settings(max_examples=100, deadline=None)
@given(PARTS, st.integers(1, 30))
def test_pieces_join_to_the_same_tokens(ranks, library, parts, times):
    text = (parts + " it's 12 ") * times
    cuts = list(byte_bpe.pieces(text, 10))
    assert "".join(cuts) == text
    assert np.concatenate(ranks.encode(cuts)).tolist() == library.encode_ordinary(text)


def row(library, i, text):
    ids = library.encode_ordinary(text or "")
    return i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_query_equals_the_library(spark, small, library):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    found = op12_byte_bpe(spark, small).collect()
    assert sorted(tuple(r) for r in found) == sorted(row(library, r.doc_id, r.text) for r in rows)


def test_odd_rows_and_decoding(odd, none, library):
    path, rows = vocabulary(RANKED_BPE), odd.select("doc_id", "text").collect()
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in byte_bpe.round_trip(odd, path).collect()), key=key) == sorted((row(library, r.doc_id, r.text) for r in rows), key=key)
    encoded = byte_bpe.encode(odd, path)
    assert sorted((tuple(r) for r in byte_bpe.decode(encoded, path).collect()), key=key) == sorted(((r.doc_id, r.text or "") for r in rows), key=key)
    part = {r.doc_id: r.text for r in byte_bpe.decode(encoded, path, first=1, last=3).collect()}
    ids = library.encode_ordinary("été <|endoftext|> naïve\x00")
    assert part[8] == library.decode_bytes(ids[1:3]).decode("utf-8", "replace") and part[2] == ""
    for f in (byte_bpe.round_trip, byte_bpe.encode):
        assert f(none, path).count() == 0
