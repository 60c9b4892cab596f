"""Quality rules, license scan, URL filter and the pipeline."""

import re
from collections import Counter

import numpy as np
import pytest
from compare import check, connect

import corpus_pipeline
from riskloom.llm import license_scan, near_dedup, quality_rules, queries, url_filter


def brute_base(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_quality_base(docs, odd, none):
    for table in (docs, odd):
        want = Counter((i, *brute_base(t)) for i, t in table.select("doc_id", "text").collect())
        found = quality_rules.clean(table, with_text=True).collect()
        assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found) == want
        assert not any(r.kept and r.base_failed for r in found)
        assert all(r.left_words == len(r.clean_text.encode().split()) for r in found)
    assert quality_rules.clean(none).count() == 0


@pytest.mark.parametrize("line, rule", [
    ("Home | About | Contact", "navigation"), ("We use cookies to improve this site.", "boilerplate"), ("a%%% b### c$$$", "symbols"),
    ("READ THIS NOW OR ELSE!!", "shouting"), ("no mark ends this long line", "punctuation"), ("A plain sentence, as it should be.", None), ("A title", None)])
def test_line_rules(line, rule):
    assert quality_rules.judge_line(line, len(line.split()), False) == rule
    assert rule or quality_rules.judge_line(line, len(line.split()), True) == "repeated"


def test_quality_rejects_by_lost_text():
    good = "\n".join(" ".join(f"word{i}{k}" for k in range(10)).capitalize() + "." for i in range(8))
    assert quality_rules.judge(good)["kept"]
    assert not quality_rules.judge(good + "\n" + "\n".join(f"Link{i} | Page{i} | Site{i} | More{i} | Next{i} | Last{i} | End{i}" for i in range(20)))["kept"]


def test_licenses(spark, odd, none):
    apache = license_scan.TEMPLATES["apache-2.0-header"]
    changed = apache.replace("writing, software", "writing any software").replace("CONDITIONS", "TERMS")
    rows = [(1, "Intro words. " + changed + " More words."), (2, "Released under the MIT License. x y z. Released under the MIT license"), (3, "the license is not here"), (4, None)]
    found = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r.doc_id, r.license) for r in found) == Counter([(1, "apache-2.0"), (1, "apache-2.0-header"), (2, "mit"), (2, "mit")])
    long = next(r for r in found if r.license == "apache-2.0-header")
    assert 0.9 < long.coverage < 1 and long.first_word == 2 and sorted((r.first_word, r.end_word) for r in found if r.doc_id == 2) == [(0, 5), (8, 13)]
    assert license_scan.scan(odd).count() == 0 and license_scan.scan(none).count() == 0


def test_replaced_words_never_hide_a_notice(spark):
    """Each word of a short notice replaced, in many surroundings."""
    rng, rows, want = np.random.default_rng(8), [], Counter()
    around = lambda: " ".join(f"w{k}" for k in rng.integers(0, 1000, 6))
    for name in ("mit", "cc-by-nc-4.0", "apache-2.0", "gpl-3.0"):
        words = license_scan.TEMPLATES[name].split()
        for k in range(len(words)):
            for _ in range(10):
                changed = " ".join([*words[:k], "other", *words[k + 1:]])
                if len(license_scan.words_of(changed)) == len(license_scan.words_of(" ".join(words))):
                    want[len(rows), name] = 1
                    rows.append((len(rows), f"{around()} {changed} {around()}"))
    found = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).where("license in ('mit', 'cc-by-nc-4.0', 'apache-2.0', 'gpl-3.0')").collect()
    assert Counter((r.doc_id, r.license) for r in found) == want and all(r.coverage >= 0.8 and r.whole for r in found)


def test_partial_passages_are_reported(spark):
    words = license_scan.TEMPLATES["mit-text"].split()
    n = len(license_scan.words_of(license_scan.TEMPLATES["mit-text"]))
    half = " ".join(words[:len(words) // 2])
    rows = [(1, "Some words. " + half), (2, " ".join(words[-20:]) + " x" * 90 + " " + " ".join(words)), (3, " ".join(words[:20]) + " x" * 90 + " " + " ".join(words[-20:]))]
    found = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).where("license = 'mit-text'").orderBy("doc_id", "first_word").collect()
    k = len(license_scan.words_of(half))
    assert [(r.doc_id, r.whole) for r in found] == [(1, False), (2, False), (2, True), (3, False), (3, False)]
    assert (found[0].matched_words, found[0].first_word, found[0].end_word) == (k, 2, 2 + k) and found[0].coverage == k / n
    assert found[2].coverage == 1


def test_license_lines_of_the_documents(docs):
    found = {(r.doc_id, r.license) for r in license_scan.scan(docs).collect()}
    words = lambda t: " ".join(w.decode() for w in license_scan.words_of(t))
    rows = docs.select("doc_id", "text").collect()
    for name in ("apache-2.0", "mit", "gpl-3.0", "cc-by-nc-4.0"):
        assert {d for d, k in found if k == name} == {r.doc_id for r in rows if f" {words(license_scan.TEMPLATES[name])} " in f" {words(r.text)} "}


def test_winnowing_always_meets():
    rng = np.random.default_rng(4)
    for _ in range(200):
        shared = rng.integers(1, 2**63, license_scan.WINNOW).astype(np.uint64)
        h = np.concatenate([rng.integers(1, 2**63, rng.integers(0, 9)).astype(np.uint64), shared, rng.integers(1, 2**63, rng.integers(0, 9)).astype(np.uint64)])
        assert set(h[license_scan.winnow(h)].tolist()) & set(shared.tolist())


def test_cascade_is_exact():
    rng = np.random.default_rng(5)
    keys = np.unique(rng.integers(-2**62, 2**62, 30_000))
    rng.shuffle(keys)
    for n in (0, 1, 500, 20_000, len(keys)):
        levels = url_filter.build(keys[:n], keys[n:])
        assert (url_filter.member(keys, levels) == (np.arange(len(keys)) < n)).all()
        assert n in (0, len(keys)) or len(levels) > 1


@pytest.mark.parametrize("round_bytes, shard", [(32 << 20, 20_000), (64, 5)])
def test_urls(spark, small, monkeypatch, round_bytes, shard):
    """The same answers when the shards are many and each round takes few of them."""
    monkeypatch.setattr(url_filter, "SHARD_HOSTS", shard)
    pages = spark.read.parquet(f"{small}/pages.parquet")
    listed = queries.listed_hosts(pages)
    found = lambda df: Counter(map(tuple, df.collect()))
    assert check(spark, connect(small), small, lambda s, d: url_filter.judge(pages, listed, round_bytes=round_bytes), queries.ORACLES["op10_url_filter"]).startswith("exact")
    assert found(url_filter.judge(pages, listed)) == found(url_filter.judge(pages, listed, round_bytes=round_bytes))


def test_odd_urls(spark):
    rows = [(1, None), (2, "no scheme"), (3, "http://A.Example.ORG"), (4, "x://example.org/es/a?b#c"), (5, "http://bad.com/q"), (6, "http://sub.bad.com/fr/x"), (7, "http://notbad.com?x://y/z"), (1, None)]
    pages = spark.createDataFrame([(i, u, "h") for i, u in rows], "page_id long, url string, host string")
    listed = spark.createDataFrame([("BAD.com",), (None,), ("",)], "host string")
    found = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, listed).orderBy("page_id").collect()]
    assert found == [(1, "", "", None, "allow"), (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "a.example.org", "", None, "allow"),
                     (4, "example.org", "/es/a", "example.org/es/", "block"), (5, "bad.com", "/q", None, "block"), (6, "sub.bad.com", "/fr/x", "com/fr/", "allow"),
                     (7, "notbad.com", "", None, "allow")]
    assert url_filter.judge(pages.where("false"), listed).count() == 0
    assert {r.verdict for r in url_filter.judge(pages, listed.where("false")).where("rule IS NULL").collect()} == {"allow"}


def test_pipeline_stages(spark, docs, small):
    """Each stage on its own input: what goes and what stays."""
    df = docs
    for name, stage in corpus_pipeline.STAGES:
        before = df.select("doc_id", "text").collect()
        out = stage(spark, df, small)
        if name == "exact":
            assert out.count() == len({re.sub("[\x20\x09-\x0d]+", " ", r.text or "") for r in before})
        if name == "near":
            groups = near_dedup.near_groups(df, 5)
            assert out.count() == groups.select("component_id").distinct().count()
        if name in ("language", "toxicity"):
            assert out.count() >= 0.8 * len(before)
        if name != "packing":
            assert out.columns == docs.columns
            df = spark.createDataFrame(out.collect(), docs.schema)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {r.doc_id for r in df.collect()}


def test_pipeline_odd_and_empty(spark, odd, none, small):
    for table in (odd, none):
        df = table
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, small)
            rows = out.collect()
            df = spark.createDataFrame(rows, out.schema)
        assert {r.doc_id for r in rows} <= {4, 5, 6, 7, 8, None}


def full_alignment(template, words):
    """Matched words of the best local alignment, over the whole table."""
    best, above = (0, 0), [(0, 0)] * (len(words) + 1)
    for want in template:
        row = [(0, 0)]
        for j, word in enumerate(words):
            s, m = above[j]
            cell = (s + 2, m + 1) if word == want else (s - 1, m)
            for s, m in (above[j + 1], row[j]):
                cell = max(cell, (s - 1, m), key=lambda x: x[0])
            row.append(cell if cell[0] > 0 else (0, 0))
            best = max(best, row[-1], key=lambda x: x[0])
        above = row
    return best[1]


def test_winnowed_index_finds_what_full_tables_find(spark):
    """Templates with a fifth of the words replaced at even and at random places, or with words added, amid other words."""
    import random
    draw, rows, want = random.Random(2), [], {}
    index = license_scan.Index(license_scan.TEMPLATES)
    whole = sum(max(0, len(ws) - license_scan.GRAM + 1) for ws in index.words)
    assert sum(len(p) for posting in index.posting.values() for p in posting.values()) < 0.8 * whole  # fingerprints, not all grams
    for name in ("apache-2.0-header", "gpl-3.0-header", "isc", "mit-text", "mit", "cc-by-4.0"):
        template = [w.decode() for w in license_scan.words_of(license_scan.TEMPLATES[name])]
        lost = len(template) - int(np.ceil(0.8 * len(template)))
        for kind in range(6):
            words = list(template)
            places = [(i + 1) * len(words) // (lost + 1) for i in range(lost)] if kind == 0 else draw.sample(range(len(words)), lost)
            for p in places:
                words[p] = f"odd{p}"
            if kind > 3:
                words.insert(len(words) // 2, "extra")
            words = [f"x{draw.random()}" for _ in range(7)] + words + ["y", "z"]
            i = len(rows)
            rows.append((i, " ".join(words)))
            want[i] = name, full_alignment([w.encode() for w in template], license_scan.words_of(rows[-1][1]))
    found = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string"), least_words=1).collect()
    best = {}
    for r in found:
        best[r.doc_id, r.license] = max(best.get((r.doc_id, r.license), 0), r.matched_words)
    assert all(best[i, name] == n for i, (name, n) in want.items())


def test_internal_names_of_the_user(spark):
    """Columns that are called like internal ones keep their values and disturb nothing."""
    from riskloom.llm import exact_dedup, language_id
    names = ("__digest", "__of", "__keep", "__id", "__lang", "__n", "__chosen", "__dropped", "_kept", "id", "n", "digest", "body", "salt", "keep_id")
    schema = "doc_id long, text string, lang string, " + ", ".join(f"`{n}` string" for n in names)
    text = "one two three four five six seven eight nine ten"
    rows = [(i, t, "en", *(f"{n}{i}" for n in names)) for i, t in enumerate([text, text, text.replace(" ", "  "), "other words here", None])]
    docs = spark.createDataFrame(rows, schema)
    for kept, ids in ((exact_dedup.keep_one(docs), [0, 3, 4]), (near_dedup.keep_first(docs), [0, 3, 4])):
        assert sorted(map(tuple, kept.select(*docs.columns).collect())) == [rows[i] for i in ids]
    assert len(language_id.labelled(docs, docs["doc_id"] >= 0, 10)) == 4
