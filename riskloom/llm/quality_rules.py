"""Line-first cleaning: lines are judged one by one, bad lines go, and documents that lose too much text are rejected.

A line with a word fails by the first of these rules that holds:

* ``symbols``: a tenth of its characters or more are of ``#*$%&|<>``, not counting separators of navigation;
* ``navigation``: two or more separators (``|``, ``»``, ``›``, ``•``, ``::``) that stand alone, a quarter of its words or more;
* ``boilerplate``: it holds one of ``PHRASES``, or braces of a script;
* ``repeated``: it equals an earlier line of the document;
* ``shouting``: four words or more, most of them in capitals;
* ``punctuation``: five words or more and no mark that ends a sentence.

A document is kept if it has at least ``min_words`` words, its repeated three-word windows cover at most ``most_repeated``
percent of its words, and the lines left hold at least ``least_left`` percent of its words.

Defined results: a null or empty text has no words and is rejected. Lines without a word neither fail nor count. Rows that
repeat an id are judged each for itself; other columns are not read. An empty table gives an empty result. Whole texts are
read, whatever their length.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import map_batches, type_of

PHRASES = ("cookie", "privacy policy", "terms of use", "terms of service", "all rights reserved", "click here", "subscribe now", "subscribe to our",
           "sign in", "log in", "javascript", "lorem ipsum", "read more", "skip to content", "skip to main content", "share on", "follow us", "powered by")
SEPARATOR = re.compile(r"(?:^|\s)(?:\||»|›|•|::)(?=\s|$)")
SCRIPT = re.compile(r"[{}]\s*$|function\s*\(|</?\w+>")
ENDS = re.compile(r"[.!?…。！？]")
CAPITALS = re.compile(r"[A-Z\u00c0-\u00de]{2}|[^\x00-\u00ff]")
SYMBOL = re.compile(r"[#*$%&|<>]")
RULES = ("symbols", "navigation", "boilerplate", "repeated", "shouting", "punctuation")


def judge_line(line: str, words: int, repeated: bool, phrases: tuple[str, ...] = PHRASES) -> str | None:
    """The rule by which a line fails, or None. ``phrases``: those that the document holds at all."""
    bars = 0
    if SYMBOL.search(line) or not line.isascii() or "::" in line:
        bars = len(SEPARATOR.findall(line))
        symbols = len(SYMBOL.findall(line)) - line.count("|") * (bars > 0)
        if 10 * symbols >= len(line):
            return "symbols"
    if bars >= 2 and 4 * bars >= words:
        return "navigation"
    if phrases and any(p in line.lower() for p in phrases) or SCRIPT.search(line):
        return "boilerplate"
    if repeated:
        return "repeated"
    if words >= 4 and CAPITALS.search(line) and sum(map(str.isupper, line.split())) * 2 > words:
        return "shouting"
    if words >= 5 and not ENDS.search(line):
        return "punctuation"
    return None


def judge(text: str | None, min_words: int = 50, most_repeated: int = 50, least_left: int = 50) -> dict:
    """All figures of one document, and the text that is left."""
    text = text or ""
    words = text.encode().split()
    n, low = len(words), text.lower()
    phrases = tuple(p for p in PHRASES if p in low)
    seen: set[str] = set()
    left, left_words, failed, again = [], 0, dict.fromkeys(RULES, 0), 0
    for line in text.split("\n"):
        count = len(line.encode().split())
        if not count:
            continue
        repeated = line in seen
        again += repeated
        seen.add(line)
        rule = judge_line(line, count, repeated, phrases)
        if rule:
            failed[rule] += 1
        else:
            left.append(line)
            left_words += count
    repeats = repeated_words(words)
    base_failed = n < min_words or 100 * repeats > most_repeated * n
    return {"n_words": n, "word_chars": len(b"".join(words).decode()), "n_symbols": len(SYMBOL.findall(text)), "n_dup_lines": again, "n_repeat_words": repeats,
            "base_failed": base_failed, "kept": not base_failed and 100 * left_words >= least_left * n, "left_words": left_words,
            "failed_lines": sum(failed.values()), "clean_text": "\n".join(left), **{f"lines_{k}": v for k, v in failed.items()}}


def repeated_words(words: list[bytes]) -> int:
    """Words in three-word windows that occur twice or more."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    first, twice = set(), set()
    for x in windows:
        (twice if x in first else first).add(x)
    covered = bytearray(len(words))
    for i, x in enumerate(windows):
        if x in twice:
            covered[i] = covered[i + 1] = covered[i + 2] = 1
    return sum(covered)


COLUMNS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean",
           "kept": "boolean", "left_words": "long", "failed_lines": "long"} | {f"lines_{k}": "long" for k in RULES}


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, **limits: int) -> DataFrame:
    """Figures and verdict of every row, and the cleaned text if asked for."""
    columns = COLUMNS | ({"clean_text": "string"} if with_text else {})

    def run(batch):
        found = [judge(t, **limits) for t in batch.column(1).to_pylist()]
        return {id_col: batch.column(0)} | {k: [x[k] for x in found] for k in columns}

    return map_batches(docs.select(F.col(id_col), F.col(text_col).cast("string")), run, {id_col: type_of(docs, id_col)} | columns)
