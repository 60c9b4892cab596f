"""License scan: winnowed fingerprints find templates, banded alignment measures how much of them a document holds.

Texts are words of ASCII letters and digits in lower case. The fingerprints of a template are the smallest of each ``WINNOW`` hashes
of ``GRAM`` words in a row; an inverted index leads from them to (template, position). All hashes of a document are looked up,
so GRAM + WINNOW - 1 shared words in a row always meet, which gives candidates with the diagonal on which they lie. A template that may
keep fewer words in a row when the share of words that ``least`` allows is replaced is posted whole, by fewer words where need be, so that
replaced words alone never hide a span of that coverage; a span of less coverage is found if it has that many words in a row. Along each diagonal the template is aligned with the document (matches
2, others -1, within ``BAND`` words of the diagonal), which gives matched words, coverage of the template and the span in the
document's words. A span is reported from ``least_words`` matched words on, whatever its coverage; ``whole`` says whether the
coverage is ``least`` or more, and spans that are whole are reported whatever their length.

Templates are a few short texts that every task holds; their number does not grow with the corpus. The texts below are notices
of public licenses (fixed values).

Defined results: a null or empty text and a text without a match give no row. A template that occurs several times gives a row
for each span; spans of one template do not overlap, and the one with more matched words goes first. Rows that repeat an id give
their own rows; other columns are not read. Ties go to the earlier span. Whole texts are read, whatever their length.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib
from bisect import bisect_right

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import map_batches, type_of

GRAM, WINNOW, BAND = 3, 2, 8
WORD = re.compile(rb"[a-z0-9]+")

#: Notices of public licenses (fixed values).
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
                         "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in "
                         "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
                         "either express or implied.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                      "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
           "copyright notice and this permission notice appear in all copies.",
    "mit": "Released under the MIT License.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
                "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
                "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().lower())


def grams(ids: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Hashes of ``size`` words in a row."""
    h = np.zeros(max(0, len(ids) - size + 1), np.uint64)
    for k in range(size):
        h = (h ^ ids[k:k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def winnow(h: np.ndarray) -> np.ndarray:
    """Places of the fingerprints: the last smallest of each ``WINNOW`` hashes."""
    if len(h) <= WINNOW:
        return np.array([len(h) - 1 - int(h[::-1].argmin())]) if len(h) else np.zeros(0, np.int64)
    best, place = h[WINNOW - 1:].copy(), np.arange(WINNOW - 1, len(h))
    for back in range(1, WINNOW):
        other = h[WINNOW - 1 - back:len(h) - back]
        less = other < best
        best[less], place[less] = other[less], np.arange(WINNOW - 1 - back, len(h) - back)[less]
    return np.unique(place)


def unbroken(words: int, least: float) -> int:
    """Words in a row that are left however the words that ``least`` does not ask for are replaced."""
    lost = words - max(1, math.ceil(least * words - 1e-9))
    return math.ceil((words - lost) / (lost + 1)) if words else GRAM


class Index:
    """Templates and, by length of gram, the inverted index of their fingerprints, or of all grams where these would not do."""

    def __init__(self, templates: dict[str, str], least: float = 0.8):
        self.names = sorted(templates)
        self.words = [words_of(templates[n]) for n in self.names]
        self.ids = {w: zlib.crc32(w) | 1 << 32 for ws in self.words for w in ws}
        self.posting: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for t, ws in enumerate(self.words):
            run = unbroken(len(ws), least)
            size = min(GRAM, run)
            h = grams(np.array([self.ids[w] for w in ws], np.uint64), size)
            for p in (winnow(h) if run >= GRAM + WINNOW - 1 else np.arange(len(h))).tolist():
                self.posting.setdefault(size, {}).setdefault(int(h[p]), []).append((t, p))
        self.known = {size: np.array(sorted(x), np.uint64) for size, x in self.posting.items()}


def align(template: list[bytes], words: list[bytes], diagonal: int, first: int = 0, last: int | None = None) -> tuple[int, int, int] | None:
    """Best local alignment within the band, from word ``first`` on and before ``last``: (matched words, first word, word after the last)."""
    last = len(words) if last is None else last
    best = (0, 0, 0, 0)
    above: dict[int, tuple[int, int, int]] = {}
    for i, want in enumerate(template):
        row: dict[int, tuple[int, int, int]] = {}
        for j in range(max(first, i + diagonal - BAND), min(last, i + diagonal + BAND + 1)):
            s, m, a = above.get(j - 1, (0, 0, j))
            same = words[j] == want
            cell = (s + 2, m + 1, a) if same else (s - 1, m, a)
            for s, m, a in (above.get(j, (0, 0, j)), row.get(j - 1, (0, 0, j))):
                cell = max(cell, (s - 1, m, a), key=lambda x: x[0])
            row[j] = cell if cell[0] > 0 else (0, 0, j + 1)
            if row[j][0] > best[0]:
                best = (row[j][0], row[j][1], row[j][2], j + 1)
        above = row
    return best[1:] if best[0] else None


def spans(template: list[bytes], words: list[bytes], anchors: dict[int, list[int]], least: float, least_words: int) -> list[tuple[int, int, int]]:
    """Spans (matched words, first word, word after the last) that do not overlap, those with more matched words first.

    ``anchors``: for each diagonal, the places of shared grams. Anchors inside a span that was taken are done with; the others of
    their diagonal are aligned again in the gap between taken spans where they lie.
    """
    enough = min(least_words, least * len(template))
    begins, ends, out, heap = [], [], [], []

    def gap(place):
        """The words free around a place, or None inside a taken span."""
        k = bisect_right(begins, place)
        low = ends[k - 1] if k else 0
        return (low, begins[k] if k < len(begins) else len(words)) if place >= low else None

    def offer(d):
        """Aligns at the first of the diagonal's places that is free; places of gaps that hold no long enough span are dropped."""
        places = anchors[d]
        while places:
            free = gap(places[-1])
            hit = align(template, words, d, *free) if free else None
            if hit and hit[0] >= enough:
                heapq.heappush(heap, (-hit[0], hit[1], hit[2], d))
                return
            high = free[1] if free else places[-1] + 1
            while places and places[-1] < high:
                places.pop()

    for d in anchors:
        anchors[d].reverse()
        offer(d)
    while heap:
        n, a, b, d = heapq.heappop(heap)
        k = bisect_right(begins, a)
        if (k == 0 or ends[k - 1] <= a) and (k == len(begins) or b <= begins[k]):
            begins.insert(k, a)
            ends.insert(k, b)
            out.append((-n, a, b))
        offer(d)
    return out


def scan_text(text: str | None, index: Index, least: float, least_words: int = 8) -> list[tuple[str, int, float, int, int]]:
    """(license, matched words, coverage, first word, word after the last), by place."""
    words = words_of(text)
    ids = np.fromiter(map(index.ids.get, words, [0] * len(words)), np.uint64, len(words))
    found: dict[int, dict[int, list[int]]] = {}
    for size, posting in index.posting.items():
        h = grams(ids, size)
        for p in np.flatnonzero(np.isin(h, index.known[size])).tolist():
            for t, q in posting[int(h[p])]:
                found.setdefault(t, {}).setdefault(p - q, []).append(p)
    out = [(index.names[t], n, n / len(index.words[t]), a, b) for t, anchors in found.items() for n, a, b in spans(index.words[t], words, anchors, least, least_words)]
    return sorted(out, key=lambda x: (x[3], x[0], x[4]))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8, least_words: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, license, matched_words, template_words, coverage, first_word, end_word, whole), one row per span with ``least_words`` or with that coverage."""
    index = Index(templates or TEMPLATES, least)
    size = dict(zip(index.names, map(len, index.words)))

    def run(batch):
        rows = [(i, *x) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for x in scan_text(t, index, least, least_words)]
        of, name, n, share, a, b = zip(*rows) if rows else ([],) * 6
        return {id_col: of, "license": name, "matched_words": n, "template_words": [size[x] for x in name], "coverage": share, "first_word": a, "end_word": b,
                "whole": [k >= least * size[x] for x, k in zip(name, n)]}

    return map_batches(docs.select(F.col(id_col), F.col(text_col).cast("string")), run,
                       {id_col: type_of(docs, id_col), "license": "string", "matched_words": "long", "template_words": "long", "coverage": "double", "first_word": "long", "end_word": "long", "whole": "boolean"})
