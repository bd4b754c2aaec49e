"""Licence texts and notices inside documents.

Words are lower-cased (A-Z) and lose ASCII punctuation at both ends.  Each template is winnowed: of every ``WINNOW``
consecutive 3-word shingles the one with the smallest hash is a fingerprint, so any ``WINNOW + 2`` words in a row
shared with a template hold one.  The fingerprints form an inverted index (hash to template and place), which every
shingle of every text is looked up in.  Hits of one template on nearly one diagonal are a candidate; a banded local
alignment (match 2, anything else -1) of the template against the text there gives the matched words and their span.
Reported are alignments that match at least ``least`` of the template's words; of overlapping ones of a template the
best.

Templates are sent to executors in blocks of at most ``BLOCK``, one pass over the texts for each.  A document is judged
alone and never shuffled.  Cases: null and blank texts match nothing; a template of fewer than three words is one
shingle of all its words; a template without words matches nothing; repeated rows are reported each.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.words import Slice, slices

GRAM, WINNOW, BAND, BLOCK, LEAST = 3, 4, 8, 5_000, 0.8
MATCHES = "array<struct<license_id:string,coverage:double,matched:int,start_word:int,end_word:int>>"

# Public licence notices.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0-line", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS"
BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""),
    ("MIT-line", "Released under the MIT License."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: Redistributions of source code must retain the above copyright notice,
this list of conditions and the following disclaimer."""),
    ("GPL-3.0-line", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
later version."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("CC-BY-NC-4.0-line", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", """To the extent possible under law, the author has waived all copyright and related or neighboring rights to
this work."""),
    ("all-rights-reserved", "All rights reserved."),
]

TRIMMED = np.isin(np.arange(256), list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"))


def plain_words(part: Slice) -> np.ndarray:
    """Word hashes without the punctuation at the words' ends (at most eight characters a side; one always stays)."""
    a, b = part.starts.copy(), part.ends.copy()
    for _ in range(8):
        a += (b - a > 1) & np.take(TRIMMED, part.data[a])
        b -= (b - a > 1) & np.take(TRIMMED, part.data[b - 1])
    return part.hash_bytes(a, b)


def winnow(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the window minima (the last of equals)."""
    if len(hashes) <= window:
        return np.array([len(hashes) - 1 - int(np.argmin(hashes[::-1]))]) if len(hashes) else np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)
    return np.unique(np.arange(len(views)) + window - 1 - np.argmin(views[:, ::-1], axis=1))


def align(template: np.ndarray, text: np.ndarray, band: int) -> tuple[int, int, int]:
    """Banded local alignment; ``text`` begins ``band`` words before the diagonal (out-of-range words are 0).

    Returns the matched words and the first and last matched place in ``text`` (0, -1, -1: none).
    """
    m, width = len(template), 2 * band + 1
    score = np.zeros((m + 1, width + 2), np.int64)
    slide = np.arange(width)
    same = np.lib.stride_tricks.sliding_window_view(text, width)[:m] == template[:, None]
    for i in range(m):
        row = np.maximum(score[i, 1:-1] + np.where(same[i], 2, -1), score[i, 2:] - 1)
        row = np.maximum.accumulate(np.maximum(row, 0) + slide) - slide
        score[i + 1, 1:-1] = row
    ranked = score[:, 1:-1] * (band + 1) - abs(slide - band)  # of equal scores the one nearest to the diagonal
    i, d = np.unravel_index(int(np.argmax(ranked)), (m + 1, width))
    matched, first, last = 0, -1, -1
    while i > 0 and score[i, d + 1] > 0:
        here, up = score[i, d + 1], score[i - 1, d + 1]
        if here == up + (2 if same[i - 1, d] else -1):
            if same[i - 1, d]:
                matched, first = matched + 1, i - 1 + d
                last = first if last < 0 else last
            i -= 1
        elif d + 1 < width and here == score[i - 1, d + 2] - 1:
            i, d = i - 1, d + 1
        else:
            d -= 1
    return matched, int(first), int(last)


class Index:
    def __init__(self, templates: list[tuple[str, str]]):
        self.names, self.words = [], []
        places: list[tuple[int, int, int]] = []
        for name, text in templates:
            part = next(slices(pa.array([text], pa.string()), lower=True), None)
            if part is None or not len(part.starts):
                continue
            words = plain_words(part)
            size = min(GRAM, len(words))
            grams, _, _ = part.windows(size, words)
            for q in winnow(grams, WINNOW).tolist():
                places.append((int(grams[q]), len(self.names), q))
            self.names.append(name)
            self.words.append(words)
        places.sort()
        self.sizes = sorted({min(GRAM, len(w)) for w in self.words})
        self.hashes = np.array([p[0] for p in places], np.uint64)
        self.template, self.place = (np.array([p[k] for p in places], np.int64) for k in (1, 2))
        self.known = np.unique(self.hashes)

    def hits(self, grams: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.known, grams), max(0, len(self.known) - 1))
        return np.flatnonzero(self.known[at] == grams) if len(self.known) else np.zeros(0, np.int64)

    def candidates(self, places: np.ndarray, grams: np.ndarray) -> dict[int, list[int]]:
        """Template -> the diagonals to align on, hits closer than half a band as one."""
        found: dict[int, list[int]] = {}
        for p, h in zip(places.tolist(), grams):
            a, b = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
            for t, q in zip(self.template[a:b].tolist(), self.place[a:b].tolist()):
                found.setdefault(t, []).append(p - q)
        out: dict[int, list[int]] = {}
        for t, diagonals in found.items():
            for d in sorted(diagonals):
                if t not in out or d - out[t][-1] > BAND // 2:
                    out.setdefault(t, []).append(d)
        return out

    def search(self, words: np.ndarray, places: np.ndarray, grams: np.ndarray, least: float) -> list[dict]:
        out = []
        for t, diagonals in sorted(self.candidates(places, grams).items()):
            template, best = self.words[t], []
            for d in diagonals:
                reach = np.arange(d - BAND, d + len(template) + BAND)
                inside = (reach >= 0) & (reach < len(words))
                text = np.where(inside, words[np.clip(reach, 0, len(words) - 1)], np.uint64(0))
                matched, first, last = align(template, text, BAND)
                if matched >= least * len(template):
                    best.append((-matched, int(reach[first]), int(reach[last])))
            taken: list[tuple[int, int]] = []
            for score, a, b in sorted(set(best)):
                if all(b < x or a > y for x, y in taken):
                    taken.append((a, b))
                    out.append({"license_id": self.names[t], "coverage": -score / len(template), "matched": -score,
                                "start_word": a, "end_word": b + 1})
        return out


def scan(index: Index, texts: pa.Array, least: float = LEAST) -> pa.Array:
    out: list[list[dict]] = [[] for _ in range(len(texts))]
    for part in slices(texts, lower=True):
        words = plain_words(part)
        hit_docs: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for size in index.sizes:
            grams, doc, first = part.windows(size, words)
            hit = index.hits(grams)
            for d in np.unique(doc[hit]).tolist():
                own = hit[doc[hit] == d]
                hit_docs.setdefault(d, []).append((first[own] - part.word_edges[d], grams[own]))
        for d, found in hit_docs.items():
            own = words[part.word_edges[d]:part.word_edges[d + 1]]
            out[part.rows[d]] = index.search(own, np.concatenate([p for p, _ in found]), np.concatenate([g for _, g in found]), least)
    kind = pa.list_(pa.struct([("license_id", pa.string()), ("coverage", pa.float64()), ("matched", pa.int32()),
                               ("start_word", pa.int32()), ("end_word", pa.int32())]))
    return pa.array(out, kind)


@lru_cache(maxsize=4)
def _index(templates: tuple) -> Index:
    return Index(list(templates))


def _scanner(sent, least: float):
    @F.arrow_udf(MATCHES)
    def found(texts: pa.Array) -> pa.Array:
        return scan(_index(sent.value), texts, least)
    return found


def license_matches(text: Column, spark, templates: list[tuple[str, str]] | DataFrame = TEMPLATES, least: float = LEAST) -> Column:
    """Array column of matches: license_id, coverage, matched words, first word and the one behind the last."""
    parts = []
    if isinstance(templates, DataFrame):
        rows = templates.select(*(F.col(c).cast("string") for c in templates.columns[:2])).toDF("id", "text").where("text is not null")
        n_blocks = -(-rows.count() // BLOCK) or 1
        blocks = ([tuple(r) for r in rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n_blocks)) == k).orderBy("id", "text").collect()]
                  for k in range(n_blocks))
    else:
        blocks = (templates[k:k + BLOCK] for k in range(0, len(templates), BLOCK))
    for block in blocks:
        parts.append(_scanner(spark.sparkContext.broadcast(tuple(block)), least)(text.cast("string")))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def licensed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per match: id_col, license_id, coverage, matched, start_word, end_word."""
    found = docs.select(F.col(id_col), license_matches(F.col(text_col), docs.sparkSession, **options).alias("found"))
    return found.where(F.size("found") > 0).select(F.col(id_col), F.inline("found"))
