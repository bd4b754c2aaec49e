"""Phrases against counting every run of words in dictionaries."""

import collections
import random
import re

import numpy as np
from pyspark.sql import functions as F

from tests.llm.fixtures import document_rows, documents, lower
from vigil.llm.collocations import _score, _packed, _unpacked, adjacent, collocations, occurrences


def plain(rows, least=10, cover=(50, 100), top=2000):
    n, f = collections.Counter(), collections.defaultdict(collections.Counter)
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", lower(text)):
            w = [x.decode() for x in re.findall(rb"[^\x20\x09]+", piece)]
            n[lang] += len(w)
            for size in (1, 2, 3):
                f[lang].update(tuple(w[k:k + size]) for k in range(len(w) - size + 1))
    out = []
    for lang, counts in f.items():
        good = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        inside = {p for g, a in good.items() if len(g) == 3 for p in (g[:2], g[1:]) if cover[1] * a >= cover[0] * counts[p]}
        rows = []
        for g, a in good.items():
            score, k = min((10**6 * a * a // (counts[g[:k]] * counts[g[k:]]), k) for k in range(1, len(g)))
            if g not in inside:
                rows.append((-score, -a, " ".join(g).encode(), counts[g[:k]], counts[g[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def answers(df):
    return sorted(tuple(r) for r in df.collect())


def test_phrases_against_dictionaries(spark):
    rng = random.Random(9)
    rows = document_rows()
    few = ["Ab", "cd", "eé", "Ée", "x", "ab", "q-q", "中文", "a b"]
    for k in range(150):
        text = "".join(rng.choice(few) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\x0b", "!?", "\r\n"]) for _ in range(rng.randint(0, 80)))
        rows.append((5000 + k, text, rng.choice(["en", "und", None, "", "x y"]), "s"))
    rows += [(7000, "one two three " * 30000, "en", "s"), (7001, "hot pair " * 50, "fr", "s"), (7001, "hot pair " * 50, "fr", "s"),
             (None, "hot pair no id " * 20, "fr", "s"), (7002, "...,,,", "it", "s"), (7003, None, "nl", "s")]
    df = documents(spark, rows, clash=["chunk", "a", "f", "word", "n"])
    want = plain(rows)
    assert len(want) > 100
    assert answers(collocations(df)) == want
    assert answers(collocations(df, chunk_bytes=300)) == want  # many chunks, full and part-full
    assert answers(collocations(df, least=25, cover=(90, 100), top=7)) == plain(rows, 25, (90, 100), 7)


def test_nothing_to_find(spark):
    assert answers(collocations(documents(spark, []))) == []
    assert answers(collocations(documents(spark, [(1, None, None, "s"), (2, "once upon a time", "en", "s")]))) == []
    assert answers(collocations(documents(spark, [(1, "word, " * 50, "en", "s")]))) == []  # frequent words, no neighbours


def test_relation_blocks_and_merge_join():
    places, words = occurrences("A b,c\td \n e a".encode())
    assert places.tolist() == [1, 2, 0, 3, 4, 0, 5, 1] and words.to_pylist() == list("abcde")
    assert occurrences(b" .")[0].tolist() == [] == occurrences(b"")[1].to_pylist()
    block = np.array([0, 1, 70000, 2**31 - 1], np.int32)
    assert (_unpacked(_packed(block), 4) == block).all()
    i, j = adjacent(np.array([0, 1, 3, 7]), np.array([1, 2, 4, 9]))
    assert i.tolist() == [0, 1, 2] and j.tolist() == [0, 1, 2]


def test_scores_pass_64_bits(spark):
    cases = [(10, 10, 10), (3, 7, 11), (9 * 10**15, 10**16 - 1, 9 * 10**15), (999_999_999_999_999, 1_000_000_000_000_000, 999_999_999_999_999)]
    got = spark.createDataFrame(cases, "a long, l long, r long").select("a", "l", "r", _score(F.col("a"), F.col("l"), F.col("r")).alias("s"))
    assert {tuple(r) for r in got.collect()} == {(a, x, y, 10**6 * a * a // (x * y)) for a, x, y in cases}
