"""Benchmark decontamination and licence scans."""

import random

import numpy as np
import pytest

from tests.llm.fixtures import documents, edited, lower, prose
from vigil.llm import decontaminate, license_scan


def bag(words, size):
    out = {}
    for k in range(len(words) - size + 1):
        s = tuple(words[k:k + size])
        out[s] = (out.get(s, (0, 0))[0] + 1, sum(map(len, s)))
    return out


def plain_hits(docs, items, least):
    """Every window of every document against every item."""
    out = {}
    for doc, text in docs:
        w = lower(text).split()
        for item, item_text in items:
            v = lower(item_text).split()
            size = min(5, len(v))
            n = min(len(v), len(w))
            if not v or n < size:
                continue
            want = bag(v, size)
            for s in range(len(w) - n + 1):
                score = decontaminate.bag_similarity(bag(w[s:s + n], size), want)
                if score >= least and score > out.get((doc, item), (0, 0))[0]:
                    out[doc, item] = (score, s)
    return out


@pytest.fixture(scope="module")
def contaminated_rows():
    rng = random.Random(8)
    items = [(k, prose(rng, n)) for k, n in enumerate([14, 20, 33, 40, 57, 3, 1])] + [(90, None), (91, "  ")]
    items[5], items[6] = (5, "quux frob zork"), (6, "singleton!")
    rows = [(k, prose(rng, rng.randint(1, 120)), "en", "s") for k in range(40)]
    for k in range(24):
        item = items[k % 7][1].replace("\n", " ")
        if k >= 14:
            item = edited(rng, item, 0.04)
        rows.append((100 + k, prose(rng, rng.randint(0, 60)) + " " + item.upper() + " " + prose(rng, 20), "en", "s"))
    rows += [(200, items[2][1][:120], "en", "s"), (201, None, "en", "s"), (202, "", "en", "s"), (203, items[3][1] * 2, "en", "s")]
    return rows, items


def test_same_hits_as_all_windows(spark, contaminated_rows):
    rows, items = contaminated_rows
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = documents(spark, rows, clash=["item_id", "similarity", "hits"])
    want = plain_hits([(r[0], r[1]) for r in rows], items, 0.8)
    for block in (100, 3):
        got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["word"])
               for r in decontaminate.contaminated(df.select("doc_id", "text"), bench, block=block).collect()}
        assert set(got) == set(want)
        assert all(abs(got[k][0] - want[k][0]) < 1e-9 and got[k][1] == want[k][1] for k in want)
    clean = decontaminate.without_benchmark(df, bench)
    assert clean.columns == df.columns
    assert {r["doc_id"] for r in clean.collect()} == {r[0] for r in rows} - {k for k, _ in want}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(documents(spark), none).collect() == []
    assert decontaminate.contaminated(documents(spark, []), none).collect() == []


def test_byte_index_lists_all_fingerprints_within_the_radius():
    rng = random.Random(1)
    items = decontaminate.Items(list(range(60)), [prose(rng, 25) for _ in range(60)], 40)
    prints = items.prints[np.random.default_rng(2).integers(0, 60, 400)].copy()
    flips = np.random.default_rng(3).random((400, 128)) < 0.25
    prints ^= np.packbits(flips, axis=1)
    window, item, apart = items.candidates(25, prints)
    every = np.bitwise_count(prints[:, None, :] ^ items.prints[None, :, :]).sum(axis=2)
    assert set(zip(window.tolist(), item.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(every <= 40))))


def test_licences_with_edits_and_spans(spark):
    rng = random.Random(4)
    by_name = dict(license_scan.TEMPLATES)
    rows, want = [], {}
    for k, (name, text) in enumerate(license_scan.TEMPLATES):
        head = prose(rng, 30)
        rows.append((k, f"{head}\n{text}\n{prose(rng, 40)}", "en", "s"))
        want[k] = (name, len(head.split()), len(text.split()))
        changed = text.split()
        for at in range(11, len(changed), 12):
            changed[at] = "changed"
        rows.append((100 + k, " ".join(changed) + " " + prose(rng, 9), "en", "s"))
    rows += [(300, None, "en", "s"), (301, "", "en", "s"), (302, "All rights", "en", "s"), (303, "ALL RIGHTS RESERVED", None, "s")]
    rows += [(400 + k, prose(rng, 80), "en", "s") for k in range(10)]
    got = license_scan.licensed(documents(spark, rows).select("doc_id", "text")).collect()
    found = {(r["doc_id"], r["license_id"]): r for r in got}
    for k, (name, start, n) in want.items():
        r = found[k, name]
        assert (r["start_word"], r["end_word"], r["coverage"]) == (start, start + n, 1.0)
        r = found[100 + k, name]
        assert r["coverage"] >= 0.85 and r["matched"] == len(by_name[name].split()) - len(range(11, n, 12))
    assert {i for i, _ in found if i >= 300} == {303}
    own = spark.createDataFrame([("x", "quux frob zork blah"), ("y", None), ("z", "one")], "id string, text string")
    got = license_scan.licensed(documents(spark, [(1, "a quux frob zork blah b quux frob zork blah one", None, "s")]), templates=own).collect()
    assert sorted((r["license_id"], r["start_word"]) for r in got) == [("x", 1), ("x", 6), ("z", 10)]


def test_alignment_is_the_best_local_one():
    rng = random.Random(6)

    def plain(a, b):
        score = {}
        for i in range(len(a)):
            for j in range(i, i + 17):
                score[i, j] = max(0, score.get((i - 1, j - 1), 0) + (2 if a[i] == b[j] else -1),
                                  score.get((i - 1, j), 0) - 1, score.get((i, j - 1), 0) - 1)
        return max(score.values())
    for _ in range(60):
        a = np.array([rng.randint(1, 6) for _ in range(rng.randint(3, 14))], np.uint64)
        b = np.array([rng.randint(1, 6) for _ in range(len(a) + 16)], np.uint64)
        matched, first, last = license_scan.align(a, b, 8)
        assert (matched > 0) == (first >= 0) and last >= first
        assert 2 * matched >= plain(a.tolist(), b.tolist())
