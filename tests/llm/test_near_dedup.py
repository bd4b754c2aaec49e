import itertools
import random

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.fixtures import by_id, documents, edited, lower, prose
from vigil.llm import near_dedup
from vigil.llm.near_dedup import components, near_duplicates, super_minhash


def shingles(text, size):
    w = lower(text).split()
    return frozenset(tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()


def plain(rows, size, num, den):
    sets = {i: shingles(t, size) for i, t, *_ in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and den * len(x & y) >= num * len(x | y):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


def near_group(n=90, seed=3):
    """Near copies whose similarities straddle the threshold, with and without their common source."""
    rng = random.Random(seed)
    source = prose(rng, 150)
    return [(k, edited(rng, source, rng.uniform(0.0, 0.12)), "en", "s") for k in range(n)]


@pytest.mark.parametrize("rows,size,similar", [(None, 3, (85, 100)), (None, 5, (80, 100)), (near_group(), 3, (85, 100))])
def test_same_groups_as_all_pairs(spark, rows, size, similar):
    df = documents(spark, rows, clash=["id", "hub", "kept", "component_id"])
    rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
    want = plain(rows, size, *similar)
    got = by_id(near_duplicates(df, shingle=size, similarity=similar))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_null_ids_repeated_rows_and_empty_table(spark):
    text = "one two three four five six seven"
    rows = [(None, text, None, "s"), (4, text, None, "s"), (4, text, None, "s"), (2, text, None, "s"), (9, None, None, "s")]
    got = sorted((tuple(r)[:4] for r in near_duplicates(documents(spark, rows)).collect()), key=str)
    assert got == sorted([(None, 3, None, True), (4, 3, 2, False), (4, 3, 2, False), (2, 3, 2, True), (9, 0, 9, True)], key=str)
    assert near_duplicates(documents(spark, [])).collect() == []


def test_rows_of_one_id_link_by_their_own_texts(spark):
    one, other, lone = prose(random.Random(1), 50), prose(random.Random(2), 50), prose(random.Random(3), 50)
    rows = [(5, one, None, "s"), (5, other, None, "s"), (7, one, None, "s"), (3, other + " end", None, "s"), (5, lone, None, "s"), (5, lone, None, "s")]
    df = documents(spark, rows)
    groups = {}
    for r in near_duplicates(df).select("doc_id", "component_id", "text_hash", "group").collect():
        groups.setdefault(r["group"], []).append((r["doc_id"], r["component_id"]))
    assert sorted(map(sorted, groups.values())) == [[(3, 3), (5, 3)], [(5, 5), (5, 5)], [(5, 5), (7, 5)]]
    kept = dict(corpus_pipeline.STAGES)["near_dedup"](spark, df.selectExpr("*", "1L as n_chars"), None)
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == sorted([(3, other + " end"), (5, one), (5, lone)])


def test_two_clusters_under_one_hub_need_few_links(spark, monkeypatch):
    """Copies of one text, and near copies of another that fail against it, meet their hubs and not one another."""
    rng = random.Random(4)
    source = prose(rng, 200).replace("\n", " ").split(" ")
    far = source.copy()
    for k in rng.sample(range(200), 14):
        far[k] = f"q{k}"
    texts = []
    for base in (source, far):
        for k in range(60):
            own = base.copy()
            own[rng.randrange(200)] = f"z{k}"
            texts.append(" ".join(own))
    seen = []
    monkeypatch.setattr(near_dedup, "components", lambda links: components(seen.append(links) or links))
    rows = [(k, t, "en", "s") for k, t in enumerate(texts)]
    got = by_id(near_duplicates(documents(spark, rows), shingle=3, similarity=(85, 100)))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == plain(rows, 3, 85, 100)
    assert seen[0].distinct().count() <= 4 * len(rows)


def test_components_of_long_paths(spark):
    links = [(k, k + 1) for k in range(0, 60)] + [(100 + k, 100) for k in range(1, 40)] + [(7, 7)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(1, 61)}, **{100 + k: 100 for k in range(1, 40)}}


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 600).astype(np.uint64)
    a, b = pool[:400], pool[100:500]  # similarity 300 / 500
    sig = super_minhash(np.concatenate([a, b, pool[:1]]), np.array([0, 400, 800, 801]), 80)
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.2
    assert len(set((sig[2] >> np.uint64(57)).tolist())) == 80  # one element ranks every slot once
