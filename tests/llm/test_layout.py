"""Sharding and packing."""

import collections
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
from tokenizers import Tokenizer

from tests.llm.fixtures import by_id, documents
from vigil.llm import packing
from vigil.llm.sharding import even, hypergeometric, matrix_row, shuffled


def test_shards_have_exact_sizes_and_gapless_slots(spark):
    df = documents(spark, clash=["shard", "slot", "block"])
    rows = df.collect()
    for options in ({"shards": 7}, {"shards": 7, "block_rows": 4}, {"shards": 200}, {"shards": 3, "stable": False}):
        got = shuffled(df, **options)
        assert set(got.columns) == set(df.columns)
        got = got.collect()
        assert sorted((r["doc_id"], r["text"] or "") for r in got) == sorted((r["doc_id"], r["text"] or "") for r in rows)
        slots = collections.defaultdict(list)
        for r in got:
            slots[r["shard"]].append(r["slot"])
        sizes = [len(slots[s]) for s in range(options["shards"])]
        assert sizes == even(len(rows), options["shards"]).tolist()
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert shuffled(documents(spark, [])).collect() == []


def test_shuffle_is_uniform_over_seeds():
    rows_of, blocks = np.array([5, 0, 9, 6]), np.array([7, 7, 6])
    total = np.zeros((4, 3))
    for seed in range(400):
        matrix = np.array([matrix_row(rows_of, blocks, p, seed) for p in range(4)])
        assert (matrix.sum(axis=0) == blocks).all() and (matrix.sum(axis=1) == rows_of).all()
        total += matrix
    assert np.abs(total / 400 - np.outer(rows_of, blocks) / 20).max() < 0.25


def test_draws_beyond_numpys_range():
    rng = np.random.default_rng(4)
    got = np.array([hypergeometric(rng, 3 * 10**9, 7 * 10**9, 10**6) for _ in range(200)])
    sd = (1e6 * 0.3 * 0.7 * (1 - 1e-4)) ** 0.5
    assert abs(got.mean() - 3e5) < 5 * sd / 200**0.5 and 0.8 < got.std() / sd < 1.2


def test_pieces_are_the_tokenizers_ids_and_fill_sequences(spark):
    df = documents(spark, clash=["uid", "ids", "sequence_id"])
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = packing.packed(df, length=256, slack=4).collect()
    pieces = {(r["doc_id"], r["piece"]): r for r in got}
    n = 0
    for row in df.collect():
        ids = plain.encode(row["text"] or "", add_special_tokens=False).ids + [1]
        for k, a in enumerate(range(0, len(ids), 256)):
            r = pieces[row["doc_id"], k]
            assert (r["start"], r["length"], np.frombuffer(r["ids"], "<u4").tolist()) == (a, len(ids[a:a + 256]), ids[a:a + 256])
            n += 1
    assert n == len(got)
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    assert len(sequences) <= len(packing.best_fit(np.array([r["length"] for r in got]), 256)) + 1
    assert packing.packed(documents(spark, [])).collect() == []


def test_repeated_rows_and_null_ids_are_packed_each(spark):
    rows = [(None, "oak elm", None, "a"), (3, "oak elm", None, "a"), (3, "oak elm", None, "b"), (4, None, None, "c")]
    got = packing.packed(documents(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in got) == [(0, 3), (3, 3), (3, 3), (4, 1)]
    assert len({r["sequence_id"] for r in got}) == 1 and sorted(r["offset"] for r in got)[0] == 0


def test_words_get_the_ids_that_they_have_in_the_text():
    rng = random.Random(3)
    path = packing.default_tokenizer()
    plain = Tokenizer.from_file(path)
    parts = ["a", "B", "é", "É", "'s", "'", "’", ".", "..", "!", "#$", "1", "K", "İ", "́", " ", "\x1c", " ", "\n",
             "<|endoftext|>", "<|", "ǆ", "中", "'T", "can't.", "x́,", "ʰ", "ﬁ", "한"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        data, edges = packing.encode(pa.array(["x y", text, text]), path)
        assert np.frombuffer(data[edges[1]:edges[2]], "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_long_and_short_documents_stored_apart_share_sequences(spark, monkeypatch):
    lengths = [2500] * 6000 + [400] * 19000 + [17] * 5000
    cut = spark.createDataFrame([(k, n) for k, n in enumerate(lengths)], "uid long, length long").repartitionByRange(3, "length")
    fewest = len(packing.best_fit(np.array(lengths), 4096))
    for deal in (1 << 16, 5000):
        monkeypatch.setattr(packing, "DEAL", deal, raising=False)
        got = packing.sequences(cut).collect()
        assert sorted(r["uid"] for r in got) == list(range(len(lengths)))
        places = collections.defaultdict(list)
        for r in got:
            places[r["sequence_id"]].append((r["offset"], lengths[r["uid"]]))
        for own in places.values():
            own.sort()
            assert [a for a, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1].tolist()] and sum(own[-1]) <= 4096
        assert len(places) <= 1.01 * fewest


def merged_up(lengths, nodes):
    """Sequences that the tree makes of pieces dealt to ``nodes``, in this process."""
    rng = np.random.default_rng(8)
    own = [[(int(n), np.array([0]), np.array([0])) for n in part] for part in np.array_split(rng.permutation(lengths), nodes)]
    total = 0
    while True:
        last, up = len(own) == 1, []
        for items in own:
            fill, uids, offsets = (list(x) for x in zip(*items))
            rows = packing._pack(np.array(fill), uids, offsets, 0, 0, 4096, 16, last).to_pylist()
            total += sum(r["done"] for r in rows)
            up.append([(r["fill"], np.array(r["uids"]), np.array(r["offsets"])) for r in rows if not r["done"]])
        if last:
            return total
        own = [sum(up[k:k + packing.FAN_IN], []) for k in range(0, len(up), packing.FAN_IN)]


def test_underfull_bins_held_back_cost_no_sequence(monkeypatch):
    lengths = np.random.default_rng(3).choice([2500, 2100, 3000, 1500, 900, 40], 20000, p=[0.4, 0.2, 0.2, 0.1, 0.05, 0.05])
    counts = []
    for carry in (16, packing.CARRY, 1 << 20):
        monkeypatch.setattr(packing, "CARRY", carry)
        counts.append(merged_up(lengths, 60))
    assert counts[0] == counts[1] == counts[2]


def test_best_fit_bins():
    rng = np.random.default_rng(2)
    sizes = rng.integers(1, 101, 700)
    bins = packing.best_fit(sizes, 100)
    assert sorted(i for b in bins for i in b) == list(range(700))
    assert max(sizes[b].sum() for b in bins) <= 100
    assert len(bins) <= 1.05 * -(-sizes.sum() // 100)
