"""The registered queries over whole sf0.001 tables, and the pipeline, against plain versions."""

import collections
import hashlib
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm.fixtures import by_id, document_rows, documents, words
from tests.llm.test_matches import plain_hits
from tests.llm.test_near_dedup import plain
from tests.llm.test_text_rules import base, plain_lines, plain_windows
from vigil.llm import html_text, line_dedup, quality
from vigil.llm.license_scan import TEMPLATES

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def items(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]


def run(spark, name):
    return entry.queries()[name](spark, SF)


def test_op1(spark, docs):
    got = by_id(run(spark, "op1_near_dedup"))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == plain(docs, 3, 85, 100)


def plain_scores(rows):
    """Log perplexity by the definition: class 4-grams, modified Kneser-Ney, dictionaries only."""
    grams = collections.defaultdict(collections.Counter)
    coded = {}
    for i, text, lang, passed in rows:
        c = [int(x) for x in quality.CLASSES[np.frombuffer((text or "").encode(), np.uint8)]]
        coded[i] = [tuple(c[k:k + 4]) for k in range(len(c) - 3)]
        slot = sum((lang or "").encode()) * 31 % quality.SLOTS
        if passed:
            grams[slot].update(coded[i])
    models = {}
    for slot, top in grams.items():
        counts = {4: top}
        for k in (3, 2, 1):
            counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
        levels = {}
        for k, own in counts.items():
            n = [max(1, sum(v == j for v in own.values())) for j in (1, 2, 3, 4)]
            y = n[0] / (n[0] + 2 * n[1])
            cut = [0.0, *(min(max(j - (j + 1) * y * n[j] / n[j - 1], 0.0), limit) for j, limit in ((1, 0.95), (2, 1.9), (3, 2.85)))]
            mass, left = collections.Counter(), collections.Counter()
            for g, v in own.items():
                mass[g[:-1]] += v
                left[g[:-1]] += cut[min(v, 3)]
            levels[k] = (own, cut, mass, left)
        models[slot] = levels

    def prob(levels, g):
        if not g:
            return 1 / 32
        own, cut, mass, left = levels[len(g)]
        lower = prob(levels, g[1:])
        if not mass[g[:-1]]:
            return lower
        v = own.get(g, 0)
        return (v - cut[min(v, 3)]) / mass[g[:-1]] + left[g[:-1]] / mass[g[:-1]] * lower

    out = {}
    for i, _, lang, _ in rows:
        levels = models.get(sum((lang or "").encode()) * 31 % quality.SLOTS)
        own = coded[i]
        known = {g: math.log(max(prob(levels, g), quality.LEAST)) for g in set(own)} if levels else {}
        out[i] = (-sum(known[g] for g in own) / len(own) if own and levels else None, len(own))
    return out


def plain_quality(rows):
    """(doc_id, text, lang) -> verdicts."""
    counts = {i: base(t) for i, t, _ in rows}
    scores = plain_scores([(i, t, lang, not counts[i]["base_failed"]) for i, t, lang in rows])
    bands = collections.defaultdict(list)
    for i, _, lang in rows:
        if not counts[i]["base_failed"] and scores[i][0] is not None:
            bands[lang].append(scores[i][0])
    out = {}
    for i, _, lang in rows:
        keep = not counts[i]["base_failed"]
        value, n = scores[i]
        if keep and value is not None:
            some = sorted(bands[lang])
            low, mid, high = (some[max(0, math.ceil(p * len(some)) - 1)] for p in (0.25, 0.5, 0.75))
            reach = max(high - low, 1e-3) * quality.WIDTH * math.sqrt(1 + quality.SETTLE / max(n, 1))
            keep = abs(value - mid) <= reach + 1e-6
        out[i] = (counts[i], value, keep)
    return out


def test_op2(spark, docs):
    got = by_id(run(spark, "op2_quality"))
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = plain_quality(rows)
    assert set(got) == set(want)
    for i, (counts, value, keep) in want.items():
        assert {k: got[i][k] for k in counts} == counts
        assert abs(got[i]["log_perplexity"] - value) < 1e-4 and got[i]["kept"] == keep


def test_op3(spark, docs):
    got = by_id(run(spark, "op3_sharding"))
    assert collections.Counter(r["shard"] for r in got.values()) == {s: len(docs) // 40 for s in range(40)}
    for i, t in docs:
        r = got[i]
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len((t or "").encode()) + 16, zlib.crc32((t or "").encode()), "rows", None)
    assert len({(r["shard"], r["slot"]) for r in got.values()}) == len(docs) and max(r["slot"] for r in got.values()) == len(docs) // 40 - 1


def test_op4(spark, docs):
    got = by_id(run(spark, "op4_substring_dedup"))
    assert {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in got.items()} == {
        i: (n, gone, sha(text)) for i, (n, gone, text) in plain_windows(docs, 13).items()}


def test_op5(spark, docs):
    got = {(r["doc_id"], r["license_id"]) for r in run(spark, "op5_license_scan").collect()}
    lines = [(n, t) for n, t in TEMPLATES if n.endswith("-line") or n == "all-rights-reserved"]
    assert got == {(i, n) for i, t in docs for n, line in lines if line in (t or "")} and got


def check_packing(rows, got):
    plain_tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for i, t in rows:
        ids = plain_tokenizer.encode(t or "", add_special_tokens=False).ids + [1]
        for k, a in enumerate(range(0, len(ids), 4096)):
            want[i, k] = (a, len(ids[a:a + 4096]), zlib.crc32(np.array(ids[a:a + 4096], "<u4").tobytes()))
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want
    fill = collections.Counter()
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill[r["sequence_id"]]
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 4096 and len(fill) <= -(-sum(fill.values()) // 4096) + 1


def test_op6(spark, docs):
    check_packing(docs, run(spark, "op6_packing").collect())


def test_op7(spark, docs, items):
    got = {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in run(spark, "op7_decontaminate").collect()}
    shingled = {tuple(w[k:k + 5]) for _, t in items for w in [words(t.lower())] for k in range(len(w) - 4)}
    some = [(i, t) for i, t in docs if any(tuple(w[k:k + 5]) in shingled for w in [words((t or "").lower())] for k in range(len(w) - 4))]
    assert got == {k: round(s, 9) for k, (s, _) in plain_hits(some, items, 0.8).items()} and got


def test_op8(spark, docs):
    got = by_id(run(spark, "op8_line_dedup"))
    assert {i: (r["kept_sha256"], r["n_lines"], r["n_removed"]) for i, r in got.items()} == {
        i: (sha(text or ""), n, gone) for i, (text, n, gone) in plain_lines(docs, line_dedup.LEAST_WORDS).items()}


def test_op9(spark):
    tree = html_text.train()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = by_id(run(spark, "op9_html_text"), "page_id")
    assert set(got) == set(pages)
    for i, page in pages.items():
        article = page[page.index("<article>"):page.index("</article>")]
        for tag in ("<article>", "</p>", "<b>"):
            article = article.replace(tag, "")
        parts = article.replace("<br>", " ").replace("</h1>", "<p>").replace("<h1>", "<p>").split("<p>")
        want = "\n\n".join(" ".join(html_text.html.unescape(x).split()) for x in parts if x.strip())
        assert got[i]["text"] == want == html_text.main_text(page, tree) and got[i]["n_chars"] == len(want)


def test_op10(spark):
    turns = collections.defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        turns[r["conv_id"]].append((r["turn"], r["role"] or "", r["text"] or ""))
    turns[-7] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    got = by_id(run(spark, "op10_chat"), "conv_id")
    assert set(got) == set(turns)
    for i, own in turns.items():
        own.sort()
        learned = "".join(t for _, r, t in own if r == "assistant")
        r = got[i]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (
            len(own), sha("".join(f"{a}\n{t}\n" for _, a, t in own)), len(learned), sha(learned))


def test_pipeline_stages_on_their_own_inputs(spark):
    """Each stage of the pipeline against a plain version of it on what the stage before kept."""
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    rows = document_rows()
    leaks = [(900 + k, f"some words before it {bench[k][1]} and a few behind it, {k} in all", "en", "src0") for k in range(3)]
    start = documents(spark, rows).selectExpr("*", "cast(length(text) as long) as n_chars")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "line_dedup", "near_dedup", "decontaminate", "pack"]
    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}

    kept = stages["quality"](spark, start, SF)
    assert kept.columns == start.columns
    want = plain_quality([(r[0], r[1], r[2]) for r in rows])
    assert texts(kept) == {i: t for i, t, *_ in rows if want[i][2]}

    before = texts(kept)
    cut = corpus_pipeline.written(stages["line_dedup"](spark, kept, SF), "t")
    want = plain_lines(list(before.items()), line_dedup.LEAST_WORDS)
    assert texts(cut) == {i: t for i, (t, n, gone) in want.items() if not 0 < gone == n}
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect())

    before = texts(cut)
    single = corpus_pipeline.written(stages["near_dedup"](spark, cut, SF), "t")
    groups = plain(list(before.items()), 5, 80, 100)
    assert texts(single) == {i: t for i, t in before.items() if groups[i][1] == i}

    single = single.unionByName(documents(spark, leaks).selectExpr("*", "cast(length(text) as long) as n_chars"))
    before = texts(single)
    clean = corpus_pipeline.written(stages["decontaminate"](spark, single, SF), "t")
    assert texts(clean) == {i: t for i, t in before.items() if not plain_hits([(i, t)], bench, 0.8)}
    assert not set(texts(clean)) & {900, 901, 902}

    check_packing(list(texts(clean).items()), stages["pack"](spark, clean, SF).collect())


def test_pipeline_runs_and_takes_empty_and_odd_rows(spark):
    got = entry.queries()["pipeline"](spark, SF).collect()
    assert got and set(got[0].asDict()) >= {"doc_id", "piece", "sequence_id", "offset", "ids_crc32"}
    odd = [(None, None, None, None), (None, "x " * 30, "en", "s"), (1, "", "en", "s"), (2, "y", None, "s"), (2, "y", None, "s")]
    for rows in ([], odd):
        df = documents(spark, rows).selectExpr("*", "cast(length(text) as long) as n_chars")
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, SF)
            assert out.count() <= max(len(rows), 0)
            if name != "pack":
                assert out.columns == df.columns
    repeated = documents(spark, [(2, "a b c d e f", "en", "s"), (2, "a b c d e f", "en", "s"), (None, "q", "en", "s")]).selectExpr("*", "1L as n_chars")
    assert sorted(r["doc_id"] or 0 for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, repeated, SF).collect()) == [0, 2]
