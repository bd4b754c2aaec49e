"""Quality rules, line dedup, substring dedup."""

import collections
import random
import re

import numpy as np

from tests.llm.fixtures import by_id, documents, prose, words
from vigil.llm import line_dedup, substring_dedup
from vigil.llm.quality import KEYS, Model, best_limit, judge, measured

CLASHES = ["n_words", "id", "h", "chunk", "quality"]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w, seen, dup = WORD.findall(text), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[k:k + 8]) for k in range(len(w) - 7)]
    many = collections.Counter(grams)
    covered = {j for k, g in enumerate(grams) if many[g] > 1 for j in range(k, k + 8)}
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
            "n_dup_lines": dup, "n_repeat_words": len(covered), "base_failed": len(w) < 20 or 100 * len(covered) > 30 * len(w)}


def test_base_counts(spark):
    df = documents(spark, clash=CLASHES)
    got = by_id(measured(df))
    for row in df.collect():
        want, own = base(row["text"]), got[row["doc_id"]]
        assert {k: own[k] for k in want} == want
        assert not (own["kept"] and own["base_failed"])
    assert measured(documents(spark, [])).collect() == []
    kept = judge(documents(spark)).where("quality.kept")
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}


def test_bands_reject_strange_texts_of_a_language(spark):
    rng = random.Random(2)
    rows = [(k, prose(rng, 150), "en", "s") for k in range(150)]
    rows += [(1000 + k, " ".join("%$#!" + str(rng.randint(0, 10**6)) for _ in range(150)), "en", "s") for k in range(3)]
    got = by_id(measured(documents(spark, rows)))
    assert not any(got[1000 + k]["kept"] for k in range(3))
    assert sum(got[k]["kept"] for k in range(150)) >= 148


def test_limits_that_fit_labels_find_junk_in_every_language(spark):
    """Fitted on half of the labels, tried on the other half."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    got = measured(docs, labels=labels.where("pmod(xxhash64(doc_id, 1), 2) = 0"))
    held = (got.where("not base_failed").join(labels.where("pmod(xxhash64(doc_id, 1), 2) = 1"), "doc_id")
            .join(docs.select("doc_id", "lang"), "doc_id").select("lang", "quality", "kept").collect())
    share = {(x, q): np.mean([not r["kept"] for r in held if (r["lang"], r["quality"]) == (x, q)]) for x in ("de", "en", "es", "fr") for q in (0, 1)}
    assert all(share[x, 0] >= least for x, least in (("de", 0.5), ("en", 0.9), ("es", 0.15), ("fr", 0.75)))
    assert all(share[x, 1] <= 0.04 for x in ("de", "en", "es", "fr"))


def test_best_limit_judges_fewest_wrongly():
    z, good = np.array([0.1, 0.5, 2.0, 3.0, 4.0, -5.0]), np.array([True, True, False, True, False, False])
    assert best_limit(z, good, 9.0) == 3.5 and best_limit(-z, good, 9.0) == 2.5
    assert best_limit(z[:2], good[:2], 9.0) == 9.0 == best_limit(z[:0], good[:0], 9.0)


def test_limits_of_a_table_count_every_label(spark):
    from vigil.llm import quality
    labels = spark.range(30_000).selectExpr("id as doc_id", "cast(id % 3 > 0 as int) as quality")
    assert quality.known_labels(labels, "doc_id").count() == 30_000
    rng = random.Random(4)
    rows = [(rng.choice(["en", "de", None]), rng.random() < 0.6, rng.randint(-60, 60) / 8) for _ in range(3000)]
    rows += [("few", True, 1.0)] * 30 + [("few", False, 2.0)] * 9 + [("up", k % 2 == 0, k / 10 + 0.1) for k in range(40)]
    rows += [("none", k < 20, 0.0) for k in range(40)] + [("cut", k < 20, k - 25.0) for k in range(40)]
    got = quality.best_limits(spark.createDataFrame(rows, "__lang string, __good boolean, z double").repartition(5), 9.0).collect()
    assert len(got) == len({r[0] for r in rows}) + 1
    for r in got:
        own = [x for x in rows if r["__all"] or x[0] == r["__of"]]
        z, good = np.array([x[2] for x in own]), np.array([x[1] for x in own])
        assert r["__enough"] == (min(good.sum(), (~good).sum()) >= 10)
        assert (r["__low"], r["__high"]) == (best_limit(-z, good, 9.0), best_limit(z, good, 9.0))


def test_every_ngram_of_every_text_is_counted():
    import pyarrow as pa
    from vigil.llm.quality import CLASSES, ngram_keys
    from vigil.llm.words import slices
    texts = ["abcd", "", "abc", "Über 12 été!", "xx", "q" * 50 + " # \n" + "zebra " * 9, "four", ""]
    for part in slices(pa.array(texts)):
        keys, edges = ngram_keys(part)
        for k, text in enumerate(texts[part.rows.start:part.rows.stop]):
            c = [int(CLASSES[x]) for x in text.encode()]
            assert keys[edges[k]:edges[k + 1]].tolist() == [((c[i] * 32 + c[i + 1]) * 32 + c[i + 2]) * 32 + c[i + 3] for i in range(len(c) - 3)]


def plain_whole_scores(rows, span):
    """Log perplexity by runs of ``span`` bytes, nothing folded, a model for each language: dictionaries only."""
    runs = {i: [text.encode()[k:k + span] for k in range(len(text.encode()) - span + 1)] for i, text, *_ in rows}
    out = {}
    for lang in {r[2] for r in rows}:
        counts = {span: collections.Counter(g for i, _, of, failed in rows if of == lang and not failed for g in runs[i])}
        for k in range(span - 1, 0, -1):
            counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
        cuts, mass, left = {}, collections.Counter(), collections.Counter()
        for k, own in counts.items():
            n = [max(1, sum(v == j for v in own.values())) for j in (1, 2, 3, 4)]
            y = n[0] / (n[0] + 2 * n[1])
            cuts[k] = [0.0, *(min(max(j - (j + 1) * y * n[j] / n[j - 1], 0.0), most) for j, most in ((1, 0.95), (2, 1.9), (3, 2.85)))]
            for g, v in own.items():
                mass[k, g[:-1]] += v
                left[k, g[:-1]] += cuts[k][min(v, 3)]

        def prob(g):
            if not g:
                return 1 / 256
            k, lower = len(g), prob(g[1:])
            if not mass[k, g[:-1]]:
                return lower
            v = counts[k][g]
            return (v - cuts[k][min(v, 3)] + left[k, g[:-1]] * lower) / mass[k, g[:-1]]
        for i in (r[0] for r in rows if r[2] == lang):
            out[i] = -sum(np.log(max(prob(g), 1e-12)) for g in runs[i]) / len(runs[i]) if runs[i] else None
    return out


def test_whole_model_folds_no_byte(spark, monkeypatch):
    import pyarrow as pa
    from vigil.llm import quality
    from vigil.llm.words import slices
    texts = ["abcdef", "", "abcde", "Über 12 été!", "xx", "слово за слово", ""]
    for part in slices(pa.array(texts)):
        keys, edges = quality.byte_keys(part)
        for k, text in enumerate(texts[part.rows.start:part.rows.stop]):
            b = text.encode()
            assert keys[edges[k]:edges[k + 1]].tolist() == [int.from_bytes(b[i:i + quality.SPAN]) for i in range(len(b) - quality.SPAN + 1)]
    monkeypatch.setattr(quality, "BLOCK", 500)
    df = documents(spark, [*[tuple(r)[:4] for r in documents(spark).limit(40).select("doc_id", "text", "lang", "source").collect()],
                           (9001, "short text", "en", "s"), (9002, "слово " * 30, "xx", "s"), (9003, None, None, "s")])
    got = by_id(measured(df))
    rows = [(r["doc_id"], r["text"] or "", r["lang"], got[r["doc_id"]]["base_failed"]) for r in df.collect()]
    for i, value in plain_whole_scores(rows, quality.SPAN).items():
        assert got[i]["whole_log_perplexity"] is None if value is None else abs(got[i]["whole_log_perplexity"] - value) < 1e-4


def test_counts_leave_a_task_in_parts(monkeypatch):
    from vigil.llm import quality
    monkeypatch.setattr(quality, "TALLY", 50)
    rng, tally, total, out = np.random.default_rng(1), quality.Tally(), collections.Counter(), collections.Counter()
    listed, parts = set(), 0
    for k in range(60):
        keys, lang, counted = rng.integers(0, 90, 30).astype(np.uint32), int(rng.integers(0, 3)), k % 4 > 0
        tally.add(lang, keys, counted)
        listed |= {(lang, int(x)) for x in keys}
        total.update((lang, int(x)) for x in keys if counted)
        for batch in tally.rows(last=k == 59):
            parts += 1
            for r in batch.to_pylist():
                out[r["lang"], r["key"]] += r["n"]
    assert parts > 3 and set(out) == listed and +out == total


def test_words_beyond_ascii_are_told_apart(spark):
    """Junk of the same byte classes as the good texts, so that the class model gives it the same perplexity."""
    rng = random.Random(5)
    letters = "абвгдежзиклмнопрстуфхцчшыэюя"
    known = ["".join(rng.choices(letters, k=5)) for _ in range(40)]
    junk = lambda: "".join(rng.choices(letters, k=5))
    rows = [(k, " ".join(rng.choice(known) if k < 200 else junk() for _ in range(60)), "ru", "s") for k in range(230)]
    labels = spark.createDataFrame([(k, int(k < 200), 0) for k in range(230)], "doc_id long, quality int, toxic int")
    got = by_id(measured(documents(spark, rows), labels=labels))
    assert not any(got[k]["base_failed"] for k in got)
    assert len({round(r["log_perplexity"], 6) for r in got.values()}) == 1
    assert {k for k in got if not got[k]["kept"]} == set(range(200, 230))


def test_kneser_ney_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    keys, counts = np.unique(rng.zipf(1.3, 5000) % KEYS, return_counts=True)
    model = Model(keys.astype(np.int32), counts)
    for context in (int(keys[0]) >> 5, int(keys[-1]) >> 5, 12345):
        probs = np.exp(model.log_probs((context << 5 | np.arange(32)).astype(np.int32)))
        assert abs(probs.sum() - 1) < 1e-3


def plain_lines(rows, least):
    """A line goes if the fewest lines from some line on that hold ``least`` words include it and also start earlier."""
    first, out = {}, {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        lines = (text or "").split("\n")
        held = [k for k, x in enumerate(lines) if words(x)]
        gone = set()
        for s in range(len(held)):
            e, n = s, 0
            while e < len(held) and n < least:
                n, e = n + len(words(lines[held[e]])), e + 1
            if n >= least and first.setdefault(tuple(lines[k] for k in held[s:e]), (i, s)) < (i, s):
                gone.update(held[s:e])
        out[i] = (None if text is None else "\n".join(x for k, x in enumerate(lines) if k not in gone), len(held), len(gone))
    return out


def test_line_runs(spark):
    df = documents(spark, clash=["id", "mark", "line_dedup"])
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    for least in (1, 2, 9, 20, 60):
        got = line_dedup.without_repeats(df, least_words=least)
        assert got.columns == df.columns
        want = plain_lines(rows, least)
        assert {i: (r["text"], *r["line_dedup"].values()) for i, r in by_id(got).items()} == want
        assert sum(n for *_, n in want.values()) > 20


def test_line_runs_of_odd_rows(spark):
    text = "a\nb\nc\nd"
    rows = [(None, text, None, "s"), (3, text, None, "s"), (3, text, None, "s"), (5, "x\n" + text + "\n\ny", None, "s"), (3, "b\nc\nd", None, "s")]
    got = line_dedup.without_repeats(documents(spark, rows), least_words=3).select("doc_id", "text").collect()
    assert sum(r["text"] == text for r in got) in (2, 3)  # the rows of id 3 are ordered by a hash of their texts
    assert [r["text"] for r in got if r["doc_id"] is None] == [text]
    assert [r["text"] for r in got if r["doc_id"] == 5] == ["x\n\ny"]
    assert line_dedup.without_repeats(documents(spark, [])).collect() == []


def test_repeats_of_one_and_two_lines(spark):
    long = " ".join(f"t{k}" for k in range(60))
    two = " ".join(f"a{k}" for k in range(11)) + "\n" + " ".join(f"b{k}" for k in range(12))
    texts = [f"{long}\nown 1", f"own 2\n{long}\nown 3", "own 2\nown 1", "short", "x\nshort\n\ny", long, f"z\nz\n{two}", f"{two}\nz",
             two.replace("b11", "c11"), f"{two.split(chr(10))[0]}\n\n{two.split(chr(10))[1]}"]
    got = by_id(line_dedup.without_repeats(documents(spark, [(k, t, "en", "s") for k, t in enumerate(texts)])))
    assert [got[k]["text"] for k in range(10)] == [texts[0], "own 2\nown 3", *texts[2:5], "", texts[6], "z", texts[8], ""]
    assert [tuple(got[k]["line_dedup"].values()) for k in range(10)] == [(2, 0), (3, 1), (2, 0), (1, 0), (3, 0), (1, 1), (4, 0), (3, 2), (2, 0), (2, 2)]


def test_one_line_of_a_third_of_all_rows(spark):
    hot = " ".join(f"h{k}" for k in range(25))
    rows = [(k, f"own {k} " * 15 + "\n" + (hot if k % 3 == 0 else f"line {k} " * 12), "en", "s") for k in range(900)]
    got = by_id(line_dedup.without_repeats(documents(spark, rows)))
    assert {i: (r["text"], *r["line_dedup"].values()) for i, r in got.items()} == plain_lines([r[:2] for r in rows], 20)
    assert sum(r["line_dedup"]["n_removed"] for r in got.values()) == 299


def plain_windows(rows, size):
    first, out = {}, {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        w = words(text)
        gone = set()
        for k in range(len(w) - size + 1):
            if first.setdefault(tuple(w[k:k + size]), i) < i:
                gone.update(range(k, k + size))
        out[i] = (len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode())
    return out


def test_repeated_windows(spark):
    df = documents(spark, clash=CLASHES)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    for chunk in (4 << 20, 9_000):
        got = by_id(substring_dedup.without_repeats(df, chunk_bytes=chunk, segment_bytes=chunk))
        assert {i: (r["n_words"], r["n_removed"], r["text"]) for i, r in got.items()} == plain_windows(rows, 13)


def test_repeated_windows_of_odd_rows(spark):
    text = " ".join(f"t{k}" for k in range(20))
    rows = [(None, text, None, "s"), (3, text, None, "s"), (3, text, None, "s"), (5, "x " + text, None, "s"), (1, None, None, "s")]
    got = sorted(map(tuple, substring_dedup.without_repeats(documents(spark, rows)).collect()), key=str)
    assert got == sorted([(None, 20, 0, text), (3, 20, 0, text), (3, 20, 0, text), (5, 21, 20, "x"), (1, 0, 0, "")], key=str)
    assert substring_dedup.without_repeats(documents(spark, [])).collect() == []


def test_gap_code():
    for cells in ([], [7], [7, 8, 9, 70_000, 70_001, 1 << 20], list(range(5, 900, 3))):
        data = substring_dedup.gaps(np.array(cells, np.int64), 5)
        assert substring_dedup.ungap(data, 5).tolist() == cells
