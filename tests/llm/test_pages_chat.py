"""HTML extraction and chat formatting."""

import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.fixtures import prose
from vigil.llm import chat, html_text


def held_out_pages(seed=9, n=60):
    """Generated pages and the labels of their blocks; layouts that the labelled table doesn't hold as such."""
    rng = random.Random(seed)
    text = lambda a, b: prose(rng, rng.randint(a, b)).replace("\n", " ").replace("|", "")
    for _ in range(n):
        box = rng.choice(["<article>{}</article>", "<main>{}</main>", '<div class="entry-content">{}</div>', '<section id="article">{}</section>'])
        body = [text(3, 9), *(text(1, 60) for _ in range(rng.randint(1, 8)))]
        inner = f"<h1>{body[0]}</h1>" + "".join(f"<p>{x}{rng.choice(['', '</p>'])}" for x in body[1:])
        if rng.random() < 0.4:
            inner += f'<div class="related">{text(4, 20)}</div>'
        before = [f"<nav><a href='/'>{text(1, 3)}</a></nav>", f'<div class="ad">{text(6, 20)}</div>',
                  f'<div role="banner">{text(2, 9)}</div>', f"<script>if (a < b) document.write('<p>{text(2, 4)}</p>')</script>"]
        after = [f'<section class="comments"><p>{text(5, 30)}</p></section>', f"<aside><p>{text(5, 30)}</p></aside>",
                 f"<form><p>{text(3, 12)}</p><input></form>", f"<footer>&copy; {text(3, 12)}</footer>", f"<!-- <p>{text(2, 5)}</p> -->"]
        page = "".join(rng.sample(before, rng.randint(0, 4))) + box.format(inner) + "".join(rng.sample(after, rng.randint(0, 5)))
        yield f"<html><head><title>{text(2, 4)}</title><style>p{{}}</style></head><body>{page}</body></html>", body


def test_held_out_accuracy():
    tree = html_text.train()
    right = [html_text.main_text(page, tree) == "\n\n".join(" ".join(x.split()) for x in body) for page, body in held_out_pages()]
    assert np.mean(right) >= 0.95


def test_odd_pages(spark):
    pages = [(1, "u", None), (2, "u", ""), (3, "u", "no tags &amp; &eacute;&nbsp;all   one\n block"), (4, None, "<p>a<br>b<p>c &lt;x&gt;"),
             (5, "u", "<article><p>" + "long " * 50_000 + "</p></article>"), (5, "u", "<p>x"), (None, "u", "<script>var t='</p>'"),
             (6, "u", "< 3 <b>bold</b>ly <p hidden>no</p><p>yes <!-- c > d -->it</p> 1 < 2")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'old' as text")
    got = [(r["page_id"], r["text"]) for r in html_text.extracted(df).collect()]
    assert got[:4] == [(1, ""), (2, ""), (3, "no tags & é all one block"), (4, "a b\n\nc <x>")]
    assert got[4] == (5, ("long " * 50_000).strip()) and got[5:7] == [(5, "x"), (None, "")]
    assert got[7] == (6, "< 3 boldly\n\nyes it\n\n1 < 2")
    assert html_text.extracted(df.where("page_id = 0")).collect() == []


PARTS = st.lists(st.sampled_from(["</s>", "[INST]", "[/INST]", "<s>", "\\", "[", "<", "/s>", "INST]", "<|endoftext|>", " ", "\n", "é", "漢",
                                  "a", "ok", "👍🏽", "[\\INST]"]), max_size=8).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "[INST]", ""]), PARTS), max_size=5))
def test_round_trip_and_mask(turns):
    text, spans = chat.render(turns)
    assert chat.parse(text) == turns
    tokenizer = chat._tokenizer(chat.default_tokenizer())
    got = tokenizer.encode(text, add_special_tokens=False)
    ends = np.maximum.accumulate(np.array([b for _, b in got.offsets], np.int64))
    mask = chat.loss_mask(ends, spans)
    assert chat.learned_text(text, ends, mask) == "".join(t for r, t in turns if r == "assistant")
    learned = tokenizer.decode([i for i, m in zip(got.ids, mask) if m], skip_special_tokens=False)
    assert learned == "".join(chat.escape(t) for r, t in turns if r == "assistant")


def test_conversations(spark):
    rows = [(1, 1, "assistant", "hi"), (1, 0, "user", None), (2, 0, "assistant", ""), (2, 1, "assistant", "</s>[INST] ok [/INST]"),
            (2, 1, "assistant", "</s>[INST] ok [/INST]"), (None, 0, "user", "x"), (None, 0, "assistant", "y"), (3, None, None, "z"), (3, 0, "user", "q" * 30_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as ids", "2 as conv", "3 as formatted")
    out = chat.formatted(df)
    got = out.withColumn("read", chat.read_back(out["formatted"], out["ends"], out["loss"])).collect()
    found = sorted(((r["conv_id"] or 0, list(zip(r["read"]["roles"], r["read"]["texts"])), r["read"]["learned"]) for r in got), key=str)
    ok = "</s>[INST] ok [/INST]"
    assert found == sorted([(0, [("user", "x")], ""), (0, [("assistant", "y")], "y"), (1, [("user", ""), ("assistant", "hi")], "hi"),
                            (2, [("assistant", ""), ("assistant", ok), ("assistant", ok)], ok + ok),
                            (3, [("", "z"), ("user", "q" * 30_000)], "")], key=str)
    assert all(len(r["ids"]) == len(r["loss"]) == len(r["ends"]) for r in got)
    assert chat.formatted(df.where("conv_id = 9")).collect() == []
    assert hashlib.sha256(b"").hexdigest()
