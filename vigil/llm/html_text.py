"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into a flat list of text blocks at block-level tags.  Each block has its word count, its link density and
those of the blocks before and behind it, and what the markup around it says (innermost article-like or
boilerplate-like container, heading, paragraph, whether the page marks an article at all).  A decision tree, trained
on the small labelled table ``LABELLED`` at each call, keeps or drops a block.  Kept blocks are joined by two line
breaks, nothing is capped.

Cases: null or empty html gives an empty text; unclosed and misnested tags end with the container around them; text
without any tag is one block; repeated pages are treated alike; a page is judged alone, so ids may be null.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML: tags that start a new block, tags without content, tags whose content is not text.
BLOCK_TAGS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary
table tbody td tfoot th thead tr ul""".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style noscript template iframe textarea title noframes xmp".split())
DROPPED_TAGS = frozenset("svg object select button canvas audio video datalist math head map".split())
ARTICLE_TAGS = frozenset("article main".split())
BOILER_TAGS = frozenset("nav footer aside form menu dialog header".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p blockquote pre figcaption dd".split())
# Words of class, id and role attributes that mark a container.
ARTICLE_WORDS = frozenset("article content post entry story main body articlebody maincontent text".split())
BOILER_WORDS = frozenset("""nav navbar navigation menu footer header masthead sidebar aside ad ads advert advertisement
adverts banner promo promotion sponsor sponsored cookie cookies consent notice alert gdpr popup modal overlay subscribe
newsletter signup share sharing social related recommended recommendations more breadcrumb breadcrumbs comment comments
reply replies discussion disqus widget login search pagination pager toolbar copyright legal disclaimer tags meta byline
complementary contentinfo skip""".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
                   r"""|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.DOTALL)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
WORDS_OF = re.compile(r"[a-z]+")
FEATURES = ("words", "links", "words_before", "links_before", "words_behind", "links_behind", "container", "heading",
            "paragraph", "page_has_article", "inside_links_only")


def _marks(tag: str, attributes: str) -> tuple[int, bool]:
    """1 for an article-like, -1 for a boilerplate-like container, 0 for neither; and whether it is hidden."""
    mark = 1 if tag in ARTICLE_TAGS else -1 if tag in BOILER_TAGS else 0
    hidden = False
    if attributes and attributes.strip():
        for name, a, b, c in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), (a or b or c).lower()
            if name in ("class", "id", "role", "itemprop") and not mark and tag not in ("html", "body"):
                words = set(WORDS_OF.findall(value))
                if words & BOILER_WORDS:
                    mark = -1
                elif words & ARTICLE_WORDS:
                    mark = 1
            elif name == "hidden" or (name == "aria-hidden" and value == "true") or (
                    name == "style" and "display:none" in value.replace(" ", "")):
                hidden = True
    return mark, hidden


def blocks_of(page: str) -> tuple[list[str], np.ndarray]:
    """Text and features of a page's blocks, in page order."""
    texts: list[str] = []
    facts: list[tuple] = []  # words, linked words, container, heading, paragraph
    stack: list[tuple[str, int, bool, bool]] = []  # tag, container, dropped, link
    parts: list[str] = []
    linked: list[str] = []
    container, dropped, link, article_seen, block_tag, at = 0, False, False, False, "", 0

    def flush():
        text = " ".join("".join(parts).split())
        if text:
            texts.append(text)
            facts.append((len(text.split()), len("".join(linked).split()), container, block_tag in HEADINGS, block_tag in PARAGRAPHS))
        parts.clear()
        linked.clear()

    def add(piece: str):
        if piece and not dropped:
            piece = html.unescape(piece)
            parts.append(piece)
            if link:
                linked.append(piece)

    size = len(page)
    while at < size:
        m = TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:-3].replace("&", "&amp;"))
            continue
        tag = m[2].lower()
        if m[1]:  # an end tag closes up to the last start tag of its name, if there is one
            names = [s[0] for s in stack]
            if tag in BLOCK_TAGS:
                flush()
                block_tag = ""
            if tag in names:
                k = len(names) - 1 - names[::-1].index(tag)
                if tag not in BLOCK_TAGS and any(n in BLOCK_TAGS for n in names[k + 1:]):
                    continue  # an inline end tag doesn't close the blocks inside
                if any(n in BLOCK_TAGS for n in names[k:]):
                    flush()
                del stack[k:]
                _, container, dropped, link = stack[-1] if stack else ("", 0, False, False)
            continue
        if tag in RAW_TAGS:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else size
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in VOID_TAGS:
            if tag == "hr":
                flush()
            continue
        if tag in BLOCK_TAGS:
            flush()
            while stack and stack[-1][0] not in BLOCK_TAGS and tag in BLOCK_TAGS and stack[-1][0] != "a" and stack[-1][0] not in DROPPED_TAGS:
                stack.pop()  # inline tags left open inside a block end with it
            if stack and stack[-1][0] == "p" or (stack and stack[-1][0] == "li" and tag == "li"):
                stack.pop()
            _, container, dropped, link = stack[-1] if stack else ("", 0, False, False)
            block_tag = tag
        mark, hidden = _marks(tag, m[3])
        if tag == "header" and container == 1:
            mark = 0  # an article's own header
        if m[3].endswith("/"):
            continue
        article_seen |= mark == 1
        container = mark or container
        dropped = dropped or hidden or tag in DROPPED_TAGS
        link = link or tag == "a"
        stack.append((tag, container, dropped, link))
    flush()
    if not texts:
        return texts, np.zeros((0, len(FEATURES)))
    f = np.array(facts, np.float64)
    density = f[:, 1] / f[:, 0]
    shift = lambda x, k: np.concatenate([[0.0], x[:-1]]) if k < 0 else np.concatenate([x[1:], [0.0]])
    return texts, np.stack([f[:, 0], density, shift(f[:, 0], -1), shift(density, -1), shift(f[:, 0], 1), shift(density, 1),
                            f[:, 2], f[:, 3], f[:, 4], np.full(len(f), float(article_seen)), (density == 1.0).astype(float)], axis=1)


# The labelled table: small pages, and for each block in page order whether it is main text.
LABELLED: list[tuple[str, str]] = [
    ("""<body><header><a href="/">Daily Post</a></header><nav><ul><li><a href="/a">World</a></li><li><a href="/b">Sport</a></li></ul></nav>
<article><h1>Rain at last</h1><p>After eleven dry weeks the first rain fell on the valley early on Sunday morning.</p><p>Yes.</p>
<p>Farmers, who had all but given up, <a href="/f">spoke of relief</a> when the clouds came over the hills.</p></article>
<aside><h3>Most read</h3><p>Ten ways to save water at home without much effort at all.</p></aside><footer>&copy; Daily Post. All rights reserved.</footer></body>""",
     "000" "1111" "00" "0"),
    ("""<div class="ad">Buy two pairs of shoes and get the third one free this week only.</div><article><h1>Chess</h1><p>A move.</p>
<p><b>The game.<br><p>White opened with the queen's pawn and the rest of the afternoon was spent in thought.</p></article><footer>&copy; site &middot; Some words of a motto that is rather long here.</footer>""",
     "0" "1111" "0"),
    ("""<div id="cookie-notice"><p>We use cookies to give you the best experience on our website. Read our policy.</p></div>
<div id="content"><h2>Setup</h2><p>Install the package and start it from the command line as shown below.</p><ul><li>Open a shell</li><li>Type the command</li></ul>
<p>Done.</p></div><div class="sidebar"><p>Subscribe to our newsletter and never miss a story again, it is free.</p><ul><li><a href="/1">Archive</a></li></ul></div>""",
     "0" "11111" "00"),
    ("""<main><h1>Soup</h1><p>Chop the onions.</p><p>Boil the water with salt and pepper for about twenty minutes in a large pot.</p>
<form><label>Email</label><p>Get recipes like this one in your inbox every single week, no spam.</p></form>
<section class="comments"><h3>Comments</h3><p>I made this yesterday and my whole family loved it, thank you so much!</p><p>Nice.</p></section></main>
<nav class="related"><a href="/x">Stew</a> <a href="/y">Broth</a></nav>""",
     "111" "00" "000" "0"),
    ("""<body><h1>Notes on tides</h1><p>The sea rises and falls twice a day because of the moon and, to a smaller part, of the sun.</p>
<p>Neap tides are weak.</p><p>Spring tides come when the sun and the moon stand in one line with the earth and pull together.</p>
<div><a href="/1">Home</a> | <a href="/2">About</a> | <a href="/3">Contact</a></div></body>""",
     "1111" "0"),
    ("""<body><div><a href="/">Start</a> <a href="/n">News</a> <a href="/s">Search</a></div><div>The council met on Tuesday evening to vote on the plan for the
new bridge, which has been delayed for three years.</div><div>It passed by two votes after a long debate about money and trees.</div>
<div><a href="/p">Previous</a> <a href="/q">Next</a></div><div>Terms</div></body>""",
     "0" "11" "0" "0"),
    ("""<div class="menu"><ul><li><a href="/m">Mains</a></li><li>Prices</li></ul></div><div class="post"><h1>A walk</h1><p>We left at dawn.</p><blockquote>Go slowly.</blockquote>
<p>By noon the path had led us to a lake that no map had promised and we rested there.</p><div class="share"><a href="/t">Share</a> this page</div></div>
<div class="footer"><p>Made with care by a small team of writers and one very old printer.</p></div>""",
     "00" "1111" "0" "0"),
    ("""<div role="alert"><p>Our offices stay closed on public holidays, please plan your visit in good time.</p></div><article><header><h1>Ink</h1></header>
<p>Ink is made from soot, water and gum, and it lasts longer than the paper.</p><ul><li>Soot</li><li>Gum</li></ul><p>So.</p>
<aside class="promo"><p>Order our box of inks today and save a third on the price of all ten colours.</p></aside><p>The end of the story is short.</p></article>
<section id="discussion"><p>First! I have used this ink for years and can only praise its deep black tone.</p></section><footer><p>Imprint</p><p>Privacy and all the other things that lawyers want to see on a page.</p></footer>""",
     "0" "1" "1111" "0" "1" "0" "00"),
    ("""<nav><a href="/">Up</a></nav><article><h1>Maps</h1><p>An old map is wrong in ways that tell us what its makers feared.</p><p><a href="/full">Read the whole atlas</a></p><p>Fin.</p></article>""",
     "0" "1111"),
    ("""<article><p>One.</p></article>""", "1"),
    ("""A note saved as a page, without any markup around it.""", "1"),
    ("""Six words without any markup here""", "1"),
    ("""<p>Hello.</p>""", "1"),
    ("""<body><div>The ferry leaves at nine and comes back before the tide turns in the evening.</div><div>Bring a coat.</div></body>""", "11"),
    ("""<div><a href="/">Top</a></div><article><h2><a href="/self">The title links to the page itself</a></h2><p>Text.</p><p><a href="/s">Source</a></p></article><div>Print</div>""",
     "0" "111" "0"),
    ("""<body><p>Short one.</p><p>A page may have no containers at all and still hold a long paragraph of running text for its readers.</p><p>It ends.</p></body>""", "111"),
    ("""<body><p><a href="/a">One link</a></p><p><a href="/b">Another link</a></p><p>Plain running text that tells the reader something of use and is not a link at all.</p><p><a href="/c">Last link</a></p></body>""", "0010"),
]


class Tree:
    """Binary splits by the Gini index until leaves are pure or hold fewer than two rows."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 6):
        self.value, self.split = float(y.mean()) >= 0.5, None
        if depth and len(y) > 1 and 0 < y.sum() < len(y):
            best = None
            for j in range(x.shape[1]):
                values = np.unique(x[:, j])
                for t in (values[1:] + values[:-1]) / 2:
                    low = x[:, j] <= t
                    impure = sum(len(p) * p.mean() * (1 - p.mean()) for p in (y[low], y[~low]))
                    if best is None or impure < best[0] - 1e-12:
                        best = (impure, j, t)
            if best:
                _, j, t = best
                low = x[:, j] <= t
                self.split = (j, t, Tree(x[low], y[low], depth - 1), Tree(x[~low], y[~low], depth - 1))

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.split is None:
            return np.full(len(x), self.value)
        j, t, low, high = self.split
        left = x[:, j] <= t
        out = np.empty(len(x), bool)
        out[left], out[~left] = low.predict(x[left]), high.predict(x[~left])
        return out


def train(labelled: list[tuple[str, str]] = LABELLED) -> Tree:
    xs, ys = [], []
    for page, labels in labelled:
        texts, features = blocks_of(page)
        if len(texts) != len(labels):
            raise ValueError(f"{len(texts)} blocks, {len(labels)} labels: {texts}")
        xs.append(features)
        ys += [int(c) for c in labels]
    return Tree(np.concatenate(xs), np.array(ys, np.float64))


@lru_cache(maxsize=1)
def _default_tree() -> Tree:
    return train()


def main_text(page: str, tree: Tree) -> str:
    texts, features = blocks_of(page)
    return "\n\n".join(t for t, keep in zip(texts, tree.predict(features)) if keep) if texts else ""


def extracted(pages: DataFrame, html_col: str = "html", name: str = "text", labelled: list[tuple[str, str]] | None = None) -> DataFrame:
    """``pages`` without the html column and with its main text as column ``name`` (replaced if it is there)."""
    tree = train(labelled) if labelled else _default_tree()

    @F.arrow_udf("string")
    def extract(texts: pa.Array) -> pa.Array:
        return pa.array([main_text(t or "", tree) for t in texts.to_pylist()], pa.string())

    text: Column = extract(F.col(html_col).cast("string"))
    return pages.withColumn("__text", text).drop(html_col, name).withColumnRenamed("__text", name)
