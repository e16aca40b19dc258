"""Main text of HTML pages: flat text blocks, classified by a decision tree.

A page is cut at block-level tags into a flat list of blocks. A block's features are its words and the share of them inside
links, the same of the blocks before and after it, and what surrounds it: a heading, an article, an element that is no part
of an article (navigation, footer, form), class names that hint at such a part, or at comments. The labelled table is made
from small pages of several invented layouts, whose blocks are known to be content or not; class names mislead in some of
them. A binary tree is trained on it by Gini impurity. Blocks that the tree calls content are decoded, their white space
made single, and joined by \\n.

The page is read once from left to right, so time is in proportion to its length whatever its markup.

Cases: a null or empty page has no text; elements that are never closed end with the page; a comment, script, style, tag or
quoted value that is never closed swallows the rest, as in browsers (a quote without a partner is an ordinary character);
a page of boilerplate alone has no text; repeated rows give repeated results; an empty table gives an empty result; columns
other than page_id, url and html are not read, so their names cannot clash.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import map_texts

_TAG = re.compile(r"</?([a-z][a-z0-9:-]*)", re.IGNORECASE)
_STOP = re.compile(r"""[>]|=[ \t\n\r\f]*(["'])""")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.IGNORECASE)
_ZEROS, _LONG_NUMBER = re.compile("&#0+(?=[0-9])"), re.compile("&#[0-9]{8,};?")
# Element names of HTML, and words that name parts of a page.
_RAW = frozenset("script style noscript template iframe object svg math textarea title select".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BOILER = frozenset("nav footer aside form menu button dialog".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
_HINTS = frozenset("ad ads advert advertisement alert banner breadcrumb breadcrumbs byline cookie cookies consent copyright footer header masthead menu modal nav navbar navigation newsletter notice notification pagination popup promo related recommended share sharing sidebar skip social sponsor sponsored subscribe subscription tags toolbar widget".split())
_COMMENTS = frozenset("comment comments commentlist disqus discussion reply replies respond".split())
_ARTICLES = frozenset("article content entry main post story".split())
# Of these hints, those that make a part of a line no part of the article.
_INLINE_HINTS = frozenset("ad ads advert advertisement alert consent cookie cookies newsletter notice notification popup promo sponsor sponsored".split())
#: What an open element says of the blocks in it.
BOILER, HINT, COMMENT, ARTICLE = range(4)


@dataclass
class Block:
    text: str
    words: int
    density: float
    heading: bool
    boiler: bool
    hint: bool
    comment: bool
    article: bool


def decoded(text: str) -> str:
    """Character references as characters; numbers beyond all characters become U+FFFD, however long they are."""
    if "&#" in text:
        text = _LONG_NUMBER.sub("\ufffd", _ZEROS.sub("&#", text))
    return html.unescape(text)


def named(attributes: str) -> list[list[str]]:
    """The words of the names that an element's attributes give it."""
    tokens = [t for x in _NAMES.findall(attributes) for t in x.strip("\"'").lower().split()] if attributes else []
    return [re.split("[-_0-9]+", t) for t in tokens]


def says(tag: str, attributes: str, in_article: bool) -> tuple[bool, bool, bool, bool]:
    """Of an element: boilerplate by its tag, a hint of boilerplate, comments, or an article."""
    parts = named(attributes)
    comment = any(p[0] in _COMMENTS for p in parts)
    article = not comment and (tag in ("article", "main") or any(p[0] in _ARTICLES for p in parts))
    hint = not article and any(p[0] in _HINTS or p[-1] in _HINTS for p in parts)
    return tag in _BOILER or tag == "header" and not in_article, hint, comment, article


class Page:
    """Reads a page into blocks."""

    def __init__(self, page: str):
        self.page, self.last_end, self.last_quote = page, page.rfind(">"), {q: page.rfind(q) for q in "\"'"}
        self.out: list[Block] = []
        self.open: list[tuple[str, tuple[bool, ...]]] = []
        self.names: Counter[str] = Counter()
        self.counts = [0, 0, 0, 0]
        self.parts: list[str] = []
        self.linked: list[str] = []
        self.in_link = self.heading = False
        self.aside = ""
        self.aside_depth = 0

    def tag_end(self, i: int) -> int:
        """After the tag that goes on at i; 0 if it never ends."""
        while i <= self.last_end and (m := _STOP.search(self.page, i)):
            i = m.end()
            if m[1] is None:
                return i
            if i <= self.last_quote[m[1]]:
                i = self.page.find(m[1], i) + 1
        return 0

    def close(self) -> None:
        """The block that ends here."""
        text = " ".join(decoded("".join(self.parts)).split())
        if text:
            n, m = len(text.split()), len(decoded(" ".join(self.linked)).split())
            self.out.append(Block(text, n, min(1.0, m / n), self.heading, *[c > 0 for c in self.counts]))
        self.parts.clear()
        self.linked.clear()
        self.aside = ""

    def add(self, text: str) -> None:
        if self.aside:  # an advert or notice within a line
            return
        self.parts.append(text)
        if self.in_link:
            self.linked.append(text)

    def enter(self, tag: str, attributes: str) -> None:
        flags = says(tag, attributes, self.counts[ARTICLE] > 0) if tag not in ("html", "body") else (False,) * 4
        if flags[ARTICLE]:  # hints around an article say nothing about what is in it
            flags = (False, False, False, True)
            self.open.append(("", (False, -self.counts[HINT], False, False)))
            self.counts[HINT] = 0
        self.open.append((tag, flags))
        self.names[tag] += 1
        for k, f in enumerate(flags):
            self.counts[k] += f

    def leave(self, tag: str) -> None:
        while self.names[tag]:
            name, flags = self.open.pop()
            self.names[name] -= bool(name)
            for k, f in enumerate(flags):
                self.counts[k] -= f
            if self.open and not self.open[-1][0]:
                self.counts[HINT] -= self.open.pop()[1][HINT]
            if name == tag:
                return

    def blocks(self) -> list[Block]:
        page, at = self.page, 0
        while True:
            i = page.find("<", at)
            if i < 0:
                self.add(page[at:])
                break
            if i > at:
                self.add(page[at:i])
            m = _TAG.match(page, i)
            if m is None:
                at = self.skipped(i)
                if at == i:
                    self.add("<")
                    at = i + 1
            else:
                end = self.tag_end(m.end())
                at = self.element(m[1].lower(), page[i + 1] == "/", page[m.end() : end - 1], end) if end else 0
            if not at:
                break
        self.close()
        return self.out

    def skipped(self, i: int) -> int:
        """After a comment, declaration or instruction; i if it is none; 0 if it never ends."""
        for start, end in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<!", ">"), ("<?", ">")):
            if self.page.startswith(start, i):
                j = self.page.find(end, i + 2 if end == "-->" else i + len(start))
                return j + len(end) if j >= 0 else 0
        return i

    def element(self, tag: str, ends: bool, attributes: str, at: int) -> int:
        """Takes in a tag; where to go on, or 0 if the rest is swallowed."""
        if tag in _RAW and not ends:
            m = _raw_end(tag).search(self.page, at)
            return self.tag_end(m.end()) if m else 0
        if tag in _INLINE:
            if tag == "a":
                self.in_link = not ends
            elif tag == "br":
                self.parts.append(" ")
            if tag not in _VOID:
                self.within_line(tag, ends, attributes)
            return at
        self.close()
        self.heading = tag in _HEADING and not ends
        if self.names["p"] and not (ends and tag == "p"):  # a paragraph ends where another block begins or ends
            self.leave("p")
        if ends:
            self.leave(tag)
            self.in_link = False
        elif tag not in _VOID and not attributes.endswith("/"):
            self.enter(tag, attributes)
        return at

    def within_line(self, tag: str, ends: bool, attributes: str) -> None:
        """Leaves out what stands in an element of a line that is named an advert, a notice or a comment; it ends with its block at the latest."""
        if not self.aside:
            if not ends and attributes and any(p[0] in _COMMENTS or p[0] in _INLINE_HINTS or p[-1] in _INLINE_HINTS for p in named(attributes)):
                self.aside, self.aside_depth = tag, 1
        elif tag == self.aside:
            self.aside_depth += -1 if ends else 1
            if not self.aside_depth:
                self.aside = ""


@lru_cache(maxsize=32)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(f"</{tag}(?=[ \\t\\n\\r\\f/>])", re.IGNORECASE)


def blocks(page: str) -> list[Block]:
    return Page(page).blocks()


def features(page: list[Block]) -> np.ndarray:
    """One row for each block: own words and link density, those before and after, and what surrounds it."""
    words, density = [0, *(b.words for b in page), 0], [0.0, *(b.density for b in page), 0.0]
    rows = [(words[i + 1], density[i + 1], words[i], density[i], words[i + 2], density[i + 2], b.heading, b.boiler, b.hint, b.comment, b.article) for i, b in enumerate(page)]
    return np.array(rows, np.float64).reshape(-1, 11)


# ---- the labelled table


class Layout:
    """A page of an invented layout: markup, and a label for each block in it."""

    def __init__(self, r: random.Random):
        self.r, self.markup, self.labels = r, [], []

    def prose(self, low: int, high: int) -> str:
        return " ".join("word" for _ in range(self.r.randint(low, high)))

    def block(self, content: bool, tag: str, text: str, attributes: str = "") -> None:
        self.markup.append(f"<{tag}{attributes}>{text}</{tag}>")
        self.labels.append(content)

    def put(self, markup: str) -> None:
        self.markup.append(markup)

    def links(self, n: int, tag: str = "li") -> None:
        for _ in range(n):
            self.block(False, tag, f'<a href="/x">{self.prose(1, 4)}</a>')

    def story(self, titled: bool) -> None:
        """Headings, paragraphs long and short, lists, and an advert or links between them."""
        if titled:
            self.block(True, "h1", self.prose(1, 14))
        for _ in range(self.r.randint(2, 9)):
            self.block(True, "p", self.prose(1, 4) if self.r.random() < 0.35 else self.prose(5, 140))
            x = self.r.random()
            if x > 0.95:
                self.block(True, "p", self.prose(4, 60), ' class="lead"')
            elif x > 0.9:
                self.block(False, "p", self.prose(3, 60), self.r.choice((' class="advert"', ' class="comment"', ' role="alert"')))
            if x < 0.1:
                self.block(True, "h2", self.prose(1, 8))
            elif x < 0.16:
                self.block(True, "li", f'{self.prose(3, 12)} <a href="/x">{self.prose(1, 3)}</a> {self.prose(1, 6)}')
            elif x < 0.22:
                self.block(True, "p", f'{self.prose(8, 30)} <a href="/x">{self.prose(1, 6)}</a> {self.prose(0, 20)}')

    def aside(self, names: tuple[str, ...]) -> None:
        self.block(False, self.r.choice(("div", "div", "p", "section")), self.prose(2, 26), f' class="{self.r.choice(names)}"')

    def comments(self) -> None:
        self.put(self.r.choice(('<section id="comments">', '<div class="comment-list">')))
        for _ in range(self.r.randint(1, 4)):
            self.put(self.r.choice(("<div>", '<article class="comment">')))
            self.block(False, "p", self.prose(1, 4), self.r.choice(("", ' class="comment-author"')))
            self.block(False, "p", self.prose(2, 140))
            self.put("</div></article>")
        self.put("</section></div>")


_ASIDES = ("ad", "cookie-notice", "promo", "newsletter", "share", "banner top", "related", "sidebar")


def layout(seed: int) -> tuple[str, list[bool]]:
    r = random.Random(seed)
    p, bare = Layout(r), r.random() < 0.25
    if not bare and r.random() < 0.7:
        p.put("<header>")
        p.block(False, "div", p.prose(1, 8))
        p.put("</header>")
    if not bare:
        p.put(r.choice(("<nav><ul>", '<div class="menu"><ul>')))
        p.links(r.randint(2, 9))
        p.put("</ul></nav></div>")
    if r.random() < 0.6:
        p.aside(_ASIDES)
    kind = r.randrange(4)
    # an article element, a named division, or neither; some have names that mislead
    start, end = (
        ("<article>", "</article>"), (f'<article class="{r.choice(("social", "sponsored", "post", "widget"))}">', "</article>"), (r.choice(('<div id="content">', '<main class="page">', '<div class="post-17 sponsored">')), "</div></main>"), (r.choice(("<div>", '<div class="ad-free-story">')), "</div>"),
    )[kind]
    p.put(start)
    if kind == 3:
        for _ in range(r.randint(1, 6)):  # without a name, length and few links must do
            p.block(True, "p", p.prose(28, 140))
    else:
        p.story(titled=r.random() < 0.9)
        if kind < 2 and r.random() < 0.4:
            p.aside(_ASIDES[:5])
            p.block(True, "p", p.prose(5, 100))
        if r.random() < 0.3:
            p.put("<ul>")
            p.links(r.randint(2, 5))
            p.put("</ul>")
        if r.random() < 0.3:
            p.put("<form>")
            p.block(False, "div", p.prose(1, 12))
            p.put("</form>")
    p.put(end)
    if bare:
        return "".join(p.markup), p.labels
    if r.random() < 0.5:
        p.comments()
    if r.random() < 0.5:
        p.put('<aside class="sidebar">')
        p.block(False, "p", p.prose(1, 120))
        p.links(r.randint(1, 4), "p")
        p.put("</aside>")
    p.put(r.choice(("<footer>", '<div class="footer">')))
    p.block(False, "p", p.prose(2, 25))
    return "".join(p.markup), p.labels


def labelled_table(pages: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of generated pages."""
    made = [layout(seed) for seed in range(pages)]
    return np.concatenate([features(blocks(page)) for page, _ in made]), np.concatenate([labels for _, labels in made])


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 4):
    """A binary tree as nested (feature, threshold, below, above), or a verdict."""
    if depth == 0 or len(y) < 2 * least or y.all() or not y.any():
        return bool(y.mean() >= 0.5)
    best = (np.inf, 0, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            below = x[:, f] < t
            if min(below.sum(), (~below).sum()) < least:
                continue
            p, q, n = y[below].mean(), y[~below].mean(), below.mean()
            impurity = n * p * (1 - p) + (1 - n) * q * (1 - q)
            if impurity < best[0] - 1e-12:
                best = (impurity, f, t)
    if not np.isfinite(best[0]):
        return bool(y.mean() >= 0.5)
    _, f, t = best
    below = x[:, f] < t
    return f, float(t), grow(x[below], y[below], depth - 1, least), grow(x[~below], y[~below], depth - 1, least)


@lru_cache(maxsize=1)
def tree():
    return grow(*labelled_table())


def is_content(node, row) -> bool:
    while not isinstance(node, bool):
        f, t, below, above = node
        node = below if row[f] < t else above
    return node


def main_text(page: str, node=None) -> str:
    found = blocks(page)
    node = tree() if node is None else node
    return "\n".join(b.text for b, row in zip(found, features(found).tolist(), strict=True) if is_content(node, row))


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""
    node = tree()
    own = pages.select(F.struct(F.col("page_id").cast("long").alias("page_id"), "url").alias("of"), F.coalesce("html", F.lit("")).alias("html"))

    def make():
        def kernel(of, texts):
            out = [main_text(t, node) for t in texts]
            return [[x["page_id"] for x in of], [x["url"] for x in of], out, [len(t) for t in out]]

        return kernel

    return map_texts(own, make, "page_id long, url string, text string, n_chars long")
