"""Main-text extraction: a tree-structured graphical model over the DOM.

A tolerant parser turns a page into block nodes (elements that start a block) with text blocks as leaves. Every
node has a hidden label, *content* or *other*: unary potentials weigh its features (kind of tag, words in
class, id and role, link share, length, sentence ends), pairwise potentials tie a node to its parent.
The nodes form a tree, so one upward and one downward sweep of sum-product messages give the exact marginals; a
text block is kept when its content marginal is over one half.

Parameters are trained by maximum likelihood (the same sweeps give the expected counts) on labelled pages: a bounded
sample of pages whose markup names its parts (article, nav, footer ...) labels itself, and re-dressed copies, in
which those parts carry other tags and class names and further kinds of boilerplate are mixed in, teach
the model pages that do not.

A name is read by whole class tokens: a token with a word like ``sidebar`` marks boilerplate unless another of its words says that it
states something (``no-sidebar``, ``comments-open``). What such a name is worth depends on what it covers: ``html`` and ``body`` are
never marked, an ``article`` only by a token made of such words alone, and a node with most of the page's text only so and
if no article lies in it. Only marked nodes hand their mark on to what is below them.

All pages of an Arrow batch are swept together, level by level, in numpy. Parsing is linear in the page. A comment or tag without an
end runs to the end of the page. Labels are read from re-dressed pages only, never from a page's own attributes.

Defined results: a null or empty page, or one without content, gives an empty text; repeated rows give equal texts;
an empty table gives an empty result (and a model trained on built-in layouts); other columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from html import escape
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docyard.llm.common import hashed_sample, table

#: Expected number of pages the model is trained from.
MAX_PAGES = 240
ITERATIONS = 120
#: Texts of these elements are no text of the page.
SILENT = frozenset("script style noscript template head title svg math iframe object select option textarea button "
                   "datalist canvas audio video map".split())
BLOCKS = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot "
                   "tr td th blockquote pre figure figcaption nav header footer aside form fieldset legend address "
                   "details summary dialog menu hr center hgroup search".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Start tags that leave an open head open; any other one, and text, ends it (its end tag is optional).
HEAD_PARTS = frozenset("html head title meta link style script base basefont bgsound noframes noscript template".split())
#: Elements that a slash in the start tag closes.
FOREIGN = frozenset(("svg", "math"))
#: A start tag closes an open element of these kinds, unless one of the stoppers lies between.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

PAGE_PARTS = frozenset("nav header footer aside form menu dialog search address fieldset".split())
CONTENT_PARTS = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
LIST_PARTS = frozenset(("ul", "ol", "li", "dl", "dt", "dd", "tr", "td", "th", "table"))
BAD_WORDS = frozenset("""nav navbar navigation menu header footer sidebar aside ad ads adv advert adverts advertisement
    banner promo promotion sponsor sponsored cookie cookies consent notice alert popup modal overlay share sharing social
    related recommended recommendation more teaser comment comments reply replies respond discussion disqus breadcrumb
    breadcrumbs pagination pager widget newsletter subscribe subscription signup login register search form copyright legal
    masthead toolbar skip tags rail outbrain taboola complementary contentinfo dialog""".split())
GOOD_WORDS = frozenset("article content post entry story main body text prose blog page articlebody".split())

#: A class token with one of these says what a page has or does, not what a box is.
STATE_WORDS = frozenset("""no not non has have with without is are off on out in open opened closed close enabled disabled set unset
    active inactive hide hidden show shown logged loaded ready js""".split())
#: Words of readers' comments: a token with one of them is a box of comments, whatever else it says.
COMMENT_WORDS = frozenset("comment comments reply replies respond discussion disqus".split())
#: Node names: marks boilerplate, made of such words alone, marks an article.
BAD, WHOLLY_BAD, GOOD = 1, 2, 4
#: Share of the page's text from which a node is a container rather than a box.
MOST = 0.5

_SPACE = re.compile(r"\s+")
_TOKENS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_ENDS = re.compile(r"[.!?]")

FEATURES = ("bias", "leaf", "page_part", "content_part", "heading", "list_part", "paragraph", "bad_word", "good_word",
            "hidden", "link_share", "all_links", "no_links_long", "log_words", "short", "sentence_ends", "boxes",
            "under_bad", "under_good", "bad_cover", "beside_article")
EDGES = 2  # parent to block, parent to text block


@dataclass
class Tree:
    """One page: parallel lists over nodes in page order; a parent always comes before its children."""

    parent: list[int]
    tag: list[str]
    name: list[int]  # BAD, WHOLLY_BAD, GOOD
    hidden: list[bool]
    text: list[str]  # of text blocks; empty for elements
    linked: list[int]  # characters inside links, of text blocks
    label: list[int]  # training only: 1 content, 0 other


def name_of(attrs: dict[str, str]) -> int:
    """What a node's class, id, role and itemprop call it."""
    out = 0
    for key in ("class", "id", "role", "itemprop"):
        for token in attrs.get(key, "").split():
            words = [w.lower() for w in _TOKENS.findall(token)]
            bad = [w in BAD_WORDS for w in words]
            if any(w in STATE_WORDS for w in words):
                continue
            if any(bad):
                out |= BAD | (WHOLLY_BAD if all(bad) or not COMMENT_WORDS.isdisjoint(words) else 0)
            elif any(w in GOOD_WORDS for w in words):
                out |= GOOD
    return out


class _Builder(HTMLParser):
    def __init__(self, labelled: bool):
        super().__init__(convert_charrefs=True)
        self.labelled = labelled
        self.tree = Tree([-1], ["#page"], [0], [False], [""], [0], [-1])
        self.open: list[tuple[str, int]] = [("#page", 0)]  # tag, node (-1: not a block)
        self.at: dict[str, list[int]] = defaultdict(list)  # places of the open elements of each kind
        self.block = [0]
        self.silent = 0
        self.links = 0
        self.parts: list[str] = []
        self.link_chars = 0

    def _flush(self) -> None:
        text = _SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            self._node("#text", 0, False, text, min(self.link_chars, len(text)))
        self.parts, self.link_chars = [], 0

    def _node(self, tag, name, hidden, text="", linked=0, label=-1) -> int:
        t = self.tree
        for column, value in ((t.parent, self.block[-1]), (t.tag, tag), (t.name, name), (t.hidden, hidden),
                              (t.text, text), (t.linked, linked), (t.label, label)):
            column.append(value)
        return len(t.tag) - 1

    def _pop(self) -> None:
        tag, node = self.open.pop()
        self.at[tag].pop()
        if tag in SILENT:
            self.silent -= 1
        if tag == "a":
            self.links -= 1
        if node >= 0:
            self._flush()
            self.block.pop()

    def _close(self, kinds: set, stoppers: set) -> None:
        """Close the nearest open element of these kinds and all within it, unless a stopper lies between."""
        nearest = lambda tags: max((self.at[t][-1] for t in tags if self.at[t]), default=0)
        at = nearest(kinds)
        if at > nearest(stoppers):
            while len(self.open) > at:
                self._pop()

    def _end_head(self) -> None:
        if self.open[-1][0] == "head":
            self._pop()

    def handle_starttag(self, tag, attrs):
        if tag == "head" and self.at["head"]:
            return
        if tag not in HEAD_PARTS:
            self._end_head()
        if tag == "body" and self.at["head"]:
            self._close({"head"}, {"template"})
        if tag in BLOCKS and self.at["p"]:
            self._close({"p"}, {"table", "td", "th", "button", "object"})
        if tag in CLOSES:
            self._close(*CLOSES[tag])
        if tag == "br":
            self.parts.append(" ")
        node = -1
        if tag in BLOCKS and not self.silent:
            self._flush()
            own = {k: v or "" for k, v in attrs}
            hidden = ("hidden" in own or own.get("aria-hidden") == "true"
                      or "display:none" in own.get("style", "").replace(" ", "").lower())
            given = own.get("data-label") if self.labelled else None
            node = self._node(tag, name_of(own), hidden, label=int(given) if given in ("0", "1") else -1)
        if tag in VOID:
            return
        if node >= 0:
            self.block.append(node)
        if tag in SILENT:
            self.silent += 1
        if tag == "a":
            self.links += 1
        self.at[tag].append(len(self.open))
        self.open.append((tag, node))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # a slash closes nothing in HTML
        if tag in FOREIGN:
            self._pop()

    def handle_endtag(self, tag):
        if tag not in VOID and self.at[tag]:
            self._close({tag}, set())

    # the whole page is fed at once: what has no end runs to the end of the page
    def _to_end(self, k: int) -> int:
        return len(self.rawdata) if k < 0 else k

    def parse_comment(self, i, report=1):
        return self._to_end(super().parse_comment(i, report))

    def parse_pi(self, i):
        return self._to_end(super().parse_pi(i))

    def parse_html_declaration(self, i):
        return self._to_end(super().parse_html_declaration(i))

    def parse_starttag(self, i):
        return self._to_end(super().parse_starttag(i))

    def parse_endtag(self, i):
        return self._to_end(super().parse_endtag(i))

    def handle_data(self, data):
        if data.strip():
            self._end_head()
        if not self.silent:
            self.parts.append(data)
            if self.links:
                self.link_chars += len(data)

    def finish(self) -> Tree:
        self.close()
        while len(self.open) > 1:
            self._pop()
        self._flush()
        return self.tree


def parse(html: str | None, labelled: bool = False) -> Tree:
    """The page's tree; ``labelled``: with the labels that ``redress`` has written into it."""
    builder = _Builder(labelled)
    builder.feed((html or "").replace("\x00", ""))
    return builder.finish()


def named_parts(tree: Tree, cover: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per node: whether its tag or name marks it as boilerplate, and whether as an article. ``cover``: its share of the text."""
    n = len(tree.tag)
    article = np.array([tag in CONTENT_PARTS for tag in tree.tag])
    bad, wholly, good = (np.array([bool(x & flag) for x in tree.name]) for flag in (BAD, WHOLLY_BAD, GOOD))
    top = np.array([tag in ("html", "body", "#page") for tag in tree.tag])
    part = np.array([tag in PAGE_PARTS for tag in tree.tag])
    good = (good | article) & ~top
    holds = (good & ~wholly) | np.array([tag == "h1" for tag in tree.tag])  # an article lies in it, or its title
    for k in range(n - 1, 0, -1):
        holds[tree.parent[k]] |= holds[k]
    most = cover >= MOST
    marked = np.where(article, wholly, np.where(most, wholly & ~holds, bad)) | (part & ~(most & holds))
    marked &= ~top
    return marked, good & ~marked


def node_features(tree: Tree) -> np.ndarray:
    """One row of FEATURES per node; an element's text figures are those of all text below it."""
    n = len(tree.tag)
    chars, linked, words, ends, boxes = (np.zeros(n) for _ in range(5))
    for k, text in enumerate(tree.text):
        if text:
            chars[k], linked[k] = len(text), tree.linked[k]
            words[k], ends[k], boxes[k] = text.count(" ") + 1, len(_ENDS.findall(text)), 1
    for k in range(n - 1, 0, -1):  # children come after their parents
        p = tree.parent[k]
        chars[p] += chars[k]
        linked[p] += linked[k]
        words[p] += words[k]
        ends[p] += ends[k]
        boxes[p] += boxes[k]
    share = linked / np.maximum(chars, 1)
    cover = chars / max(1, chars[0])
    marked, good = named_parts(tree, cover)
    # an article holds text, and this node is neither in it nor around it
    article = np.array([tag in CONTENT_PARTS for tag in tree.tag]) & ~marked & (chars > 0)
    inside, around = article.copy(), article.copy()
    for k in range(n - 1, 0, -1):
        around[tree.parent[k]] |= around[k]
    out = np.zeros((n, len(FEATURES)))
    under = [0] * n  # what the nearest marked element around a node is: -1 boilerplate, 1 article
    for k, tag in enumerate(tree.tag):
        up = tree.parent[k]
        inside[k] |= k > 0 and inside[up]
        under[k] = -1 if marked[k] else 1 if good[k] else under[up] if k else 0
        out[k] = (1, tag == "#text", tag in PAGE_PARTS, tag in CONTENT_PARTS, tag in HEADINGS, tag in LIST_PARTS, tag == "p",
                  bool(tree.name[k] & BAD), good[k], tree.hidden[k], 0, 0, 0, 0, 0, 0, 0, under[k] < 0, under[k] > 0,
                  bool(tree.name[k] & BAD) * cover[k], article.any() and not inside[k] and not around[k])
    out[:, 10] = share
    out[:, 11] = share > 0.9
    out[:, 12] = (share < 0.1) & (words >= 20)
    out[:, 13] = np.log1p(words) / 5
    out[:, 14] = words < 6
    out[:, 15] = np.minimum(ends / np.maximum(words, 1) * 10, 2)
    out[:, 16] = np.log1p(boxes) / 5
    return out


@dataclass
class Model:
    unary: np.ndarray  # features: weight of "content"
    pair: np.ndarray  # edge kind x parent label x child label


def _levels(parent: np.ndarray) -> list[np.ndarray]:
    """Node numbers by depth, roots first."""
    depth = np.zeros(len(parent), dtype=np.int64)
    for k, p in enumerate(parent.tolist()):  # parents come first
        if p >= 0:
            depth[k] = depth[p] + 1
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.cumsum(np.bincount(depth))[:-1])


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def sweep(model: Model, features: np.ndarray, parent: np.ndarray, leaf: np.ndarray,
          levels: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sum-product over a forest: P(content) per node, and P(parent label, child label) per node with a parent."""
    levels = _levels(parent) if levels is None else levels
    own = np.column_stack([np.zeros(len(parent)), features @ model.unary])
    kind = leaf.astype(int)
    below = own.copy()  # own potential times the messages from the children
    up = np.zeros_like(own)  # message to the parent, by the parent's label
    for nodes in reversed(levels[1:]):
        up[nodes] = _log_sum(model.pair[kind[nodes]] + below[nodes][:, None, :], axis=2)
        np.add.at(below, parent[nodes], up[nodes])
    full = below.copy()
    joint = np.zeros((len(parent), 2, 2))
    for nodes in levels[1:]:
        rest = full[parent[nodes]] - up[nodes]  # everything at the parent but this child
        table_ = rest[:, :, None] + model.pair[kind[nodes]] + below[nodes][:, None, :]
        full[nodes] = below[nodes] + _log_sum(rest[:, :, None] + model.pair[kind[nodes]], axis=1)
        table_ = np.exp(table_ - table_.max(axis=(1, 2), keepdims=True))
        joint[nodes] = table_ / table_.sum(axis=(1, 2), keepdims=True)
    return 1 / (1 + np.exp(np.clip(full[:, 0] - full[:, 1], -60, 60))), joint


def flatten(trees: list[Tree]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, parents and leaf marks of many pages as one forest."""
    starts = np.cumsum([0] + [len(t.tag) for t in trees])
    features = np.vstack([node_features(t) for t in trees])
    parent = np.concatenate([np.where(np.array(t.parent) < 0, -1, np.array(t.parent) + s) for t, s in zip(trees, starts)])
    leaf = np.concatenate([np.array([x == "#text" for x in t.tag]) for t in trees])
    return features, parent, leaf


def _spread_labels(tree: Tree) -> np.ndarray:
    """Text blocks take the nearest labelled ancestor's label (none: other), elements the majority of their text."""
    n = len(tree.tag)
    given, good, total = np.zeros(n, dtype=int), np.zeros(n), np.zeros(n)
    for k in range(n):
        up = given[tree.parent[k]] if k else 0
        given[k] = tree.label[k] if tree.label[k] >= 0 else up
        if tree.text[k]:
            total[k], good[k] = len(tree.text[k]), given[k] * len(tree.text[k])
    for k in range(n - 1, 0, -1):
        good[tree.parent[k]] += good[k]
        total[tree.parent[k]] += total[k]
    return np.where(total > 0, good > total / 2, given).astype(int)


def train(trees: list[Tree], iterations: int = ITERATIONS, l2: float = 0.002) -> Model:
    """Maximum likelihood by gradient ascent; expected counts come from the sweeps."""
    features, parent, leaf = flatten(trees)
    labels = np.concatenate([_spread_labels(t) for t in trees])
    levels, kind = _levels(parent), leaf.astype(int)
    child = np.flatnonzero(parent >= 0)
    seen = np.zeros((EDGES, 2, 2))
    np.add.at(seen, (kind[child], labels[parent[child]], labels[child]), 1)
    model = Model(np.zeros(len(FEATURES)), np.zeros((EDGES, 2, 2)))
    size = len(FEATURES)
    m, v = np.zeros(size + EDGES * 4), np.zeros(size + EDGES * 4)
    for step in range(1, iterations + 1):
        p, joint = sweep(model, features, parent, leaf, levels)
        expected = np.zeros((EDGES, 2, 2))
        np.add.at(expected, kind[child], joint[child])
        grad = np.concatenate([features.T @ (labels - p), (seen - expected).ravel()]) / len(labels)
        grad -= l2 * np.concatenate([model.unary, model.pair.ravel()])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad ** 2
        by = 0.15 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-9)
        model = Model(model.unary + by[:size], model.pair + by[size:].reshape(EDGES, 2, 2))
    return model


def self_label(tree: Tree) -> bool:
    """Label a page by the names of its parts; False when it names no article."""
    chars = np.array([float(len(t)) for t in tree.text])
    for k in range(len(chars) - 1, 0, -1):
        chars[tree.parent[k]] += chars[k]
    marked, _ = named_parts(tree, chars / max(1.0, chars[0]))
    named = False
    for k, tag in enumerate(tree.tag):
        if marked[k]:
            tree.label[k] = 0
        elif tag in CONTENT_PARTS:
            tree.label[k], named = 1, True
    return named


_BOXES = (("header", ("site-header", "masthead", "top-banner")), ("nav", ("menu", "navbar", "breadcrumb")),
          ("aside", ("sidebar", "widget", "related-posts", "rail")), ("div", ("ad", "advert", "sponsored", "promo-box")),
          ("div", ("cookie-notice", "consent-banner", "alert")), ("form", ("newsletter-form", "search-form", "login")),
          ("section", ("comments", "comment-list", "discussion", "replies")), ("div", ("share-buttons", "social")),
          ("footer", ("site-footer", "copyright")))
_ARTICLES = (("article", ""), ("main", ""), ("div", "post-content"), ("div", "article-body"), ("section", "story"), ("div", "entry"))
#: Names that containers and articles carry besides: layouts and states, no boxes.
_LAYOUTS = ("single-post no-sidebar", "has-header", "page with-nav", "layout sidebar-left", "logged-out cookies-not-set", "comments-open",
            "widget-area-off", "grid", "site", "home page-template", "footer-fixed")
_STYLES = ("story-more", "post more-info", "article-tags-x", "h-entry", "featured", "post comments-open")
_FILLER = ("This line stands for a paragraph of an article, long enough to read like one, with a clause and an end. ",
           "Another paragraph follows it, and tells a little more about the same thing before the page goes on.")


def redress(blocks: list[str], scraps: list[str], rng: random.Random) -> str:
    """A labelled page: the article's blocks in another dress, among boxes of boilerplate."""
    def box() -> str:
        tag, names = rng.choice(_BOXES)
        name = rng.choice(names)
        shown = tag if rng.random() < 0.5 else "div"
        mark = f' {rng.choice(("class", "id"))}="{name}"' if shown == "div" or rng.random() < 0.5 else ""
        texts = [escape(t) for t in rng.choices(scraps, k=rng.randint(1, 4))]
        if name.startswith(("comment", "discussion", "replies")):  # readers write prose, too
            inner = "".join(f"<div class='comment'><p>{escape(t)}</p></div>" for t in rng.choices(blocks, k=rng.randint(1, 4)))
            mark = mark or f' class="{name}"'
        elif tag in ("nav", "aside", "header") or name.startswith(("share", "social")):
            inner = "<ul>" + "".join(f"<li><a href='#'>{t}</a></li>" for t in texts) + "</ul>"
        elif tag == "form":
            inner = f"<label>{texts[0]}</label><input name='x'><p>{texts[-1]}</p>"
        else:
            inner = "".join(f"<p>{t}</p>" for t in texts) if rng.random() < 0.5 else " ".join(texts)
        return f'<{shown}{mark} data-label="0">{inner}</{shown}>'

    def remarks() -> str:
        """Readers' comments in a list or boxes that no name tells."""
        texts = [escape(t) for t in rng.choices(blocks, k=rng.randint(1, 4))]
        if rng.random() < 0.5:
            return '<ol data-label="0">' + "".join(f"<li><p>{t}</p></li>" if rng.random() < 0.5 else f"<li>{t}</li>" for t in texts) + "</ol>"
        return '<div data-label="0">' + "".join(f"<div><p>{t}</p></div>" for t in texts) + "</div>"

    tag, name = rng.choice(_ARTICLES)
    if rng.random() < 0.4:
        name = " ".join(filter(None, (name, rng.choice(_STYLES))))
    if rng.random() < 0.3:  # a very short article: its place has to tell
        blocks = [" ".join(b.split()[:rng.randint(1, 6)]) for b in blocks[:rng.randint(1, 2)]]
    inside = [f"<h1>{escape(blocks[0][:60])}</h1>"]
    for b in blocks:
        kind = rng.random()
        inside.append(f"<p>{escape(b)}</p>" if kind < 0.8 else f"<blockquote><p>{escape(b)}</p></blockquote>" if kind < 0.87
                      else f"<h2>{escape(b[:40])}</h2>" if kind < 0.94 else f"<ul><li>{escape(b)}</li><li>{escape(b[:50])}</li></ul>")
    if rng.random() < 0.4:
        inside.insert(rng.randint(1, len(inside)), box())
    body = [box() for _ in range(rng.randint(1, 4))]
    article = f'<{tag}{f" class={chr(34)}{name}{chr(34)}" if name else ""} data-label="1">{"".join(inside)}</{tag}>'
    tail = [box() for _ in range(rng.randint(0, 3))]
    if tag in CONTENT_PARTS and rng.random() < 0.4:
        tail.insert(0, remarks())
    page = "".join(body) + article + "".join(tail)
    layout = lambda: f' class="{rng.choice(_LAYOUTS)}"' if rng.random() < 0.5 else ""
    if rng.random() < 0.5:
        shell = rng.choice(("div", "div", "section", "form"))
        page = f"<{shell}{layout() or ' id=wrap'}>{page}</{shell}>"
    return f"<body{layout()}>{page}</body>"


def labelled_pages(htmls: list[str], seed: int = 7) -> list[Tree]:
    """Self-labelled pages and two re-dressed copies of each."""
    rng, out, material = random.Random(seed), [], []
    for html in htmls:
        tree = parse(html)
        if not self_label(tree):
            continue
        labels = _spread_labels(tree)
        good = [t for t, y in zip(tree.text, labels) if t and y]
        scraps = [t for t, y in zip(tree.text, labels) if t and not y]
        if good:
            out.append(tree)
            material.append((good[:12], scraps or list(_FILLER)))
    material = material or [(list(_FILLER), ["Home", "About us", "Subscribe now", "All rights reserved."])] * 40
    return out + [parse(redress(*m, rng), True) for m in material for _ in range(2)]


def fit_pages(pages: DataFrame, max_pages: int = MAX_PAGES) -> Model:
    """Trained on one page per id (the least html of an id's rows); rows without an id train nothing."""
    known = pages.filter("html is not null and page_id is not null").select("page_id", "html")
    rows = (hashed_sample(known, "page_id", max_pages, known.select("page_id").distinct().count())
            .groupBy("page_id").agg(F.min("html").alias("html")))
    return train(labelled_pages([r["html"] for r in rows.orderBy("page_id").collect()]))


def extract_batch(model: Model, htmls: list[str | None]) -> list[str]:
    """Main texts of many pages: blocks whose content marginal is over one half."""
    trees = [parse(h) for h in htmls]
    if not trees:
        return []
    p, _ = sweep(model, *flatten(trees))
    out, at = [], 0
    for t in trees:
        out.append("\n\n".join(text for k, text in enumerate(t.text) if text and p[at + k] > 0.5))
        at += len(t.tag)
    return out


def main_text(model: Model, html: str = "html", together: int = 256) -> Column:
    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for htmls in batches:
            values = htmls.to_list()
            yield pd.Series([t for a in range(0, len(values), together) for t in extract_batch(model, values[a:a + together])],
                            dtype="object")
    return extract(F.col(html))


def extract_pages(pages: DataFrame, model: Model) -> DataFrame:
    return (pages.select("page_id", "url", main_text(model).alias("text"))
            .withColumn("n_chars", F.length("text").cast("long")))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract_pages(pages, fit_pages(pages))
