"""HTML text extraction over a table of pages (id, url, html).

Rules: drop every ``nav footer script style header`` element with its
content; take the first ``main`` left, else the first ``article``, else ``body``,
else the whole page as the root; every text node under it is stripped and
non-empty nodes are joined by a line break; empty lines are dropped and the
result stripped. ``title`` is the stripped ``<title>`` text (NULL when
absent or empty); ``url`` is the href of the first canonical link, else (no such link,
or an empty href) the row's url. Pages that yield no text give no row.

Parsing is per document, so the text nodes come from an Arrow UDF over batches of rows
with the standard-library parser; stripping, joining, line rules, URL fallback and the
empty filter are native column expressions. The parser keeps counters instead of ancestor
lists, so a page costs time in proportion to its length, however deep its tags are.
"""

from __future__ import annotations

from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from docyard.functions.text import bind_column, py_strip, split_lines, with_column_where

# Elements removed with their content.
STRIP_TAGS = ("nav", "footer", "script", "style", "header")
# Root candidates in order of preference.
ROOT_TAGS = ("main", "article", "body")
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that end when one of their own kind begins.
SELF_CLOSING = frozenset(("p", "li", "td", "th", "tr", "option", "dt", "dd"))


class _Nodes(HTMLParser):
    """Text nodes outside removed elements, each with the bits of the roots it lies in."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[str] = []
        self.count: Counter = Counter()
        self.removed = 0                     # open removed elements
        self.root_at: dict[str, int] = {}    # depth of a root candidate while it is open
        self.seen: set[str] = set()
        self.nodes: list[tuple[str, frozenset[str]]] = []
        self.title: list[str] | None = None
        self.in_title = False
        self.canonical: str | None = None
        self.canonical_seen = False
        self.parts: list[str] = []

    def flush(self) -> None:
        if self.parts:
            if not self.removed:
                self.nodes.append(("".join(self.parts), frozenset(self.root_at)))
            self.parts = []

    def _pop(self) -> None:
        tag = self.open.pop()
        self.count[tag] -= 1
        if tag in STRIP_TAGS:
            self.removed -= 1
        if self.root_at.get(tag) == len(self.open):
            del self.root_at[tag]

    def handle_starttag(self, tag, attrs):
        self.flush()
        if tag == "link" and not self.canonical_seen:
            own = dict(attrs)
            if "canonical" in (own.get("rel") or "").lower().split():
                self.canonical, self.canonical_seen = own.get("href"), True
        if tag in VOID_TAGS:
            return
        if tag in SELF_CLOSING and self.open and self.open[-1] == tag:
            self._pop()
        if tag in ROOT_TAGS and tag not in self.seen and not self.removed:
            self.seen.add(tag)
            self.root_at[tag] = len(self.open)
        if tag in STRIP_TAGS:
            self.removed += 1
        self.open.append(tag)
        self.count[tag] += 1
        if tag == "title" and self.title is None:
            self.title, self.in_title = [], True

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.flush()
        if self.count[tag]:
            while self.open[-1] != tag:
                self._pop()
            self._pop()
        if tag == "title":
            self.in_title = False

    def handle_data(self, data):
        if self.in_title and self.title is not None:
            self.title.append(data)
        self.parts.append(data)

    def handle_comment(self, data):
        self.flush()


def text_nodes(html: str | None) -> tuple[list[str], str | None, str | None]:
    """(text nodes under the root, raw title, href of the first canonical link) of one page."""
    if html is None:
        return [], None, None
    p = _Nodes()
    p.feed(html.replace("\r\n", "\n").replace("\r", "\n"))
    p.close()
    p.flush()
    root = next((t for t in ROOT_TAGS if t in p.seen), None)
    return ([text for text, roots in p.nodes if root is None or root in roots],
            "".join(p.title) if p.title is not None else None, p.canonical)


_NODES_OUT = StructType([StructField("nodes", ArrayType(StringType())), StructField("title", StringType()),
                         StructField("canonical", StringType())])


@F.arrow_udf(_NODES_OUT)
def _nodes_udf(htmls: pa.Array) -> pa.Array:
    nodes, titles, links = [], [], []
    for h in htmls.to_pylist():
        n, t, c = text_nodes(h)
        nodes.append(n)
        titles.append(t)
        links.append(c)
    return pa.StructArray.from_arrays([pa.array(nodes, pa.list_(pa.string())), pa.array(titles, pa.string()),
                                       pa.array(links, pa.string())], names=["nodes", "title", "canonical"])


def _present(items: Column) -> Column:
    return F.filter(items, lambda x: x != F.lit(""))


def html_documents(pages: DataFrame, html_col: str = "html", url_col: str = "url", keep_empty: bool = False) -> DataFrame:
    """One document row per page with text (``keep_empty``: every page, NULL without text); other columns are carried."""
    keep = [c for c in pages.columns if c != html_col]
    # the parse result is bound once and filtered in place, so no copy of the
    # parse is pushed below earlier operators by the empty-page filter
    parsed = with_column_where(pages.select(*keep, html_col), "_x", _nodes_udf(F.col(html_col)),
                               lambda x: F.lit(True) if keep_empty else F.size(x["nodes"]) > 0)
    joined = F.array_join(_present(F.transform("_x.nodes", py_strip)), "\n")
    content = py_strip(F.array_join(_present(split_lines(joined)), "\n"))
    if keep_empty:
        out = bind_column(parsed, "content", content).withColumn("content", F.when(F.col("content") != "", F.col("content")))
    else:
        out = with_column_where(parsed, "content", content, lambda c: c != F.lit(""))
    return out.select(
        *[c for c in keep if c != url_col],
        "content",
        py_strip(F.when(F.col("_x.title") != "", F.col("_x.title"))).alias("title"),
        F.coalesce(F.when(F.col("_x.canonical") != "", F.col("_x.canonical")), F.col(url_col)).alias("url"),
        F.lit("html").alias("format"),
    )


__all__ = ["html_documents", "text_nodes", "STRIP_TAGS", "ROOT_TAGS"]
