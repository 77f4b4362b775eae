"""Page and section rows from an HTML tree, one pass per page inside ``mapInPandas``.

Python only walks the tree; text clean-up, escaping, ids and everything after are native columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from pagesearch.config import SiteConfig
from pagesearch.functions.text import prepare_text
from pagesearch.functions.urls import normalize_url, url_section
from pagesearch.operators.extract import page_title, with_ids

# HTML tags without content.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = {"script", "style", "template"}
PART_SCHEMA = ("page_id long, site string, url string, title string, position int, heading string, "
               "text string, error string")


class _Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag, attrs=(), parent=None):
        self.tag, self.attrs, self.children, self.parent = tag, dict(attrs), [], parent

    def walk(self):
        stack = [self]
        while stack:
            node = stack.pop()
            if isinstance(node, _Node):
                yield node
                stack.extend(reversed(node.children))

    def text(self):
        pieces, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                pieces.append(node)
            elif node.tag not in HIDDEN:
                stack.extend(reversed(node.children))
        return "".join(pieces)

    def only_string(self):
        node = self
        while isinstance(node, _Node):
            if len(node.children) != 1:
                return None
            node = node.children[0]
        return node

    def matches(self, selector):
        tag, _, name = selector.partition("." if "." in selector else "#")
        if tag and self.tag != tag:
            return False
        if "." in selector:
            return name in (self.attrs.get("class") or "").split()
        return "#" not in selector or self.attrs.get("id") == name


class _Tree(HTMLParser):
    """Lenient tree: an end tag closes up to its start tag, a stray end tag is ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.here = _Node("[document]")

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, attrs, self.here)
        self.here.children.append(node)
        if tag not in VOID:
            self.here = node

    def handle_startendtag(self, tag, attrs):
        self.here.children.append(_Node(tag, attrs, self.here))

    def handle_endtag(self, tag):
        node = self.here
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.here = node.parent

    def handle_data(self, data):
        siblings = self.here.children
        if siblings and isinstance(siblings[-1], str):
            siblings[-1] += data
        else:
            siblings.append(data)


def _first(root, selectors):
    for selector in selectors:
        for node in root.walk():
            if node.matches(selector):
                return node
    return root


def page_parts(html: str, selectors, header_tags):
    """Yield ``(title, position, heading, text)``: the page at position -1, then its sections."""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    title_node = next((n for n in tree.root.walk() if n.tag == "title"), None)
    title = title_node.only_string() if title_node else None
    content = _first(tree.root, selectors)
    yield title, -1, "", content.text()
    headings = []
    for tag in header_tags:
        headings = [n for n in content.walk() if n is not content and n.tag == tag]
        if headings:
            break
    for position, heading in enumerate(headings):
        named = heading
        if heading.only_string() is None:
            named = next((n for n in heading.walk() if n.tag == "a"), None)
        siblings = heading.parent.children
        at = next(i for i, child in enumerate(siblings) if child is heading)
        pieces = []
        for sibling in siblings[at + 1:]:
            if isinstance(sibling, _Node):
                # a section ends at the next heading of the first configured tag
                if sibling.tag == header_tags[0]:
                    break
                pieces.append(sibling.text())
            else:
                pieces.append(sibling)
        yield title, position, named.text() if named else "", "\n".join(pieces)


def parse_pages(pages: DataFrame, config: SiteConfig) -> DataFrame:
    """Raw parts of every page; a page that cannot be parsed becomes a row with an error."""
    selectors, header_tags = config.content_selectors, config.header_tags

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["page_id", "site", "url", "title", "position", "heading", "text", "error"]

        def table(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=columns).astype({"page_id": "int64", "position": "int32"})

        for batch in batches:
            rows, held = [], 0
            for page in batch.itertuples(index=False):
                # sections overlap, so what a page yields can be many times its size
                if held > 4_000_000:
                    yield table(rows)
                    rows, held = [], 0
                key = (page.page_id, page.site, page.url)
                try:
                    parts = list(page_parts(page.html or "", selectors, header_tags))
                    rows.extend((*key, *part, None) for part in parts)
                    held += sum(len(part[-1]) for part in parts)
                except Exception as error:  # a broken page must not fail the load
                    rows.append((*key, None, -1, None, None, f"parse error: {type(error).__name__}"))
            yield table(rows)

    return pages.select("page_id", "site", "url", "html").mapInPandas(parse, PART_SCHEMA)


def documents_from_parts(parts: DataFrame, config: SiteConfig) -> DataFrame:
    """Page and section documents of the pages that have a title."""
    terms = config.literal_terms
    is_page = F.col("position") < 0
    usable = parts.filter(F.col("error").isNull() & (F.coalesce("title", F.lit("")) != ""))
    rows = usable.select(
        "page_id", "site", normalize_url(F.col("url")).alias("url"),
        page_title(F.col("title"), terms).alias("title"),
        prepare_text(F.col("heading"), terms).alias("section_title"),
        F.array().cast("array<string>").alias("hierarchy"),
        url_section(F.col("site"), F.col("url")).alias("s"),
        F.when(is_page, prepare_text(F.col("text"), terms, strip_symbols=True))
        .otherwise(prepare_text(F.col("text"), terms)).alias("body"),
        F.when(is_page, "page").otherwise("section").alias("type"),
        F.greatest(F.col("position"), F.lit(0)).alias("position"))
    return with_ids(rows, config)


def rejected_parts(parts: DataFrame) -> DataFrame:
    missing = F.when(F.coalesce("title", F.lit("")) == "", F.lit("missing title"))
    bad = parts.filter(F.col("position") < 0).withColumn("reason", F.coalesce("error", missing))
    return bad.filter(F.col("reason").isNotNull()).select("page_id", "url", "reason")
