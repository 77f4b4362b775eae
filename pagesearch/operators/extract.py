"""Pages to documents with native expressions: title, content, text, ids and keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagesearch.config import SiteConfig
from pagesearch.functions.text import decode_entities, element_text, let, prepare_text
from pagesearch.functions.urls import normalize_url, url_section

TITLE = r"(?is)<title[^>]*>(.*?)</title>"
DOCUMENT_COLUMNS = ["page_id", "site", "doc_key", "doc_id", "url", "title", "section_title",
                    "hierarchy", "s", "body", "type", "position"]


def raw_title(html: Column) -> Column:
    """The title as written, null when it is absent, empty or holds markup."""
    found = F.regexp_extract(F.coalesce(html, F.lit("")), TITLE, 1)
    return F.when((found != "") & ~found.rlike(r"<[A-Za-z/!]"), decode_entities(found))


def page_title(raw: Column, terms=()) -> Column:
    return prepare_text(F.substring_index(raw, "|", 1), terms, strip_symbols=True)


def element_content(html: Column, tag: str | Column) -> Column:
    """Inside of the first element of a tag, nested ones of the same tag included; null when there is none.

    The text behind the opening tag is cut before every tag of that name; the pieces up to the one
    that closes the first belong to it. An element that never closes ends with the page.
    """
    def pattern(*around: str) -> Column:
        """The texts laced with the tag's name."""
        if isinstance(tag, str):
            return F.lit(tag.join(around))
        return F.concat(F.lit(around[0]), *[piece for text in around[1:] for piece in (tag, F.lit(text))])

    opening, start, end = pattern("(?i)<", r"(?:\s[^>]*)?>"), pattern(r"(?i)\A<", r"[\s>]"), pattern(r"(?i)\A</", r"\s*>")
    def step(seen: Column, piece: Column) -> Column:
        depth = seen["depth"] + F.when(F.rlike(piece, end), -1).when(F.rlike(piece, start), 1).otherwise(0)
        inside = (seen["depth"] > 0) & (depth > 0)
        return F.struct(F.when(seen["depth"] > 0, depth).otherwise(0).alias("depth"),
                        (seen["size"] + F.when(inside, F.length(piece)).otherwise(0)).alias("size"))

    nothing = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("size"))
    cuts = pattern("(?i)(?=<", r"[\s>]|</", r"\s*>)")
    return let(F.get(F.split(html, opening, 2), F.lit(1)), lambda behind: F.left(
        behind, F.aggregate(F.split(behind, cuts, -1), nothing, step, lambda seen: seen["size"])))


def tag_content(html: Column, tags: tuple[str, ...]) -> Column:
    """Inside of the first tag of the list that the page has, in list order, else the whole page."""
    return F.coalesce(*[element_content(html, tag) for tag in tags], html)


def page_doc_id(url: Column, body: Column, title: Column) -> Column:
    return F.concat(url, F.lit(":page:"), F.md5(F.concat(body, title)))


def section_doc_id(url: Column, position: Column, body: Column, title: Column, part: Column) -> Column:
    content = F.concat(body, part, title, position.cast("string"))
    return F.concat(url, F.lit(":section:"), F.md5(content))


def document_key(prefix: str, site: Column, doc_id: Column) -> Column:
    return F.concat_ws(":", F.lit(prefix), site, F.lit("doc"), doc_id)


def with_ids(parts: DataFrame, config: SiteConfig, *more: str) -> DataFrame:
    """Add content-hash id and storage key to page and section rows, which keep ``more`` columns."""
    url, body, title = F.col("url"), F.col("body"), F.col("title")
    doc_id = F.when(F.col("type") == "page", page_doc_id(url, body, title)).otherwise(
        section_doc_id(url, F.col("position"), body, title, F.col("section_title")))
    keyed = parts.withColumn("doc_id", doc_id)
    return keyed.withColumn("doc_key", document_key(config.key_prefix, F.col("site"), F.col("doc_id"))) \
        .select(*DOCUMENT_COLUMNS, *more)


def page_documents(pages: DataFrame, config: SiteConfig) -> DataFrame:
    """One page document per titled page, for sites whose content selectors are plain tags."""
    html = F.col("html")
    titled = pages.withColumn("raw_title", raw_title(html)).filter(F.col("raw_title").isNotNull())
    content = tag_content(html, config.content_selectors)
    rows = titled.select(
        "page_id", "site", normalize_url(F.col("url")).alias("url"),
        page_title(F.col("raw_title"), config.literal_terms).alias("title"),
        F.lit("").alias("section_title"), F.array().cast("array<string>").alias("hierarchy"),
        url_section(F.col("site"), F.col("url")).alias("s"),
        prepare_text(element_text(content), config.literal_terms, True).alias("body"),
        F.lit("page").alias("type"), F.lit(0).alias("position"))
    return with_ids(rows, config)
