"""Links of stored pages, and the reachable part of the link graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from pagesearch.functions.text import decode_entities, let
from pagesearch.functions.urls import link_base, resolve_link, site_of
from pagesearch.operators.skew import salted_join
from pagesearch.session import cut_lineage

# a link tag up to its target, which may be quoted
HREF = r"""(?i)<(?:a|area)\s(?:[^>]*\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""


BASE = HREF.replace("(?:a|area)", "base")


def _bare(target: Column) -> Column:
    """A target without its quotes, character references decoded."""
    return decode_entities(F.regexp_replace(target, r"""\A["']|["']\z""", ""))


def hrefs(html: Column) -> Column:
    """Distinct link targets of a page, decoded; a page without text has none."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(HREF), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, _bare), lambda link: link != ""))


def extract_links(pages: DataFrame) -> DataFrame:
    """Rows ``(page_id, page_url, href)`` of all pages, rejected ones included."""
    return pages.select("page_id", F.col("url").alias("page_url"),
                        F.explode(hrefs(F.col("html"))).alias("href"))


def page_links(pages: DataFrame) -> DataFrame:
    """Rows ``(page_id, page_url, link_url)``: the absolute links of all pages, as a browser resolves them."""
    base = _bare(F.regexp_extract(F.coalesce("html", F.lit("")), BASE, 1))
    # base and links are found once per page; behind the explode there is no more of the page than them
    found = let(base, lambda own: let(link_base(F.col("url"), own), lambda b: F.transform(
        hrefs(F.col("html")), lambda h: F.struct(b.alias("base_url"), h.alias("href")))))
    based = pages.select("page_id", F.col("url").alias("page_url"), F.inline(found))
    return _resolved(based, F.col("base_url"))


def resolve_links(links: DataFrame) -> DataFrame:
    """``page_links`` of rows ``(page_id, page_url, href)`` from pages without a base."""
    return _resolved(links, F.col("page_url"))


def _resolved(links: DataFrame, base: Column) -> DataFrame:
    target = resolve_link(base, F.trim(F.col("href")))
    # the explode of one or no URL keeps the test for null from computing the URL again
    return links.select("page_id", "page_url", F.explode(F.split(target, "\x00")).alias("link_url")).distinct()


def same_site(links: DataFrame) -> DataFrame:
    """The links that stay on their own page's site (scheme and host)."""
    return links.filter(site_of(F.col("link_url")) == site_of(F.col("page_url")))


def allow_deny(url: Column, allow: Sequence[str], deny: Sequence[str]) -> Column:
    """True when any allow pattern is found in the URL (or there is none) and no deny pattern is."""
    kept = F.lit(True)
    if allow:
        kept = url.rlike("|".join(f"(?:{p})" for p in allow))
    if deny:
        kept = kept & ~url.rlike("|".join(f"(?:{p})" for p in deny))
    return kept


def crawl_order(edges: DataFrame, roots: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """Breadth-first visit of ``edges(src, dst)`` from ``roots(url)``: rows ``(url, depth)``.

    Every round joins only the new URLs with the edges. The edges of a hub page are spread over
    salts, targets are made distinct before the shuffle, and each round is checkpointed once:
    what was visited is the union of the rounds, which is read and never written again.
    """
    frontier = cut_lineage(roots.select("url").distinct().withColumn("depth", F.lit(0)))
    visited, depth = frontier, 0
    while max_rounds is None or depth < max_rounds:
        depth += 1
        reached = salted_join(edges, frontier.select(F.col("url").alias("src")), ["src"], ["dst"])
        fresh = reached.select(F.col("dst").alias("url")).distinct().join(visited, "url", "left_anti")
        frontier = cut_lineage(fresh.withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited
