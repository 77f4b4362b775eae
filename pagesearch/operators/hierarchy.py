"""Breadcrumbs: the titles of the pages above a URL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagesearch.functions.text import let
from pagesearch.functions.urls import trim_slashes
from pagesearch.operators.skew import salted_join


def url_title_map(docs: DataFrame) -> DataFrame:
    """One title per URL, the one of the highest page id; double slashes leave the title."""
    title = F.replace("title", F.lit("//"), F.lit(""))
    last = F.max(F.struct("page_id", title.alias("title"))).alias("last")
    return docs.groupBy("site", trim_slashes(F.col("url")).alias("url")).agg(last) \
        .select("site", "url", F.col("last.title").alias("title"))


def url_prefixes(site: Column, url: Column) -> Column:
    """The URLs of all levels from below the site's root down to the URL itself."""
    path = F.replace(F.replace(url, site, F.lit("")), F.lit("//"), F.lit("/"))
    parts = F.split(F.regexp_replace(path, r"\A/+|/+\z", ""), "/")
    return let(parts, lambda p: F.transform(
        F.sequence(F.lit(1), F.size(p)), lambda i: F.concat_ws("/", trim_slashes(site), F.slice(p, F.lit(1), i))))


def url_hierarchy(titles: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Rows ``(site, url, hierarchy)`` for every URL of a URL-to-title map, or for those of ``wanted(site, url)``.

    A URL's own title needs no lookup. The prefixes above it do, and a top-level prefix is shared
    by a large part of the site: prefixes are made distinct first, so only the titles of inner
    pages are repeated per salt, and the many lookups of one prefix are spread over the salts.
    """
    asked = titles if wanted is None else titles.join(wanted.select("site", "url").distinct(), ["site", "url"])
    lookups = asked.select("site", "url", F.col("title").alias("own_title"),
                           F.posexplode(url_prefixes(F.col("site"), F.col("url"))).alias("level", "prefix"))
    own = lookups.filter(F.col("prefix") == F.col("url")) \
        .select("site", "url", "level", F.col("own_title").alias("title"))
    above = lookups.filter(F.col("prefix") != F.col("url")).select("site", "url", "level", "prefix")
    inner = above.select("site", "prefix").distinct() \
        .join(titles.select("site", F.col("url").alias("prefix"), "title"), ["site", "prefix"])
    found = salted_join(above, inner, ["site", "prefix"], ["url"]).select("site", "url", "level", "title")
    steps = own.unionByName(found).filter(F.col("title") != "")
    ordered = F.array_sort(F.collect_list(F.struct("level", "title")))
    return steps.groupBy("site", "url").agg(F.transform(ordered, lambda s: s["title"]).alias("hierarchy"))


def with_hierarchy(docs: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """Replace the hierarchy of documents by the resolved one; ``titles`` is the URL-to-title map when they are not all."""
    keys = docs.select("site", trim_slashes(F.col("url")).alias("url"))
    known = (url_hierarchy(url_title_map(docs)) if titles is None else url_hierarchy(titles, keys)).withColumnsRenamed({"url": "_url", "hierarchy": "_found"})
    keyed = docs.withColumn("_url", trim_slashes(F.col("url")))
    joined = keyed.join(known, ["site", "_url"], "left")
    empty = F.array().cast("array<string>")
    return joined.withColumn("hierarchy", F.coalesce("_found", empty)).select(*docs.columns)


def with_score(docs: DataFrame, config) -> DataFrame:
    """Add the document score; see ``SiteConfig.score_hierarchy`` for what the scorers see."""
    from pagesearch.functions.scores import document_score

    seen = F.col("hierarchy") if config.score_hierarchy == "resolved" else F.array().cast("array<string>")
    return docs.withColumn("score", document_score(config.scorers, F.col("type"), seen))
