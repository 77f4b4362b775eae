"""The `documents` table as the pages and sections of one site, and its stored index."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagesearch.functions.text import prepare_text
from pagesearch.functions.urls import url_section
from pagesearch.operators.extract import with_ids
from pagesearch.operators.hierarchy import with_hierarchy, with_score
from pagesearch.operators.validate import drop_root_page, keep_valid_pages
from pagesearch.plans.index_site import SearchIndex, buckets_for, enrich, open_index, store_index
from pagesearch.session import work_folder
from pagesearch.sources.store import IndexStore, page_bucket
from pagesearch.workload import table
from pagesearch.workload.sites import CORPUS, ROOT


def corpus_pages(documents: DataFrame) -> DataFrame:
    """Rows ``(page_id, url, title, text)`` of the documents."""
    url = F.concat_ws("/", F.lit(ROOT), "source", "lang", F.col("doc_id").cast("string"))
    first_line = F.substring_index(F.substring_index("text", "\n", 1), ".", 1)
    return documents.select(
        F.col("doc_id").alias("page_id"), url.alias("url"),
        prepare_text(first_line, CORPUS.literal_terms, True).alias("title"), "text",
        "source", "lang")


def split_documents(pages: DataFrame, *more: str) -> DataFrame:
    """Page document of the whole text and one section document per line, from one scan; they keep ``more`` columns.

    A page marked ``as_it_is``, where there is such a column, is one document with the text as it stands.
    """
    as_it_is = F.col("as_it_is") if "as_it_is" in pages.columns else F.lit(False)
    parts = F.concat(F.array("text"), F.when(as_it_is, F.array().cast("array<string>")).otherwise(F.split("text", "\n", -1)))
    crumbs = F.col("hierarchy") if "hierarchy" in pages.columns else F.array().cast("array<string>")
    split = pages.select("page_id", "url", "title", as_it_is.alias("as_it_is"), crumbs.alias("hierarchy"), *more,
                         F.posexplode(parts).alias("n", "raw"))
    is_page = F.col("n") == 0
    rows = split.select(
        "page_id", F.lit(ROOT).alias("site"), "url", "title", F.lit("").alias("section_title"),
        "hierarchy", url_section(F.lit(ROOT), F.col("url")).alias("s"),
        F.when(F.col("as_it_is"), F.col("raw")).when(is_page, prepare_text(F.col("raw"), CORPUS.literal_terms, True))
        .otherwise(prepare_text(F.col("raw"), CORPUS.literal_terms)).alias("body"),
        F.when(is_page, "page").otherwise("section").alias("type"),
        F.greatest(F.col("n") - 1, F.lit(0)).alias("position"), *more)
    return with_ids(rows, CORPUS, *more)


def pages_above(pages: DataFrame) -> DataFrame:
    """Rows ``(page_id, url, title)`` above the documents: one per source, one per source and language."""
    def pages_at(title: Column, *path: str) -> DataFrame:
        rows = pages.select(*path).distinct()
        url = F.concat_ws("/", F.lit(ROOT), *path)
        # an id of its own below zero, so that validation can drop one page and keep the others
        page_id = -F.conv(F.substring(F.md5(url), 1, 12), 16, 10).cast("long") - 1
        return rows.select(page_id.alias("page_id"), url.alias("url"), title.alias("title"))

    return pages_at(F.concat(F.lit("Source "), "source"), "source").unionByName(
        pages_at(F.concat(F.lit("Language "), "lang"), "source", "lang"))


def index_pages(pages: DataFrame) -> DataFrame:
    """The documents of ``pages_above``."""
    rows = pages_above(pages).select(
        "page_id", F.lit(ROOT).alias("site"), "url", "title", F.lit("").alias("section_title"),
        F.array().cast("array<string>").alias("hierarchy"), url_section(F.lit(ROOT), F.col("url")).alias("s"),
        F.col("title").alias("body"), F.lit("page").alias("type"), F.lit(0).alias("position"))
    return with_ids(rows, CORPUS)


def corpus_documents(spark: SparkSession, folder: str) -> DataFrame:
    pages = corpus_pages(table(spark, folder, "documents"))
    return split_documents(pages).unionByName(index_pages(pages))


def scored_corpus(spark: SparkSession, folder: str) -> DataFrame:
    return enrich(corpus_documents(spark, folder), CORPUS)


_stores: dict[tuple[str, str], IndexStore] = {}


def whole_pages(documents: DataFrame) -> DataFrame:
    """The pages of ``corpus_documents`` that are not the root, before they are split."""
    pages = corpus_pages(documents)
    above = pages_above(pages).select("page_id", "url", "title", F.col("title").alias("text"), F.lit(True).alias("as_it_is"))
    rows = pages.select("page_id", "url", "title", "text", F.lit(False).alias("as_it_is")).unionByName(above)
    # a page without text has no documents, so it gives no title either; one above has its document, without an id
    return drop_root_page(rows.filter(F.col("text").isNotNull() | F.col("as_it_is")).select(
        "*", F.lit(ROOT).alias("site"), F.array().cast("array<string>").alias("hierarchy")))


def placed_corpus(documents: DataFrame, doc_buckets: int) -> DataFrame:
    """What ``scored_corpus`` gives, partitioned by a ``doc_bucket`` column.

    Breadcrumbs belong to pages, and so do buckets: pages are moved, once for each, and split into their documents where they
    then lie. The documents, which hold each text twice, are moved and stored nowhere before.
    """
    pages = with_hierarchy(whole_pages(documents))
    page = F.when(F.col("title").isNotNull(), F.col("url"))     # ids without a title are null, and all of one key
    moved = pages.withColumn("doc_bucket", page_bucket(F.col("site"), page, doc_buckets)).repartition(doc_buckets, "doc_bucket")
    return with_score(keep_valid_pages(split_documents(moved, "doc_bucket"), CORPUS.validators), CORPUS)


def build_index(spark: SparkSession, folder: str, buckets: int = 16) -> IndexStore:
    """Write and publish a new version of the corpus index."""
    store = IndexStore(spark, work_folder(spark), f"corpus-{zlib.crc32(folder.encode())}")
    documents = table(spark, folder, "documents")
    # a document per text and per line; its text is in one of each, and its URL and section in all
    lines = 2 + F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    held = documents.agg(F.sum(lines).alias("docs"), F.sum(2 * F.length("text") + 100 * lines).alias("chars")).first()
    doc_buckets = buckets_for(held.docs or 0, held.chars or 0)
    store.publish_unless_empty(store_index(placed_corpus(documents, doc_buckets), CORPUS, store, buckets, doc_buckets=doc_buckets))
    return store


def corpus_index(spark: SparkSession, folder: str, buckets: int = 16) -> SearchIndex:
    """The stored index of a folder, built on first use in a session."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _stores:
        _stores[key] = build_index(spark, folder, buckets)
    return open_index(_stores[key], CORPUS)
