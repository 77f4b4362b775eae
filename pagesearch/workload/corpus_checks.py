"""Checks on the `documents` table as one site: documents, breadcrumbs, scores, refresh."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagesearch.functions import scores as K
from pagesearch.functions.text import all_tokens, escape_literals, stem, tokens, unescape
from pagesearch.operators import hierarchy as H, links as L, postings as P, refresh as R, render, validate as V
from pagesearch.plans.index_site import SearchIndex, enrich
from pagesearch.session import materialize
from pagesearch.workload import Check, sqltext as Q, table
from pagesearch.workload.corpus import (corpus_documents, corpus_index, corpus_pages, index_pages, scored_corpus,
                                        split_documents)
from pagesearch.workload.sites import CORPUS, ROOT

T = CORPUS.literal_terms
_DOCS = f"WITH {Q.CORPUS_PARTS} "
_HIER = f"WITH {Q.CORPUS_HIERARCHY} "
_INDEX = f"WITH {Q.CORPUS_INDEX} "
_CRUMBS = "array_to_string(hierarchy, ' > ')"
_ELIDED = "CASE WHEN contains(body, '<b>') OR length(body) < 100 THEN body ELSE substring(body, 1, 100) || '...' END"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents")


def next_crawl(spark: SparkSession, folder: str) -> DataFrame:
    """A later crawl: toxic documents are gone, documents of low quality carry a note."""
    labels = table(spark, folder, "labels")
    gone = labels.filter("toxic = 1").select("doc_id")
    poor = labels.filter("quality = 0").select("doc_id", F.lit(" (archived)").alias("note"))
    kept = documents(spark, folder).join(gone, "doc_id", "left_anti").join(poor, "doc_id", "left")
    return corpus_pages(kept.withColumn("text", F.concat("text", F.coalesce("note", F.lit("")))))


def next_documents(spark: SparkSession, folder: str) -> DataFrame:
    pages = next_crawl(spark, folder)
    return split_documents(pages).unionByName(index_pages(pages))


_NEXT = Q.corpus_parts() + """,
crawl2 AS (
  SELECT d.doc_id, d.text || CASE WHEN p.doc_id IS NULL THEN '' ELSE ' (archived)' END AS text, d.lang, d.source
  FROM documents d LEFT JOIN (SELECT doc_id FROM labels WHERE quality = 0) p ON p.doc_id = d.doc_id
  WHERE d.doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),""" + Q.corpus_parts("crawl2", "2")


def refreshed(spark: SparkSession, folder: str) -> DataFrame:
    return R.refresh_diff(corpus_documents(spark, folder), next_documents(spark, folder))


def edges(spark: SparkSession, folder: str) -> DataFrame:
    """Links from the root to sources, on to languages, and to the documents that are not of low quality."""
    pages = corpus_pages(documents(spark, folder))
    poor = table(spark, folder, "labels").filter("quality = 0").select(F.col("doc_id").alias("page_id"))
    at = lambda *parts: F.concat_ws("/", F.lit(ROOT), *parts)
    return (pages.select(F.lit(ROOT).alias("src"), at("source").alias("dst"))
            .union(pages.select(at("source"), at("source", "lang")))
            .union(pages.join(poor, "page_id", "left_anti").select(at("source", "lang"), "url"))).distinct()


def crawl(spark: SparkSession, folder: str) -> DataFrame:
    return L.crawl_order(edges(spark, folder), spark.createDataFrame([(ROOT,)], "url string"))


_CRAWL = f"""WITH RECURSIVE edges AS (
  SELECT '{ROOT}' AS src, '{ROOT}/' || source AS dst FROM documents UNION
  SELECT '{ROOT}/' || source, '{ROOT}/' || source || '/' || lang FROM documents UNION
  SELECT '{ROOT}/' || source || '/' || lang, '{ROOT}/' || source || '/' || lang || '/' || doc_id FROM documents
  WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)),
walk AS (SELECT '{ROOT}' AS url, 0 AS depth UNION SELECT dst, depth + 1 FROM walk JOIN edges ON src = url)
SELECT url, min(depth) AS depth FROM walk GROUP BY url"""


def copies(spark: SparkSession, folder: str) -> DataFrame:
    """Two crawls of the same site, the second with other page ids, so that every key comes twice."""
    first = corpus_documents(spark, folder)
    again = next_documents(spark, folder).withColumn("page_id", F.col("page_id") + F.lit(1_000_000_000))
    return first.unionByName(again)


_COPIES = f"WITH {_NEXT}, copies AS (SELECT page_id, doc_key, url FROM docs UNION ALL SELECT page_id + 1000000000, doc_key, url FROM docs2) "


STATS_SQL = _INDEX + ("SELECT 'documents' AS stat, '' AS name, CAST(n_docs AS DOUBLE) AS value FROM sizes UNION ALL "
                      "SELECT 'df', term, CAST(df AS DOUBLE) FROM dictionary UNION ALL SELECT 'max_wtf', doc_id, round(max_wtf, 6) FROM norms")


def field_sums(postings: DataFrame) -> DataFrame:
    """The weighted frequencies of a term's fields added up, in the row that a document has for the term."""
    return postings.select("term", "doc_id", F.round(F.aggregate("fields", F.lit(0.0), lambda total, f: total + f["wtf"]), 6).alias("wtf"))


CHECKS = {
    "literal_escape": Check(
        lambda s, d: documents(s, d).select("doc_id", escape_literals(F.col("text"), T).alias("escaped")),
        f"SELECT doc_id, {Q.escape('text', T)} AS escaped FROM documents"),
    "literal_unescape": Check(
        lambda s, d: documents(s, d).select("doc_id", unescape(escape_literals(F.col("text"), T)).alias("plain")),
        f"SELECT doc_id, {Q.unescape(Q.escape('text', T))} AS plain FROM documents"),
    "document_explode": Check(
        lambda s, d: corpus_documents(s, d).select("url", "type", "position", "title", "section_title", "s", "body"),
        _DOCS + "SELECT url, type, position, title, section_title, s, body FROM docs"),
    "section_doc_id": Check(
        lambda s, d: corpus_documents(s, d).filter("type = 'section'").select("url", "position", "doc_id"),
        _DOCS + "SELECT url, position, doc_id FROM docs WHERE type = 'section'"),
    "document_key": Check(
        lambda s, d: corpus_documents(s, d).select("doc_id", "doc_key"), _DOCS + "SELECT doc_id, doc_key FROM docs"),
    "document_upsert": Check(
        lambda s, d: R.upsert_latest(copies(s, d), ["page_id"]).select("doc_key", "page_id", "url"),
        _COPIES + "SELECT doc_key, max(page_id) AS page_id, arg_max(url, page_id) AS url FROM copies GROUP BY doc_key"),
    "hierarchy_json_roundtrip": Check(
        lambda s, d: scored_corpus(s, d).withColumn("hierarchy_json", F.to_json("hierarchy")).select(
            "doc_id", "hierarchy_json", F.array_join(render.parse_hierarchy(F.col("hierarchy_json")), " > ").alias("hierarchy"),
            F.size(render.parse_hierarchy(F.col("body"))).alias("n_bad")),
        _HIER + "SELECT doc_id, CAST(to_json(hierarchy) AS VARCHAR) AS hierarchy_json, array_to_string(hierarchy, ' > ') AS hierarchy, "
                "0 AS n_bad FROM scored"),
    "body_elide": Check(
        lambda s, d: corpus_documents(s, d).select("doc_id", render.elide(F.col("body")).alias("body")),
        _DOCS + "SELECT doc_id, CASE WHEN contains(body, '<b>') OR length(body) < 100 THEN body "
                "ELSE substring(body, 1, 100) || '...' END AS body FROM docs"),
    "result_projection": Check(
        lambda s, d: render.project_result(scored_corpus(s, d)).select(
            "doc_id", "title", "section_title", F.array_join("hierarchy", " > ").alias("hierarchy"), "body", "url"),
        _HIER + f"SELECT doc_id, {Q.unescape('title')} AS title, section_title, {Q.unescape(_CRUMBS)} AS hierarchy, "
                f"{Q.unescape(_ELIDED)} AS body, url FROM scored"),
    "hierarchy_build": Check(
        lambda s, d: H.url_hierarchy(H.url_title_map(materialize(corpus_documents(s, d), "parsed"))).select(
            "url", F.array_join("hierarchy", " > ").alias("hierarchy")),
        _HIER + "SELECT url, array_to_string(hierarchy, ' > ') AS hierarchy FROM hierarchies"),
    "url_title_map": Check(
        lambda s, d: H.url_title_map(corpus_documents(s, d)).select("url", "title"), _HIER + "SELECT url, title FROM titles"),
    "seen_ids": Check(
        lambda s, d: copies(s, d).select("doc_id").distinct(),
        f"WITH {_NEXT} SELECT doc_id FROM docs UNION SELECT doc_id FROM docs2"),
    "site_urls": Check(
        lambda s, d: R.site_urls(corpus_documents(s, d)), _DOCS + "SELECT DISTINCT site, url FROM docs"),
    "validate_hierarchy": Check(
        lambda s, d: V.rejects(scored_corpus(s, d), [V.hierarchy_marker("Source src1")]),
        _HIER + "SELECT DISTINCT page_id, url, 'hierarchy has Source src1' AS reason FROM scored WHERE list_contains(hierarchy, 'Source src1')"),
    "validate_page_atomic": Check(
        lambda s, d: V.keep_valid_pages(corpus_documents(s, d), [("long line", lambda c: (c["type"] == "section") & (F.length(c["body"]) > 1000))])
        .select("page_id", "doc_id"),
        _DOCS + "SELECT page_id, doc_id FROM docs ANTI JOIN "
                "(SELECT DISTINCT page_id FROM docs WHERE type = 'section' AND length(body) > 1000) AS bad USING (page_id)"),
    "stale_documents": Check(
        lambda s, d: R.stale_documents(corpus_documents(s, d), next_documents(s, d)),
        f"WITH {_NEXT} SELECT DISTINCT doc_id FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM docs2)"),
    "refresh_diff": Check(
        refreshed,
        f"WITH {_NEXT}, a AS (SELECT DISTINCT doc_id, url FROM docs), b AS (SELECT DISTINCT doc_id, url FROM docs2) "
        "SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.url, b.url) AS url, CASE "
        "WHEN a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL THEN 'kept' "
        "WHEN b.doc_id IS NOT NULL THEN CASE WHEN b.url IN (SELECT url FROM a) THEN 'changed' ELSE 'new' END "
        "ELSE CASE WHEN a.url IN (SELECT url FROM b) THEN 'replaced' ELSE 'gone' END END AS status "
        "FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.url = b.url"),
    "stale_urls": Check(
        lambda s, d: R.stale_urls(corpus_documents(s, d), next_documents(s, d)),
        f"WITH {_NEXT} SELECT DISTINCT site, url FROM docs WHERE url NOT IN (SELECT url FROM docs2)"),
    "crawl_frontier": Check(crawl, _CRAWL),
    "score_boost_pages": Check(
        lambda s, d: corpus_documents(s, d).select(
            "doc_id", F.round(K.boost_pages(F.lit(1.0), F.col("type"), F.col("hierarchy")), 6).alias("score")),
        _DOCS + "SELECT doc_id, round(greatest(CAST(1.0 AS DOUBLE) - CASE WHEN type <> 'page' THEN 0.25 ELSE 0 END, 0.01), 6) AS score FROM docs"),
    "score_top_level": Check(
        lambda s, d: scored_corpus(s, d).select(
            "doc_id", F.round(K.boost_top_level_pages(F.lit(1.0), F.col("type"), F.col("hierarchy")), 6).alias("score")),
        _HIER + "SELECT doc_id, round(greatest(CAST(1.0 AS DOUBLE) - log10(greatest(len(hierarchy), 1)) / 2, 0.01), 6) AS score FROM scored"),
    "document_score": Check(
        lambda s, d: scored_corpus(s, d).select("doc_id", F.round("score", 6).alias("score")),
        _HIER + "SELECT doc_id, round(score, 6) AS score FROM scored"),
    "tokenize": Check(
        lambda s, d: documents(s, d).select("doc_id", F.posexplode(all_tokens(escape_literals(F.col("text"), T))).alias("position", "token")),
        f"SELECT doc_id, generate_subscripts(t, 1) - 1 AS position, unnest(t) AS token FROM "
        f"(SELECT doc_id, {Q.all_tokens(Q.escape('text', T))} AS t FROM documents)"),
    "stopwords": Check(
        lambda s, d: documents(s, d).select("doc_id", F.posexplode(tokens(F.col("text"))).alias("position", "token")),
        f"SELECT doc_id, generate_subscripts(t, 1) - 1 AS position, unnest(t) AS token FROM "
        f"(SELECT doc_id, {Q.tokens('text')} AS t FROM documents)"),
    "stem_match": Check(
        lambda s, d: documents(s, d).select(F.explode(tokens(F.col("text"))).alias("token"))
        .groupBy("token").agg(F.count("*").alias("n")).select("token", stem(F.col("token")).alias("stem"), "n"),
        f"SELECT token, {Q.stem('token')} AS stem, count(*) AS n FROM "
        f"(SELECT unnest({Q.tokens('text')}) AS token FROM documents) GROUP BY token"),
    "postings_build": Check(
        lambda s, d: P.postings(P.term_postings(scored_corpus(s, d), CORPUS)).select(
            "term", "doc_id", "field", "tf", F.array_join(F.col("positions").cast("array<string>"), " ").alias("positions")),
        _INDEX + "SELECT term, doc_id, field, tf, array_to_string(positions, ' ') AS positions FROM postings"),
    "field_weighted_tf": Check(
        lambda s, d: field_sums(corpus_index(s, d).postings),
        _INDEX + "SELECT term, doc_id, round(wtf, 6) AS wtf FROM term_docs"),
    "corpus_stats": Check(
        lambda s, d: index_stats(corpus_index(s, d)), STATS_SQL),
    "index_scan_ids": Check(
        lambda s, d: corpus_index(s, d).documents.select("doc_id"), _INDEX + "SELECT doc_id FROM unique_docs"),
}


def index_stats(index: SearchIndex) -> DataFrame:
    """Sizes, document frequencies and norms of an index as one table."""
    sizes = index.sites.select(F.lit("documents").alias("stat"), F.lit("").alias("name"), F.col("n_docs").cast("double").alias("value"))
    dfs = index.terms.select(F.lit("df"), "term", F.col("df").cast("double"))
    norms = index.postings.groupBy("doc_id").agg(F.max("max_wtf").alias("m")).select(F.lit("max_wtf"), "doc_id", F.round("m", 6))
    return sizes.union(dfs).union(norms)
