"""Result pages from document buckets, star queries from rank lists, and tags."""

import pytest
from pyspark.sql import functions as F

from pagesearch.operators import match as M, rank as K
from pagesearch.plans import search as P
from pagesearch.plans.index_site import documents_of, index_documents, open_index, reindex
from pagesearch.sources.store import IndexStore
from test_index_search import CONFIG, SITE, html

WORDS = "apple pear plum fig quince".split()


def page_rows(spark, n=60):
    rows = [(i, SITE, f"{SITE}/s{i % 3}/{i}", html(" ".join(WORDS[(i * k) % 5] for k in range(1, 4 + i % 4)))) for i in range(n)]
    return spark.createDataFrame(rows, "page_id long, site string, url string, html string")


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    from pagesearch.plans import index_site
    kept, old = IndexStore(spark, str(tmp_path_factory.mktemp("ix")), "docs"), index_site.DOCS_PER_BUCKET
    index_site.DOCS_PER_BUCKET = 5
    try:
        reindex(page_rows(spark), CONFIG, kept, buckets=4)
    finally:
        index_site.DOCS_PER_BUCKET = old
    return open_index(kept, CONFIG)


def asked(spark, rows):
    return spark.createDataFrame(rows, "query_id long, q string, from_url string, start int, num int, site string")


def test_documents_come_from_their_buckets(spark, index, capsys):
    assert index.doc_buckets == 12
    wanted = index.documents.select("site", "doc_id").limit(2).withColumn("rank", F.lit(1))
    shown = documents_of(wanted, index, "title", "body")
    shown.explain("formatted")
    plan = capsys.readouterr().out
    scan = [line for line in plan.splitlines() if "PartitionFilters" in line and "doc_bucket" in line]
    assert scan and any("In(doc_id" in line or "EqualTo(doc_id" in line for line in plan.splitlines() if "PushedFilters" in line)
    assert shown.count() == 2 and sorted(shown.columns) == ["body", "doc_id", "rank", "site", "title"]


@pytest.mark.parametrize("stored", [True, False])
def test_star_pages_equal_the_ranks_of_all_hits(spark, index, stored):
    if not stored:
        index = index_documents(index.documents, CONFIG)
    rows = [(1, "*", None, 0, 5, None), (2, "**", f"{SITE}/s1/x", 3, 30, None), (3, "*", f"{SITE}/s2/", 0, 7, None),
            (4, "*", f"{SITE}/none/", 55, 10, None), (5, "*", f"{SITE}/s1", 0, 100, None), (6, "pear", None, 0, 5, None)]
    result = P.search(index, asked(spark, rows), SITE)
    want = K.page_ranks(result.scored.select("qkey", "site", "doc_id", "score"), result.requests)
    urls = index.documents.select("doc_id", "url")
    want = {(r.query_id, r["rank"], r.url) for r in want.join(urls, "doc_id").collect()}
    assert {(r.query_id, r["rank"], r.url) for r in result.hits.collect()} == want
    assert {r.query_id: r.total for r in result.totals.collect() if r.query_id < 6} == dict.fromkeys(range(1, 6), 60)


def test_star_pages_do_not_read_documents_for_every_query(spark, index):
    """40 star queries over 60 documents: as many rows as their pages and sections need, not 2,400."""
    rows = [(i, "*", f"{SITE}/s{i % 2}/" if i % 4 else None, 0, 3, None) for i in range(40)]
    prepared = P.prepare_requests(asked(spark, rows), index, SITE)
    stars = prepared.select("qkey", "site", "section").distinct()
    assert P.top_stars(stars, index, 3).count() <= stars.count() * (3 + 3)


def test_static_ranks_are_dense_and_ordered(index):
    rows = index.ranked.orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 61))
    assert [(-r.score, r.doc_id) for r in rows] == sorted((-r.score, r.doc_id) for r in rows)


def test_tags_find_each_document_once(spark, index):
    ids = [r.doc_id for r in index.documents.select("doc_id").limit(3).collect()]
    tags = spark.createDataFrame([(SITE, i) for i in [*ids, ids[0]]] + [(SITE, "absent"), ("https://other.example.com", ids[1]), (None, None)],
                                 "site string, doc_id string")
    assert sorted(r.doc_id for r in M.tagged(tags, index, "url").collect()) == sorted(ids)
