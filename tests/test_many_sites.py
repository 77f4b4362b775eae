"""Many sites in one plan against a plan for each site."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from pagesearch.operators import extract as X, validate as V
from pagesearch.plans import many_sites as N
from pagesearch.plans.index_site import enrich, index_documents
from pagesearch.plans.search import search

A = N.SiteSettings("https://a.example.com", ("main", "article"), ("v1.2", "c++"), scorers=("pages", "top_level_pages"),
                   validators=(("title", "DRAFT"), ("url", ".html")), score_hierarchy="resolved",
                   synonym_groups={"k": ("kube", "container ship"), "two": ("kube", "of apples now")})
B = N.SiteSettings("https://b.example.com", ("div",), (), {"title": 3.0, "body": 2.0}, ("title",), ("top_level_pages",),
                   (("title", "Hidden"),), {"k": ("apples", "pear")}, "resolved")
C = N.SiteSettings("https://c.example.com")
SETTINGS = [A, B, C]


def pages(spark):
    rows = []
    for site in ("https://a.example.com", "https://b.example.com", "https://c.example.com", "https://none.example.com"):
        for i, (path, title) in enumerate([("x", "Area v1.2"), ("x/y", "Book"), ("x/y/z", "DRAFT one"), ("p.html", "Page"), ("h", "Hidden two"), ("", "Root")]):
            body = (f"<nav>menu</nav><main>kube <b>apples</b> container ship v1.2 c++ {i}</main>"
                    f"<div>pear <div>trees</div> oranges of apples now</div> tail &amp; more {'pears ' * i}")
            rows.append((len(rows), f"{site}/{path}", f"<title>{title}</title>{body}"))
        rows.append((len(rows), f"{site}/untitled", "<p>none</p>"))
    rows.append((len(rows), "https://a.example.com/null", None))
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("site", F.regexp_extract("url", "^(https://[^/]+)", 1))


@pytest.fixture(scope="module")
def whole(spark):
    return N.index_sites(pages(spark), N.settings_table(spark, SETTINGS))


def rows(df, *columns):
    return sorted(map(repr, df.select(*columns).collect()))


@pytest.mark.parametrize("settings", SETTINGS, ids="ABC")
def test_each_site_is_indexed_as_alone(spark, whole, settings):
    config = settings.config()
    own = pages(spark).filter(F.col("site") == settings.site)
    alone = index_documents(enrich(X.page_documents(own, config), config), config)
    on_site = lambda df: df.filter(F.col("site") == settings.site)
    columns = ["page_id", "doc_key", "doc_id", "url", "title", "hierarchy", "s", "body", "score"]
    assert rows(on_site(whole.documents), *columns) == rows(alone.documents, *columns)
    flat = lambda df: rows(on_site(df).select("*", F.inline("fields").alias("field", "tf", "part", "positions")),
                           "doc_id", "term", "doc_score", "wtf", "max_wtf", "field", "tf", "part", "positions")
    assert flat(whole.postings) == flat(alone.postings)
    assert rows(on_site(whole.terms), "term", "df") == rows(alone.terms, "term", "df")
    assert on_site(whole.sites).first().n_docs == alone.sites.first().n_docs


def test_sites_without_settings_are_left_out(whole):
    assert {r.site for r in whole.sites.collect()} == {s.site for s in SETTINGS}


def test_reasons_are_those_of_the_sites(spark):
    table = N.settings_table(spark, SETTINGS)
    parsed = N.page_documents(pages(spark), table)
    for settings in SETTINGS:
        own = parsed.filter(F.col("site") == settings.site)
        assert rows(N.rejects(own, table), "page_id", "url", "reason") == rows(V.rejects(own, settings.config().validators), "page_id", "url", "reason")


def test_requests_follow_the_rules_of_their_site(spark, whole):
    asked = spark.createDataFrame(
        [(i, q, None, 0, 20, site) for i, (q, site) in enumerate(
            (q, s) for q in ("kube", "v1.2", "apples", "pears", "*") for s in [*(x.site for x in SETTINGS), None, "https://none.example.com"])],
        "query_id long, q string, from_url string, start int, num int, site string")
    results = N.search_sites(whole, asked, SETTINGS, A.site)
    got = sorted(repr(r) for x in results for r in x.hits.collect())
    totals = {r.query_id: (r.status, r.total) for x in results for r in x.totals.collect()}
    assert sorted(totals) == list(range(25)) and all(totals[i][0] == ("invalid_site" if i % 5 == 4 else "ok") for i in totals)
    want = []
    for settings in SETTINGS:
        own = asked.withColumn("site", F.coalesce("site", F.lit(A.site))).filter(F.col("site") == settings.site)
        want += [repr(r) for r in search(replace(whole, config=settings.config()), own, A.site).hits.collect()]
    assert got == sorted(want) and len(got) > 20


def test_unknown_fields_are_refused(spark):
    with pytest.raises(ValueError):
        N.settings_table(spark, [N.SiteSettings("x", field_weights={"footer": 1.0})])
