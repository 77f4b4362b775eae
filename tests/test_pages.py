"""HTML pages to documents, breadcrumbs, validation and the link graph, on small fixtures."""

from pagesearch.config import SiteConfig
from pagesearch.functions.scores import boost_pages
from pagesearch.operators import hierarchy as H, links as L, sections as S, validate as V
from pagesearch.plans.index_site import parse_documents
from pagesearch.sources.catalogue import command_landing_pages, read_catalogue
from pyspark.sql import functions as F

SITE = "https://docs.example.com/latest"
CONFIG = SiteConfig(SITE, content_selectors=(".main", "article"), literal_terms=("active-active",),
                    validators=(V.skip_release_notes, V.skip_404_url), scorers=(boost_pages,))

H2_PAGE = """<html><head><title>Setup | Docs</title></head><body><nav>menu</nav><div class="x main">
<h1>#Setup</h1><h2 id="a">First <b>part</b> <a href="#a">First</a></h2><p>one</p>text<p>two &amp; Active-Active</p>
<h3>inner</h3><p>three<h2>Second</h2><ul><li>four</li></ul><script>no()</script></div></body></html>"""
H3_PAGE = "<title>Threes</title><article><h3>A</h3><p>1</p><h3>B</h3><p>2</p></article>"


def pages(spark, *rows):
    return spark.createDataFrame([(i, SITE, url, html) for i, (url, html) in enumerate(rows)],
                                 "page_id long, site string, url string, html string")


def test_sections_end_at_h2(spark):
    docs = parse_documents(pages(spark, (SITE + "/guide/setup/?v=1", H2_PAGE)), CONFIG)
    rows = {(r.type, r.position): r for r in docs.collect()}
    page, first, second = rows["page", 0], rows["section", 0], rows["section", 1]
    assert (page.title, page.url, page.s, page.hierarchy) == ("Setup", SITE + "/guide/setup", "guide", [])
    assert page.body.startswith(" Setup") and "menu" not in page.body and "no()" not in page.body
    assert first.section_title == "First"
    assert first.body.split() == ["one", "text", "two", "&", "Active\\-Active", "inner", "threeSecondfour"]
    assert page.doc_id.startswith(page.url + ":page:") and first.doc_id.startswith(page.url + ":section:")
    # the unclosed <p> holds the second heading, whose siblings are then only those inside it
    assert second.section_title == "Second" and second.body == "four"


def test_h3_sections_overlap(spark):
    docs = parse_documents(pages(spark, (SITE + "/threes", H3_PAGE)), CONFIG).filter("type = 'section'")
    assert [(r.section_title, r.body.split()) for r in docs.orderBy("position").collect()] == [
        ("A", ["1", "B", "2"]), ("B", ["2"])]


def test_rejects_do_not_fail_the_load(spark):
    rows = pages(spark, (SITE + "/a", "<p>no title</p>"), (SITE + "/b", "<title></title>"), (SITE + "/c", None),
                 (SITE + "/d", "<title>a<b>c</b></title>"), (SITE + "/e", "<title> </title><p>x"))
    parts = S.parse_pages(rows, CONFIG)
    assert {r.page_id for r in S.rejected_parts(parts).collect()} >= {0, 1, 2}
    assert 4 in {r.page_id for r in S.documents_from_parts(parts, CONFIG).collect()}


def test_validators_drop_whole_pages(spark):
    docs = spark.createDataFrame(
        [(1, "u/1", "Release Notes 1", ["x"]), (1, "u/1", "fine", []), (2, "u/404.html", "t", []), (3, "u/3", "release notes", []),
         (4, "u/4", "t", ["404 Page not found"])], "page_id long, url string, title string, hierarchy array<string>")
    kept = V.keep_valid_pages(docs, [V.skip_release_notes, V.skip_404_url, V.skip_404_hierarchy])
    assert {r.page_id for r in kept.collect()} == {3}
    own = V.keep_valid_pages(docs, [("short", lambda c: F.length(c["title"]) < 2)])
    assert {r.page_id for r in own.collect()} == {1, 3}


def test_hierarchy(spark):
    urls = [("/1", "One"), ("/1/2", "Two//"), ("/1/2/3", "Three"), ("/1/x/y", "Leaf"), ("//1//z", "Odd"), ("/1/2/empty", "")]
    docs = spark.createDataFrame([(i, SITE, SITE + u, t) for i, (u, t) in enumerate(urls)],
                                 "page_id long, site string, url string, title string")
    found = {r.url[len(SITE):]: r.hierarchy for r in H.url_hierarchy(H.url_title_map(docs)).collect()}
    assert found == {"/1": ["One"], "/1/2": ["One", "Two"], "/1/2/3": ["One", "Two", "Three"], "/1/x/y": ["One", "Leaf"],
                     "//1//z": ["One"], "/1/2/empty": ["One", "Two"]}


def test_last_title_wins(spark):
    docs = spark.createDataFrame([(1, "s", "u/", "old"), (2, "s", "u", "new")], "page_id long, site string, url string, title string")
    assert [r.title for r in H.url_title_map(docs).collect()] == ["new"]


def test_crawl_order(spark):
    edges = spark.createDataFrame([("r", "a"), ("r", "b"), ("a", "c"), ("c", "r"), ("c", "d"), ("x", "y")], "src string, dst string")
    walk = L.crawl_order(edges, spark.createDataFrame([("r",)], "url string"))
    assert {(r.url, r.depth) for r in walk.collect()} == {("r", 0), ("a", 1), ("b", 1), ("c", 2), ("d", 3)}
    near = L.crawl_order(edges, spark.createDataFrame([("r",)], "url string"), max_rounds=1)
    assert {r.url for r in near.collect()} == {"r", "a", "b"}


def test_command_catalogue(spark, tmp_path):
    path = tmp_path / "commands.json"
    path.write_text('{"ACL": {"summary": "Access"}, "ACL LIST": {"summary": "x"}, "get": {}}')
    found = command_landing_pages(read_catalogue(spark, str(path)), F.lit(SITE)).collect()
    assert {(r.query, r.title, r.body, r.url) for r in found} == {
        ("ACL", "ACL", "Access", "/commands/acl/"), ("acl", "ACL", "Access", "/commands/acl/"),
        ("get", "get", "Documentation for command 'get'", "/commands/get/")}


def test_links_as_a_browser_resolves_them(spark):
    rows = spark.createDataFrame([
        (1, "https://a.io/b/c/page?q=1#f", '<a href="../x">1</a><a href="./y/./z/..">2</a><a href="/x?a=1&amp;b=2">3</a>'
            '<a href="//other.org/p">4</a><a href="?r=2">5</a><a href="../../../../up">6</a><a href="mailto:me@a.io">7</a>'),
        (2, "http://a.io/deep/er/", "<base target=_top href='/root/sub/'><a href='leaf'>1</a><a href=https://a.io/p/../q/./r?x=../y>2</a>"),
        (3, "https://a.io", '<base href="https://cdn.io/v1/x"><a href="next">1</a>'), (4, "https://a.io/n", None)],
        "page_id long, url string, html string")
    links = L.page_links(rows)
    assert {(r.page_id, r.link_url) for r in links.collect()} == {
        (1, "https://a.io/b/x"), (1, "https://a.io/b/c/y/"), (1, "https://a.io/x?a=1&b=2"), (1, "https://other.org/p"),
        (1, "https://a.io/b/c/page?r=2"), (1, "https://a.io/up"), (2, "http://a.io/root/sub/leaf"),
        (2, "https://a.io/q/r?x=../y"), (3, "https://cdn.io/v1/next")}
    assert {r.link_url for r in L.same_site(links).collect()} == {
        "https://a.io/b/x", "https://a.io/b/c/y/", "https://a.io/x?a=1&b=2", "https://a.io/b/c/page?r=2", "https://a.io/up",
        "http://a.io/root/sub/leaf"}


def test_catalogue_names_that_differ_in_case_share_a_page(spark):
    names = spark.createDataFrame([("GET", "upper"), ("get", "lower"), ("SET", None)], "name string, summary string")
    got = command_landing_pages(names, F.lit(SITE)).collect()
    assert sorted((r.query, r.title) for r in got) == [("GET", "GET"), ("SET", "SET"), ("get", "get"), ("set", "SET")]
