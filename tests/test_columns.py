"""Text, URL, request and score rules on single values."""

import re

import pytest
from pyspark.sql import functions as F

from pagesearch.functions import requests as R, scores as S, text
from pagesearch.functions.text import escape_literals, prepare_text, stem, strip, tokens, unescape
from pagesearch.functions.urls import join_url, normalize_url, resolve_link, url_section
from pagesearch.operators import extract
from pagesearch.operators.links import allow_deny, hrefs
from pagesearch.operators.render import elide, highlight, parse_hierarchy, summarize
from pagesearch.plans.search import query_words

TERMS = ("leader-follower", "active-active", r"v6.2.8", "7.2")


@pytest.mark.parametrize("text", ["", " a ", "\xa0 a　b \n", "\x1c\x85x ", "a​b ", "\t#\n"])
def test_strip_is_python_strip(one, text):
    assert one(strip(F.col("t")), t=text) == text.strip()


def brute_escape(text, terms):
    punctuation = re.compile(r"""[,.<>{}\[\]\\"':;!@#$%^&*()\-+=~]""")
    return re.sub("|".join(terms), lambda m: punctuation.sub(lambda p: "\\" + p.group(), m.group()), text, flags=re.I)


@pytest.mark.parametrize("text", [
    "leader-follower active-active", "Active-Active v7.2 7x2 a-b v6.2.8", "", "7.2", "x7.27.2x", "\u0001a\u0002 7.2", "nothing"])
def test_escape_literals(one, text):
    escaped = one(escape_literals(F.col("t"), TERMS), t=text)
    assert escaped == brute_escape(text, TERMS)
    assert one(unescape(F.col("t")), t=escaped) == text


def test_prepare_text(one):
    assert one(prepare_text(F.col("t"), TERMS, True), t="\n #a\nb 7.2 \n") == " a b 7\\.2"
    assert one(prepare_text(F.col("t")), t=" #a\tb\xa0") == "#a\tb"


@pytest.mark.parametrize("word, root", [
    ("cities", "city"), ("zombeies", "zombeie"), ("plates", "plate"), ("shoes", "shoe"), ("bus", "bus"), ("glass", "glass"),
    ("cats", "cat"), ("is", "is"), ("trees", "tree"), ("octopus", "octopus")])
def test_stem(one, word, root):
    assert one(stem(F.col("w")), w=word) == root


def test_tokens(one):
    assert one(tokens(F.col("t")), t=r"The Quick_fox, v6\.2\.8 and a-b: ÉTÉ!") == ["quick_fox", "v6.2.8", "b", "été"]
    junk = "x" * 50_000 + " " + r"\#" * 399 + " end"
    assert len(one(tokens(F.col("t")), t=junk)) == 3


def test_urls(one):
    root = F.lit("https://docs.example.com/latest/")
    assert one(normalize_url(F.col("u")), u="https://a.io/b//?x=/") == "https://a.io/b"
    assert one(normalize_url(F.col("u")), u="https://a.io/b#top?x") == "https://a.io/b#top"
    assert one(url_section(root, F.col("u")), u="https://docs.example.com/latest/first//second") == "first"
    assert one(url_section(root, F.col("u")), u="https://elsewhere.example.com/first") == ""
    assert one(url_section(F.lit("https://a.io"), F.col("u")), u="https://a.io?x=1") == "?x=1"
    assert one(join_url(root, F.lit("/rc/"))) == "https://docs.example.com/latest/rc/"


@pytest.mark.parametrize("href, url", [
    ("/x", "https://a.io/x"), ("y.html", "https://a.io/b/y.html"), ("//c.io/z", "https://c.io/z"), ("#top", None),
    ("mailto:me@a.io", None), ("javascript:go()", None), ("http://d.io", "http://d.io"), ("?p=2", "https://a.io/b/c?p=2")])
def test_resolve_link(one, href, url):
    assert one(resolve_link(F.lit("https://a.io/b/c?q=1"), F.col("h")), h=href) == url


def test_links_of_a_page(one):
    html = """<a href="/a">x</a><a class="c" href='/b'>y</a><a href=/c>z</a><a href="/a">x</a><link href="/no">"""
    assert one(hrefs(F.col("h")), h=html) == ["/a", "/b", "/c"]
    assert one(hrefs(F.lit(None).cast("string"))) == []
    assert one(allow_deny(F.col("u"), (), (r".*\.pdf",)), u="https://a.io/x.pdf") is False
    assert one(allow_deny(F.col("u"), ("docs", "blog"), ()), u="https://a.io/blog/1") is True


@pytest.mark.parametrize("query, clean", [
    ("python-*", "python*"), ("this is a [test]", "this is a  test"), ("leader-follower active-active", r"leader\-follower active\-active"),
    (" <a>+ ", "a")])
def test_normalize_query(one, query, clean):
    assert one(R.normalize_query(F.col("q"), TERMS), q=query) == clean


def test_request_rules(one):
    assert one(R.widen_single_char(F.col("q")), q="x*") == ".x*"
    assert one(R.widen_single_char(F.col("q")), q="X*") == "X*"
    assert one(R.drop_star_of_synonym(F.col("q"), ["insight"]), q="insight*") == "insight"
    assert one(R.drop_star_of_synonym(F.col("q"), ["insight"]), q="test*") == "test*"
    assert one(R.section_query(F.col("q"), F.lit("test")), q="test") == "((@s:test) => {$weight: 10} test) | test"
    assert one(R.landing_key(F.col("q")), q="k8s*") == "k8s"
    assert one(R.num_or_default(F.col("n")), n=500) == 100
    assert one(R.num_or_default(F.lit(None).cast("int"))) == 30


def test_query_words(one):
    words = one(query_words(F.col("q")), q=r"The v6\.2\.8 foo* a\* *")
    assert [tuple(w) for w in words] == [("v6.2.8", "exact"), ("foo", "prefix"), ("a*", "exact")]


def test_scores(one):
    page, section = F.lit("page"), F.lit("section")
    three = F.array(*map(F.lit, "abc"))
    chain = (S.boost_pages, S.boost_top_level_pages)
    assert one(S.document_score(chain, page, F.array())) == 1.0
    assert one(S.document_score(chain, section, F.array())) == 0.75
    assert one(S.boost_top_level_pages(F.lit(0.1), page, three)) == 0.01
    assert one(S.document_score((lambda score, kind, crumbs: score * 2,), page, three)) == 2.0


def test_rendering(one):
    assert one(elide(F.col("b"), 5), b="This is the body") == "This ..."
    assert one(elide(F.col("b"), 5), b="12345") == "12345..."
    assert one(elide(F.col("b"), 5), b="1234") == "1234"
    assert one(parse_hierarchy(F.col("h")), h="bad json") == []
    assert one(parse_hierarchy(F.col("h")), h='["a", "b"]') == ["a", "b"]
    words, none = F.array(F.lit("v6.2.8"), F.lit("cat")), F.array().cast("array<string>")
    marked = highlight(F.col("t"), words, F.array(F.lit("cat")), none)
    assert one(unescape(marked), t=r"In v6\.2\.8, cats and dogs") == "In <b>v6</b>.2.8, <b>cats</b> and dogs"
    assert one(summarize(F.col("b")), b="a b c d e <b>f</b> g h i j k l") == "b c d e <b>f</b> g h i j k... "
    assert one(summarize(F.col("b")), b="no hit at all") == "no hit at all"


def test_tokens_of_any_length(one):
    long = "\\-".join(["a"] * 10_000)
    assert one(text.tokens(F.col("x")), x=f"{long} tail") == [long.replace("\\", ""), "tail"]


def test_literal_terms_are_patterns(one):
    def escaped(value, *terms):
        return one(text.escape_literals(F.col("x"), terms), x=value)

    assert escaped("6.2 and v6.2", "v?6.2") == "6\\.2 and v6\\.2"
    assert escaped("b-1 a", "a|b-1") == "b\\-1 a"
    assert escaped("a-b", "") == "a-b" and escaped("a-b", "", "a-b") == "a\\-b"


def test_character_references_are_decoded_once(one):
    given = "&amp;lt; &#233;&#x1F600; &eacute; &hellip; &bogus; &#0; &#xD800; &amp"
    assert one(text.decode_entities(F.col("x")), x=given) == "&lt; é😀 é … &bogus; \ufffd \ufffd &"


def test_content_of_nested_elements(one):
    def content(html):
        return one(extract.tag_content(F.col("x"), ("main", "article")), x=html)

    assert content("x<article>a<article id=1>b</article>c</article >d") == "a<article id=1>b</article>c"
    assert content("<article>a</article><MAIN class='m'>b<mainly>c</mainly></Main>") == "b<mainly>c</mainly>"
    assert content("<article>a<article>b</article>c") == "a<article>b</article>c" and content("<p>a") == "<p>a"
