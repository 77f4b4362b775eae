"""Character references: native columns and the page's tree decode alike."""

import html
import random

from pyspark.sql import functions as F

from pagesearch.functions.text import decode_entities, element_text
from pagesearch.operators.links import page_links
from pagesearch.operators.sections import page_parts

ODD = ["&#000000000065;", "&#128;", "&#x80", "&#0;", "&#x0;", "&#", "&#;", "&#x;", "&#xD800;", "&#1114111;", "&#1114112;", "&#99999999999999999999;",
       "&#x10FFFF;", "&#x110000;", "&#x00000000000041;", "&#13;", "&#1;", "&#11;", "&#127;", "&#x9F;", "&#xFDD0;", "&#xFFFE;", "&#x1F600;", "&#65", "&#65x",
       "&amp", "&amp;", "&ampx", "&amp;lt;", "&notit;", "&notin;", "&not", "&eacute", "&eacutes", "&Eacute;", "&nosuch;", "&;", "&", "& ", "&&amp;", "&a", "&lt",
       "&ltx&gt", "&CounterClockwiseContourIntegral;", "&" + "a" * 40 + ";", "&nbsp", "&fjlig;", "&NotEqualTilde;", "&Abreve", "&copy2026", "x&#39;y", "&quot&quot;"]


def test_references_decode_as_the_standard_library_does(spark):
    rng = random.Random(7)
    texts = ODD + ["".join(rng.choice([*ODD, "a", " ", ";", "é", "😀"]) for _ in range(6)) for _ in range(600)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(4)
    got = {r.i: r.d for r in rows.select("i", decode_entities(F.col("t")).alias("d")).collect()}
    assert [got[i] for i in range(len(texts))] == [html.unescape(t) for t in texts]


def test_both_paths_read_a_page_alike(spark):
    pages = [f"<title>T</title><main><p>before {odd} behind</p></main>" for odd in ODD]
    rows = spark.createDataFrame(list(enumerate(pages)), "i int, t string")
    native = {r.i: r.d for r in rows.select("i", element_text(F.regexp_extract("t", "(?s)<main>(.*)</main>", 1)).alias("d")).collect()}
    for i, page in enumerate(pages):
        assert native[i] == next(page_parts(page, ("main",), ("h2",)))[3], ODD[i]


def test_pages_do_not_ride_along_with_their_links(spark):
    pages = spark.createDataFrame([(1, "https://e.example.com/a/", "<base href='b/'><a href='c'>c</a><a href='#x'>x</a>"), (2, "https://e.example.com/", None)],
                                  "page_id long, url string, html string")
    links = page_links(pages)
    assert [tuple(r) for r in links.collect()] == [(1, "https://e.example.com/a/", "https://e.example.com/a/b/c")]
    plan = links._jdf.queryExecution().optimizedPlan().toString()
    above = plan.split("Generate", 1)[0]
    assert "html" not in above and plan.count("<(?:base)") + plan.count("<base") <= 1
