"""How a hit is shown: highlight, summary, elision, escapes, report and response."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pagesearch.config import ELIDE_LENGTH, SUMMARY_WORDS
from pagesearch.functions.text import TOKEN, stem, unescape

SPACES = r"[ \t\n\r\f]+"


def highlight(text: Column, words: Column, stems: Column, prefixes: Column) -> Column:
    """Wrap the tokens a query matches in ``<b>``; of an escaped token only the run before the escape.

    The text is cut at its tokens, so what is not a token passes through untouched.
    """
    found = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1))
    around = F.split(text, TOKEN, -1)

    def mark(token: Column) -> Column:
        plain = unescape(F.lower(token))
        hit = (F.array_contains(words, plain) | F.array_contains(stems, stem(plain))
               | F.exists(prefixes, lambda p: F.startswith(plain, p)))
        return F.when(hit, F.regexp_replace(token, r"\A([^\\]+)", "<b>$1</b>")).otherwise(token)

    laced = F.zip_with(around, found, lambda gap, token: F.concat(gap, F.coalesce(mark(token), F.lit(""))))
    return F.array_join(laced, "")


def summarize(body: Column, n_words: int = SUMMARY_WORDS) -> Column:
    """Ten words around the first highlight; a body without one stays whole."""
    words = F.split(body, SPACES, -1)
    first_hit = F.array_position(F.transform(words, lambda w: F.contains(w, F.lit("<b>"))), True)
    start = F.greatest(first_hit - 4, F.lit(1)).cast("int")
    fragment = F.concat(F.array_join(F.slice(words, start, F.lit(n_words)), " "), F.lit("... "))
    return F.when(F.contains(body, F.lit("<b>")), fragment).otherwise(body)


def elide(text: Column, length: int = ELIDE_LENGTH) -> Column:
    """Cut a text without highlights to ``length`` characters; one of exactly that length gets dots too."""
    short = F.contains(text, F.lit("<b>")) | (F.length(text) < length)
    return F.when(short, text).otherwise(F.concat(F.substring(text, 1, length), F.lit("...")))


def parse_hierarchy(hierarchy_json: Column) -> Column:
    """Hierarchy from its stored JSON text; bad JSON gives an empty list."""
    return F.coalesce(F.from_json(hierarchy_json, "array<string>"), F.array().cast("array<string>"))


def project_result(hits: DataFrame) -> DataFrame:
    """Elide the body, then drop all escapes."""
    return hits.withColumns({
        "title": unescape(F.col("title")),
        "section_title": unescape(F.col("section_title")),
        "hierarchy": F.transform("hierarchy", unescape),
        "body": unescape(elide(F.col("body"))),
    })


def report_line(hits: DataFrame) -> Column:
    """A hit as text: breadcrumbs and title, section, URL and body on lines of their own."""
    crumbs = F.array_join(F.concat(F.col("hierarchy"), F.array("title")), " > ")
    section = F.when(F.col("section_title") != "", F.concat(F.lit("["), F.col("section_title"), F.lit("]")))
    body = F.when(F.coalesce("body", F.lit("")) == "", F.lit("NO BODY")).otherwise(F.col("body"))
    return F.concat_ws("\n", crumbs, section, F.col("url"), body)


def responses(results: DataFrame, request_totals: DataFrame) -> DataFrame:
    """One ``{total, results}`` JSON text per request; a request has at most 101 results."""
    item = F.struct("title", "section_title", "hierarchy", "body", "url")
    ordered = F.array_sort(F.collect_list(F.struct("rank", item.alias("item"))))
    grouped = results.groupBy("query_id").agg(F.transform(ordered, lambda r: r["item"]).alias("results"))
    empty = F.from_json(F.lit("[]"), "array<struct<title:string,section_title:string,hierarchy:array<string>,body:string,url:string>>")
    joined = request_totals.join(grouped, "query_id", "left")
    return joined.select("query_id", F.to_json(F.struct(
        "total", F.coalesce("results", empty).alias("results"))).alias("response"))
