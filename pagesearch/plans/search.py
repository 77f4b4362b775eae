"""The read path: a table of requests in, ranked results out."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T

from pagesearch.config import STOP_WORDS, SiteConfig
from pagesearch.functions import requests as R
from pagesearch.functions.text import SYNONYM_MARK, TOKEN, stem, tokens, unescape
from pagesearch.functions.urls import join_url, url_section
from pagesearch.operators import match as M, rank as K
from pagesearch.operators.postings import single_word_groups, word_runs
from pagesearch.operators.render import highlight, project_result, summarize
from pagesearch.operators.skew import lookup_join
from pagesearch.plans.index_site import SearchIndex, documents_of
from pagesearch.session import materialize

PUSHED_PHRASES = 1_000     # synonyms of several words that are looked up in the row of a text
QUERY_WORD = "(" + TOKEN[1:-1] + r"\*?)"


@dataclass(frozen=True)
class SearchResult:
    """``hits`` has one row per result, ``totals`` one row per request.

    ``scored`` holds all hits of the distinct queries, ``requests`` the requests as they were understood.
    """

    hits: DataFrame
    totals: DataFrame
    find_all: Callable[[], DataFrame]
    requests: DataFrame

    @property
    def scored(self) -> DataFrame:
        return self.find_all()


def resolve_sites(requests: DataFrame, sites: DataFrame, default_site: str) -> DataFrame:
    """Add ``site`` and ``status``; a request without a site uses the default one."""
    asked = requests.withColumn("site", F.coalesce("site", F.lit(default_site)))
    known = sites.select("site").distinct().withColumn("_known", F.lit(True))
    joined = lookup_join(asked, known, ["site"], ["query_id"], "left")
    status = F.when(F.col("_known"), "ok").otherwise("invalid_site")
    return joined.withColumn("status", status).drop("_known")


def prepare_requests(requests: DataFrame, index: SearchIndex, default_site: str) -> DataFrame:
    """All request rules: defaults, section, landing key, clean query text and the key of equal queries."""
    config = index.config
    wide = R.widen_single_char(F.col("q"))
    text = R.drop_star_of_synonym(R.normalize_query(wide, config.literal_terms), config.all_synonyms)
    section = url_section(F.col("site"), F.coalesce("from_url", F.lit("")))
    prepared = resolve_sites(requests, index.sites, default_site).select(
        "query_id", "site", "status", R.start_or_default(F.col("start")).alias("start"),
        R.num_or_default(F.col("num")).alias("num"), R.landing_key(wide).alias("landing_key"),
        text.alias("query_text"), section.alias("section"))
    key = F.md5(F.concat_ws("\x1f", "site", "query_text", "section"))
    return prepared.withColumn("qkey", key)


def query_words(text: Column) -> Column:
    """``array<struct<text, kind>>`` of a clean query: its words without stop words, starred ones as prefixes."""
    low = F.lower(text)
    pieces = F.regexp_extract_all(low, F.lit(QUERY_WORD), F.lit(1))

    def word(piece: Column) -> Column:
        starred = F.endswith(piece, F.lit("*")) & piece.rlike(r"(\A|[^\\])\*\z")
        bare = F.when(starred, F.regexp_replace(piece, r"\*\z", "")).otherwise(piece)
        return F.struct(unescape(bare).alias("text"), F.when(starred, "prefix").otherwise("exact").alias("kind"))

    signed = F.filter(F.transform(pieces, word),
                      lambda w: (w["kind"] == "prefix") | ~w["text"].isin(*STOP_WORDS))
    # most texts have neither star nor backslash, and each piece is its word
    plain = F.transform(F.filter(pieces, lambda piece: ~piece.isin(*STOP_WORDS)),
                        lambda piece: F.struct(piece.alias("text"), F.lit("exact").alias("kind")))
    return F.when(F.contains(low, F.lit("*")) | F.contains(low, F.lit("\\")), signed).otherwise(plain)


def synonym_phrases(spark: SparkSession, config: SiteConfig) -> DataFrame:
    """Rows ``(n, phrase, mark)`` of the synonyms of several words: how many, the words, and the index term of their group."""
    rows = [(len(words), " ".join(words), SYNONYM_MARK + group) for group, words in word_runs(config)]
    return spark.createDataFrame(rows, "n int, phrase string, mark string")


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _left_to_right(starts: pd.Series, ends: pd.Series) -> pd.Series:
    """Which of a text's runs, in order of their starts, are taken when each begins behind the one taken before it."""
    def taken(places: Iterable[tuple[int, int]]) -> list[int]:
        found, behind = [], 0
        for k, (start, end) in enumerate(places):
            if start >= behind:
                found.append(k)
                behind = end
        return found

    return pd.Series([None if at is None else taken(zip(at, to, strict=True)) for at, to in zip(starts, ends, strict=True)])


_RUNS = "array<struct<at:int,n:int,marks:array<string>>>"


def _runs_in_row(worded: DataFrame, phrases: list[Row]) -> DataFrame:
    """Add ``runs`` to texts, the longest run at each place, by the few phrases given."""
    marks: dict[tuple[int, str], set[str]] = defaultdict(set)
    for row in phrases:
        marks[row.n, row.phrase].add(row.mark)
    heads = sorted({phrase.split(" ", 1)[0] for _, phrase in marks})
    sizes = sorted({n for n, _ in marks}, reverse=True)
    none = F.lit(None).cast("array<string>")
    by_size = {n: F.create_map(*[x for (m, phrase), of in marks.items() if m == n
                                 for x in (F.lit(phrase), F.array(*map(F.lit, sorted(of))))]) for n in sizes}

    def run(i: Column) -> Column:
        found = [F.when(i + n <= F.size("words"), F.try_element_at(by_size[n], _phrase(i, n))).otherwise(none) for n in sizes]
        n = reduce(lambda rest, k: F.when(found[k].isNotNull(), sizes[k]).otherwise(rest), range(len(sizes) - 1, -1, -1), F.lit(None).cast("int"))
        return F.struct(i.alias("at"), n.alias("n"), F.coalesce(*found).alias("marks"))

    # only places with the first word of a phrase are looked at
    begins = F.filter(F.transform("words", lambda w, i: F.when((w["kind"] == "exact") & w["text"].isin(*heads), i)), lambda i: i.isNotNull())
    return worded.withColumn("runs", F.filter(F.transform(begins, run), lambda r: r["n"].isNotNull()).cast(_RUNS))


def _phrase(i: Column, n: int) -> Column:
    """The words of a run joined by spaces, null when one of them is starred."""
    part = F.slice("words", i + 1, F.lit(n))
    return F.when(F.forall(part, lambda w: w["kind"] == "exact"), F.array_join(F.transform(part, lambda w: w["text"]), " "))


def _runs_by_join(worded: DataFrame, phrases: DataFrame) -> DataFrame:
    """``_runs_in_row`` for a phrase table of any size."""
    lengths = [row.n for row in phrases.select("n").distinct().collect()]   # a row per length of a synonym

    def runs(n: int) -> Column:
        places = F.sequence(F.lit(0), F.size("words") - n)
        return F.transform(F.when(F.size("words") >= n, places).otherwise(F.array().cast("array<int>")),
                           lambda i: F.struct(i.alias("at"), F.lit(n).alias("n"), _phrase(i, n).alias("phrase")))

    grams = worded.select("qkey", F.inline(F.flatten(F.array(*[runs(n) for n in lengths])))).filter(F.col("phrase").isNotNull())
    known = lookup_join(grams, phrases, ["n", "phrase"], ["qkey"])
    longest = known.groupBy("qkey", "at", "n").agg(F.sort_array(F.collect_set("mark")).alias("marks")) \
        .groupBy("qkey", "at").agg(F.max(F.struct("n", "marks")).alias("run")) \
        .groupBy("qkey").agg(F.array_sort(F.collect_list(F.struct("at", "run.n", "run.marks"))).cast(_RUNS).alias("runs"))
    return worded.join(longest, "qkey", "left")


def query_pieces(queries: DataFrame, phrases: DataFrame) -> DataFrame:
    """Rows ``(qkey, site, slot, kind, text)``: the words of each query in order, a synonym of several words as one slot.

    From left to right the longest run of words in the synonym table at a place is taken, and the search goes on behind
    it; starred words are in no run. A run that is in several groups gives its slot one row for each. Up to
    ``PUSHED_PHRASES`` synonyms are looked up in the row of a text, which then stays where it is; more are joined. The
    work grows with a text's words, not with their square.
    """
    worded = queries.select("qkey", "site", query_words(F.col("query_text")).alias("words"))
    few = phrases.select("n", "phrase", "mark").take(PUSHED_PHRASES + 1)
    placed = _runs_in_row(worded, few) if 0 < len(few) <= PUSHED_PHRASES else _runs_by_join(worded, phrases)
    ends = F.transform("runs", lambda r: r["at"] + r["n"])
    chosen = placed.withColumn("taken", F.transform(_left_to_right(F.transform("runs", lambda r: r["at"]), ends),
                                                    lambda k: F.get("runs", k)))

    def pieces(words: Column) -> Column:
        return F.transform(words, lambda w: F.array(F.struct(w["kind"].alias("kind"), w["text"].alias("text"))))

    def behind(k: Column) -> Column:
        last = F.get("taken", k - 1)
        return F.coalesce(last["at"] + last["n"], F.lit(0))

    def part(run: Column, k: Column) -> Column:
        mark = F.transform(run["marks"], lambda mark: F.struct(F.lit("token").alias("kind"), mark.alias("text")))
        return F.concat(pieces(F.slice("words", behind(k) + 1, run["at"] - behind(k))), F.array(mark))

    size = F.size("taken")
    rest = pieces(F.slice("words", behind(size) + 1, F.size("words") - behind(size)))
    slots = F.when(size > 0, F.concat(F.flatten(F.transform("taken", part)), rest)).otherwise(pieces(F.col("words")))
    return chosen.select("qkey", "site", F.posexplode(slots).alias("slot", "pieces")) \
        .select("qkey", "site", "slot", F.inline("pieces"))


def text_slots(queries: DataFrame, config: SiteConfig) -> DataFrame:
    """One must slot per word, or synonym of several words, of the distinct queries ``(qkey, site, query_text)``."""
    if word_runs(config):
        words = query_pieces(queries, synonym_phrases(queries.sparkSession, config))
    else:
        words = queries.select("qkey", "site", F.posexplode(query_words(F.col("query_text"))).alias("slot", "w")) \
            .select("qkey", "site", "slot", "w.kind", "w.text")
    return words.select("qkey", "site", "slot", F.lit("must").alias("occur"), "kind", "text", F.lit("").alias("field"))


def is_match_all(text: Column) -> Column:
    return text.rlike(r"\A\*+\z")


def match_everything(queries: DataFrame, index: SearchIndex) -> DataFrame:
    """Every document of the site, for queries that are only a star."""
    stars = queries.select("qkey", "site")
    docs = index.documents.select("site", "doc_id", F.col("score").alias("doc_score"))
    return lookup_join(docs, stars, ["site"], ["doc_id"]) \
        .select("qkey", "site", "doc_id", "doc_score", F.lit(1.0).alias("base"), F.lit(1.0).alias("slop"))


def sections_of(queries: DataFrame) -> DataFrame:
    """``qkey, site, section_tokens`` of the queries that are asked from a section."""
    return queries.select("qkey", "site", tokens(F.col("section")).alias("section_tokens")) \
        .filter(F.size("section_tokens") > 0)


def score_queries(queries: DataFrame, index: SearchIndex) -> DataFrame:
    """All hits of the distinct queries ``(qkey, site, query_text, section)`` with words, with their final score."""
    slots = materialize(text_slots(queries, index.config), "slots")
    hits = materialize(M.match(slots, index), "matches")
    in_section = sections_of(queries)
    if in_section.isEmpty():
        return K.final_score(hits.withColumn("section_part", F.lit(None).cast("double")))
    return K.final_score(M.section_scores(hits, in_section, index))


def score_stars(stars: DataFrame, index: SearchIndex) -> DataFrame:
    """All documents for every star query: as many rows as both multiplied. Pages come from ``top_stars``."""
    hits = match_everything(stars, index)
    in_section = sections_of(stars)
    if in_section.isEmpty():
        return K.final_score(hits.withColumn("section_part", F.lit(None).cast("double")))
    inside = M.section_documents(in_section, index).select("qkey", "site", "doc_id", "section_part")
    return K.final_score(hits.join(inside, ["qkey", "site", "doc_id"], "left"))


def top_stars(stars: DataFrame, index: SearchIndex, depth: int) -> DataFrame:
    """Rows ``(qkey, site, doc_id, score)`` that hold the first ``depth`` hits of every star query.

    A document outside the section can only be among them with a static rank up to ``depth``, as the section
    lifts the others. So the stored rank list is read that far, and the documents of each distinct section are read
    once and cut to ``depth`` before queries share them.
    """
    groups = stars.select("site", "section").distinct().withColumn("skey", F.md5(F.concat_ws("\x1f", "site", "section")))
    ranked = index.ranked if index.ranked is not None else K.first_ranks(
        index.documents.select(F.col("site").alias("qkey"), "site", "doc_id", F.round("score", 6).alias("score")), depth)
    first = lookup_join(ranked.filter(F.col("rank") <= depth).select("site", "doc_id", "score"), groups, ["site"], ["doc_id"])
    in_section = sections_of(groups.withColumnRenamed("skey", "qkey"))
    hits = first.select("skey", "site", "doc_id", "score")
    if not in_section.isEmpty():
        inside = K.final_score(M.section_documents(in_section, index)).select("qkey", "site", "doc_id", "score")
        lifted = materialize(K.first_ranks(inside, depth).select(F.col("qkey").alias("skey"), "site", "doc_id", "score"), "section-hits")
        # a document of the static list that the section lifts has its higher score
        hits = hits.unionByName(lifted).groupBy("skey", "site", "doc_id").agg(F.max("score").alias("score"))
    asked = stars.join(groups, ["site", "section"]).select("qkey", "skey")
    return lookup_join(hits, asked, ["skey"], ["doc_id"]).select("qkey", "site", "doc_id", "score")


def landing_hits(prepared: DataFrame, landing_pages: DataFrame) -> DataFrame:
    """The landing page of each request that has one, at rank 0 and with its full URL."""
    pages = landing_pages.withColumnRenamed("query", "landing_key")
    joined = lookup_join(prepared.select("query_id", "site", "landing_key"), pages,
                         ["site", "landing_key"], ["query_id"])
    return joined.select("query_id", F.lit(0).alias("rank"), "title", "section_title", "hierarchy", "body",
                         join_url(F.col("site"), F.col("url")).alias("url"))


def show_hits(page: DataFrame, prepared: DataFrame, index: SearchIndex) -> DataFrame:
    """Join the documents of the result pages and highlight, summarise and project them."""
    config = index.config
    words = query_words(F.col("query_text"))
    exact = F.transform(F.filter(words, lambda w: w["kind"] == "exact"), lambda w: w["text"])
    for _, members in single_word_groups(config):
        member_list = F.array(*[F.lit(m) for m in members])
        exact = F.when(F.arrays_overlap(exact, member_list), F.array_union(exact, member_list)).otherwise(exact)
    marks = prepared.select("query_id", exact.alias("words"), F.transform(exact, stem).alias("stems"),
                            F.transform(F.filter(words, lambda w: w["kind"] == "prefix"),
                                        lambda w: w["text"]).alias("prefixes"))
    page = materialize(page, "page")  # ids and ranks; at most 100 rows a request
    shown = documents_of(page, index, "url", "title", "section_title", "hierarchy", "body")
    shown = lookup_join(K.first_per_url(shown), marks, ["query_id"], ["doc_id"])
    marked = {name: highlight(F.col(name), F.col("words"), F.col("stems"), F.col("prefixes"))
              for name in ("title", "section_title", "body")}
    shown = shown.withColumns(marked).withColumn("body", summarize(F.col("body")))
    return project_result(shown)


def search(index: SearchIndex, requests: DataFrame, default_site: str, landing_pages: DataFrame | None = None,
           dedupe_before_limit: bool = False) -> SearchResult:
    """Answer a whole table of requests ``(query_id, q, from_url, start, num, site)``.

    Equal queries are matched once. Bodies are read only for the hits that are returned, and star queries read the
    stored rank list as far as their pages go; ``scored`` works out all their hits only when it is read.
    """
    prepared = materialize(prepare_requests(requests, index, default_site), "requests")
    usable = prepared.filter(F.col("status") == "ok")
    queries = materialize(usable.select("qkey", "site", "query_text", "section").distinct(), "queries")
    star = is_match_all(F.col("query_text"))
    texts, stars = queries.filter(~star), queries.filter(star)
    with_words = found = materialize(score_queries(texts, index), "hits")
    counts, any_star = K.totals(found), not stars.isEmpty()

    def find_all() -> DataFrame:
        return with_words.unionByName(score_stars(stars, index).select(*with_words.columns)) if any_star else with_words

    if any_star:
        counts = counts.unionByName(stars.join(index.sites, "site").select("qkey", F.col("n_docs").alias("total")))
        if not dedupe_before_limit:
            asked = usable.join(stars.select("qkey"), "qkey", "left_semi")
            depth = asked.agg(F.max(F.col("start").cast("long") + F.col("num")).alias("end")).first().end
            found = found.select("qkey", "site", "doc_id", "score").unionByName(top_stars(stars, index, depth))
    columns = ["query_id", "rank", "title", "section_title", "hierarchy", "body", "url"]
    ranked = found
    if dedupe_before_limit:
        # fewer URLs than documents: how deep the page reaches is not known from the ranks
        scored = find_all()
        urls = (index.ranked if index.ranked is not None else index.documents).select("site", "doc_id", "url")
        best = F.min(F.struct((-F.col("score")).alias("low"), "doc_id")).alias("_best")
        ranked = scored.join(urls, ["site", "doc_id"]).groupBy("qkey", "site", "url").agg(best) \
            .select("qkey", "site", F.col("_best.doc_id").alias("doc_id"), (-F.col("_best.low")).alias("score"))
    page = K.page_ranks(ranked.select("qkey", "site", "doc_id", "score"), usable)
    hits = show_hits(page, usable, index).select(*columns)
    if landing_pages is not None:
        landing = landing_hits(usable, landing_pages).select(*columns)
        hits = hits.join(landing.select("query_id", "url"), ["query_id", "url"], "left_anti") \
            .select(*columns).unionByName(landing)
    counted = lookup_join(prepared.select("query_id", "status", "qkey"), counts, ["qkey"], ["query_id"], "left")
    request_totals = counted.select("query_id", "status", F.coalesce("total", F.lit(0)).alias("total"))
    return SearchResult(hits, request_totals, find_all, prepared)
