"""Checks of matching, scoring, ranking and rendering on the stored index of the corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagesearch.functions import requests as R
from pagesearch.functions.text import TOKEN
from pagesearch.operators import match as M, rank as K, render
from pagesearch.operators.postings import single_word_groups
from pagesearch.plans.index_site import documents_of
from pagesearch.plans.search import SearchResult, landing_hits, match_everything, prepare_requests, search, top_stars
from pagesearch.session import materialize
from pagesearch.workload import Check, sqltext as Q
from pagesearch.workload.corpus import corpus_index
from pagesearch.workload.requests_checks import LANDING_SQL, OTHER, _LANDING_URL, landing_pages
from pagesearch.workload.sites import CORPUS, ROOT

# Star queries of several sections and depths; the last starts behind the hits of its section
STARS = [(1, "*", None, 0, 10, None), (2, "**", f"{ROOT}/src4/fr", 5, 20, None), (3, "*", f"{ROOT}/src0/x", 0, 100, None),
         (4, "*", f"{ROOT}/src4", 0, 30, None), (5, "*", f"{ROOT}/nowhere/", 40, 10, None), (6, "*", f"{ROOT}/src1", 300, 50, None)]

SLOT_SCHEMA = "qkey string, site string, slot int, occur string, kind string, text string, field string"
REQUEST_SCHEMA = "query_id long, q string, from_url string, start int, num int, site string"

# A batch of requests: plain, several words, prefix, star, section, landing, paging, none, invalid ...
REQUESTS = [
    (1, "avec", None, None, None, None),
    (2, "avec  les", None, 0, 20, ROOT),
    (3, "laleen*", None, None, 50, None),
    (4, "*", None, 3, 5, None),
    (5, "src1 ha", f"{ROOT}/src1/en/1", None, None, None),
    (6, "f*", None, None, 10, None),
    (7, "licence*", None, None, None, None),
    (8, "src1", f"{ROOT}/src2", 0, 15, None),
    (9, "nicht auf", None, 5, 5, None),
    (10, "zzzznothing", None, None, None, None),
    (11, "avec", None, None, None, OTHER),
    (12, "BY-NC <2.0>", None, None, None, None),
    (13, "the", None, None, None, None),
    (14, "avec", f"{ROOT}/src3?x=1", 2, 200, None),
    (15, "para*", None, None, 10, None),
    (16, "therhe thornt*", None, None, None, None),
    (17, "avec", None, 10, 30, None),
    (18, "*", f"{ROOT}/src4/fr", None, 10, None),
    (19, "disgusting", None, None, None, None),
]


def slots(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    return spark.createDataFrame([(q, ROOT, *rest) for q, *rest in rows], SLOT_SCHEMA)


def requests(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REQUESTS, REQUEST_SCHEMA)


# ---- the SQL side ---------------------------------------------------------------------------

_ALTERNATIVE = "kind, text, field"
_GROUPS = "".join(
    f" UNION ALL SELECT {_ALTERNATIVE}, {Q.lit('~ ' + g)} FROM alternatives WHERE kind = 'exact' AND text IN ({Q.words(ws)})"
    for g, ws in single_word_groups(CORPUS))
_PLAIN = "NOT starts_with(term, '+ ') AND NOT starts_with(term, '~ ')"

# from a CTE slots(qkey, slot, occur, kind, text, field) to hits(qkey, doc_id, doc_score, base, slop)
MATCH_SQL = f"""
alternatives AS (SELECT DISTINCT kind, text, field FROM slots),
expanded AS (
  SELECT DISTINCT * FROM (
    SELECT {_ALTERNATIVE}, text AS term FROM alternatives WHERE kind IN ('exact', 'token')
    UNION ALL SELECT {_ALTERNATIVE}, {Q.stem('text')} FROM alternatives WHERE kind = 'exact' AND field <> 's'
    UNION ALL SELECT {_ALTERNATIVE}, '+ ' || {Q.stem('text')} FROM alternatives WHERE kind = 'exact' AND field <> 's'
    {_GROUPS}
    UNION ALL SELECT {_ALTERNATIVE}, term FROM alternatives JOIN dictionary ON starts_with(term, text) WHERE kind = 'prefix' AND {_PLAIN}
    UNION ALL SELECT {_ALTERNATIVE}, term FROM alternatives JOIN dictionary
      ON levenshtein(regexp_replace(term, '[^\\x00-\\x7F]', '~', 'g'), text) <= 1 WHERE kind = 'fuzzy' AND {_PLAIN})),
phrase_words AS (
  SELECT {_ALTERNATIVE}, len(string_split(text, ' ')) AS n_words, unnest(string_split(text, ' ')) AS term,
         generate_subscripts(string_split(text, ' '), 1) - 1 AS at FROM alternatives WHERE kind = 'phrase'),
phrase_starts AS (
  SELECT {_ALTERNATIVE}, n_words, doc_id, in_field, start, count(*) AS n FROM (
    SELECT a.kind, a.text, a.field, a.n_words, w.doc_id, w.field AS in_field, unnest(w.positions) - a.at AS start
    FROM phrase_words a JOIN weighted w ON w.term = a.term WHERE a.field = '' OR a.field = w.field) GROUP BY ALL),
phrase_places AS (
  SELECT {_ALTERNATIVE}, doc_id, in_field, list(start) AS starts FROM phrase_starts WHERE n = n_words GROUP BY ALL),
found AS (
  SELECT e.kind, e.text, e.field, w.doc_id, w.doc_score, sum(w.part) AS part, flatten(list(w.positions)) AS positions
  FROM expanded e JOIN weighted w ON w.term = e.term WHERE e.field = '' OR e.field = w.field GROUP BY ALL
  UNION ALL
  SELECT p.kind, p.text, p.field, p.doc_id, x.doc_score, sum(x.part), flatten(list(DISTINCT p.starts))
  FROM phrase_places p JOIN (
    SELECT a.kind, a.text, a.field, w.doc_id, w.field AS in_field, any_value(w.doc_score) AS doc_score, sum(w.part) AS part
    FROM phrase_words a JOIN weighted w ON w.term = a.term GROUP BY ALL) x
  ON x.kind = p.kind AND x.text = p.text AND x.field = p.field AND x.doc_id = p.doc_id AND x.in_field = p.in_field GROUP BY ALL),
filled AS (
  SELECT qkey, slot, occur, doc_id, doc_score, sum(part) AS part, flatten(list(positions)) AS positions
  FROM slots JOIN found USING (kind, text, field) GROUP BY ALL),
needed AS (SELECT qkey, count(DISTINCT slot) AS n_must FROM slots WHERE occur = 'must' GROUP BY qkey),
kept AS (
  SELECT qkey, doc_id, doc_score, sum(CASE WHEN occur <> 'not' THEN part END) AS total_part FROM filled JOIN needed USING (qkey)
  GROUP BY qkey, doc_id, doc_score, n_must
  HAVING count(CASE WHEN occur = 'must' THEN 1 END) = n_must AND count(CASE WHEN occur = 'not' THEN 1 END) = 0),
placed AS (
  SELECT qkey, doc_id, row_number() OVER (PARTITION BY qkey, doc_id ORDER BY slot) AS k, positions
  FROM filled JOIN kept USING (qkey, doc_id) WHERE occur = 'must'),
points AS (SELECT qkey, doc_id, k, unnest(positions) AS p FROM placed),
gaps AS (
  SELECT a.qkey, a.doc_id, a.k, min(abs(a.p - b.p)) AS gap
  FROM points a JOIN points b ON a.qkey = b.qkey AND a.doc_id = b.doc_id AND b.k = a.k + 1 GROUP BY ALL),
slops AS (SELECT qkey, doc_id, greatest(sqrt(sum(gap * gap)), 1.0) AS slop FROM gaps GROUP BY ALL),
hits AS (
  SELECT qkey, doc_id, doc_score, total_part / coalesce(slop, 1.0) AS base, coalesce(slop, 1.0) AS slop
  FROM kept LEFT JOIN slops USING (qkey, doc_id))"""


def slot_sql(rows: Sequence[tuple]) -> str:
    return f"WITH {Q.CORPUS_INDEX}, slots AS {Q.values(rows, 'qkey, slot, occur, kind, text, field')}, {MATCH_SQL} "


def matched(rows: Sequence[tuple]) -> Check:
    """Documents and scores of a query given as slots."""
    def run(spark: SparkSession, folder: str) -> DataFrame:
        hits = M.match(slots(spark, rows), corpus_index(spark, folder))
        return hits.select("qkey", "doc_id", F.round(F.col("doc_score") * F.col("base"), 6).alias("score"))

    return Check(run, slot_sql(rows) + "SELECT qkey, doc_id, round(doc_score * base, 6) AS score FROM hits")


def must(qkey: str, *words: str, kind: str = "exact", field: str = "") -> list[tuple]:
    return [(qkey, i, "must", kind, word, field) for i, word in enumerate(words)]


_AND = must("two", "avec", "les") + must("rare", "therhe", "ha") + must("three", "nicht", "auf", "der") + must("none", "avec", "zzzz")

# ---- text requests in SQL ---------------------------------------------------------------------

_REQ = "requests AS " + Q.values(REQUESTS, "query_id, q, from_url, start, num, site")
_WIDE = "CASE " + " ".join(f"WHEN q = '{a}*' THEN '{b}*'" for a, b in R.SINGLE_CHAR_PREFIXES.items()) + " ELSE q END"
_CLEAN = Q.escape(Q.strip(f"translate(replace({Q.strip(_WIDE)}, '-*', '*'), '[]<>+', '     ')"), CORPUS.literal_terms)
_BARE = r"regexp_replace(clean, '\*+\z', '')"
_PIECES = f"regexp_extract_all(lower(query_text), {Q.lit('(' + Q.TOKEN[1:-1] + chr(92) + '*?)')}, 1)"
_STARRED = r"regexp_matches(piece, '(\A|[^\\])\*\z')"

REQUEST_SQL = f"""{_REQ},
prepared AS (
  SELECT *, md5(asked_site || chr(31) || query_text || chr(31) || section) AS qkey FROM (
    SELECT query_id, asked_site, asked_site = '{ROOT}' AS ok, coalesce(start, 0) AS start, least(coalesce(num, 30), 100) AS num,
           replace(wide, '*', '') AS landing_key, {Q.section('asked_site', "coalesce(from_url, '')")} AS section,
           CASE WHEN ends_with(clean, '*') AND {_BARE} IN ({Q.words(CORPUS.all_synonyms)}) THEN {_BARE} ELSE clean END AS query_text
    FROM (SELECT *, {_WIDE} AS wide, {_CLEAN} AS clean, coalesce(site, '{ROOT}') AS asked_site FROM requests))),
asked AS (SELECT DISTINCT qkey, query_text, section FROM prepared WHERE ok),
words AS (
  SELECT qkey, nth - 1 AS slot, CASE WHEN {_STARRED} THEN 'prefix' ELSE 'exact' END AS kind,
         {Q.unescape("CASE WHEN " + _STARRED + " THEN left(piece, length(piece) - 1) ELSE piece END")} AS text
  FROM (SELECT qkey, unnest({_PIECES}) AS piece, generate_subscripts({_PIECES}, 1) AS nth FROM asked)),
slots AS (SELECT qkey, slot, 'must' AS occur, kind, text, '' AS field FROM words WHERE kind = 'prefix' OR text NOT IN ({Q.words(Q.STOP_WORDS)})),
{MATCH_SQL},
all_hits AS (
  SELECT qkey, doc_id, doc_score, base FROM hits
  UNION ALL SELECT qkey, doc_id, score, 1.0 FROM asked, unique_docs WHERE regexp_matches(query_text, '\\A\\*+\\z')),
section_words AS (SELECT DISTINCT qkey, unnest(sec) AS term, len(list_distinct(sec)) AS n FROM (SELECT qkey, {Q.tokens('section')} AS sec FROM asked)),
section_hits AS (
  SELECT h.qkey, h.doc_id, sum(w.part) AS section_part FROM all_hits h JOIN section_words s ON s.qkey = h.qkey
  JOIN weighted w ON w.doc_id = h.doc_id AND w.term = s.term AND w.field = 's' GROUP BY h.qkey, h.doc_id, s.n HAVING count(*) = s.n),
final AS (
  SELECT h.qkey, h.doc_id, round(doc_score * (base + coalesce(10.0 * section_part + base, 0.0)), 6) AS score
  FROM all_hits h LEFT JOIN section_hits USING (qkey, doc_id)),
totals AS (SELECT qkey, count(*) AS total FROM final GROUP BY qkey),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qkey ORDER BY score DESC, doc_id) AS rank FROM final),
page AS (
  SELECT p.query_id, p.qkey, r.doc_id, r.score, r.rank FROM prepared p JOIN ranked r USING (qkey)
  WHERE p.ok AND r.rank > p.start AND r.rank <= p.start + p.num),
page_docs AS (SELECT p.*, d.* EXCLUDE (doc_id) FROM page p JOIN unique_docs d ON d.doc_id = p.doc_id),
single AS (SELECT * FROM page_docs QUALIFY row_number() OVER (PARTITION BY query_id, url ORDER BY rank) = 1),
{LANDING_SQL},
landed AS (
  SELECT query_id, 0 AS rank, title, section_title, hierarchy, body, {_LANDING_URL} AS url
  FROM prepared JOIN landing ON query = landing_key WHERE ok)"""
_SEARCH = f"WITH {Q.CORPUS_INDEX}, {REQUEST_SQL}"


def _highlight(x: str) -> str:
    token = Q.lit(Q.TOKEN)
    low = Q.unescape("lower(e[2])")
    hit = (f"list_contains(words, {low}) OR list_contains(stems, {Q.stem(low)}) "
           f"OR len(list_filter(prefixes, lambda p: starts_with({low}, p))) > 0")
    marked = rf"CASE WHEN {hit} THEN regexp_replace(e[2], '\A([^\\]+)', '<b>\1</b>') ELSE e[2] END"
    return (f"array_to_string(list_transform(list_zip(string_split_regex({x}, {token}), regexp_extract_all({x}, {token}, 1)), "
            f"lambda e: e[1] || CASE WHEN e[2] IS NULL THEN '' ELSE {marked} END), '')")


def _with_members(x: str) -> str:
    for _, members in single_word_groups(CORPUS):
        x = f"(CASE WHEN list_has_any({x}, [{Q.words(members)}]) THEN list_concat({x}, [{Q.words(members)}]) ELSE {x} END)"
    return x


_MARKS = f"""
word_lists AS (
  SELECT a.qkey, coalesce(list(text) FILTER (kind = 'exact' AND text NOT IN ({Q.words(Q.STOP_WORDS)})), CAST([] AS VARCHAR[])) AS plain_words,
         coalesce(list(text) FILTER (kind = 'prefix'), CAST([] AS VARCHAR[])) AS prefixes
  FROM asked a LEFT JOIN words w ON w.qkey = a.qkey GROUP BY a.qkey),
marks AS (
  SELECT qkey, words, prefixes, list_transform(words, lambda w: {Q.stem('w')}) AS stems
  FROM (SELECT qkey, prefixes, {_with_members('plain_words')} AS words FROM word_lists)),
highlighted AS (
  SELECT query_id, rank, doc_id, url, hierarchy, {_highlight('title')} AS title, {_highlight('section_title')} AS section_title,
         {_highlight('body')} AS body FROM single JOIN marks USING (qkey)),
summarised AS (
  SELECT *, string_split_regex(body, '[ \\t\\n\\r\\f]+') AS ws FROM highlighted),
summaries AS (
  SELECT * EXCLUDE (ws, body), CASE WHEN contains(body, '<b>') THEN array_to_string(ws[first_at:first_at + 9], ' ') || '... ' ELSE body END AS body
  FROM (SELECT *, greatest(list_position(list_transform(ws, lambda w: contains(w, '<b>')), true) - 4, 1) AS first_at FROM summarised)),
shown AS (
  SELECT query_id, rank, {Q.unescape('title')} AS title, {Q.unescape('section_title')} AS section_title,
         {Q.unescape("array_to_string(hierarchy, ' > ')")} AS hierarchy,
         {Q.unescape("CASE WHEN contains(body, '<b>') OR length(body) < 100 THEN body ELSE substring(body, 1, 100) || '...' END")} AS body, url
  FROM summaries),
results AS (
  SELECT * FROM shown s WHERE NOT EXISTS (SELECT 1 FROM landed l WHERE l.query_id = s.query_id AND l.url = s.url)
  UNION ALL SELECT query_id, rank, title, section_title, array_to_string(hierarchy, ' > '), body, url FROM landed)"""
_RESULTS = f"{_SEARCH}, {_MARKS} "

END_TO_END_SQL = _RESULTS + "SELECT query_id, rank, title, section_title, hierarchy, body, url FROM results"

_STAR_SQL = f"""WITH {Q.CORPUS_INDEX},
asked AS (SELECT query_id, start, num, {Q.section(f"'{ROOT}'", "coalesce(from_url, '')")} AS section FROM (SELECT * FROM {Q.values(STARS, 'query_id, q, from_url, start, num, site')})),
section_words AS (SELECT DISTINCT query_id, unnest(sec) AS term, len(list_distinct(sec)) AS n FROM (SELECT query_id, {Q.tokens('section')} AS sec FROM asked)),
section_hits AS (
  SELECT s.query_id, w.doc_id, sum(w.part) AS section_part FROM section_words s
  JOIN weighted w ON w.term = s.term AND w.field = 's' GROUP BY s.query_id, w.doc_id, s.n HAVING count(*) = s.n),
final AS (SELECT a.query_id, a.start, a.num, d.doc_id, round(d.score * (1 + coalesce(10.0 * section_part + 1, 0)), 6) AS score
  FROM asked a CROSS JOIN unique_docs d LEFT JOIN section_hits h ON h.query_id = a.query_id AND h.doc_id = d.doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM final)
SELECT query_id, doc_id, score, rank FROM ranked WHERE rank > start AND rank <= start + num"""

_answers: dict[tuple[str, str], SearchResult] = {}


def fresh_answer(spark: SparkSession, folder: str) -> SearchResult:
    return search(corpus_index(spark, folder), requests(spark), ROOT, landing_pages(spark))


def answer(spark: SparkSession, folder: str) -> SearchResult:
    """The result of the request batch, searched once per session."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _answers:
        _answers[key] = fresh_answer(spark, folder)
    return _answers[key]


def flat(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "rank", "title", "section_title",
                       F.array_join("hierarchy", " > ").alias("hierarchy"), "body", "url")


def shown_page(spark: SparkSession, folder: str) -> DataFrame:
    """The result page with scores, before bodies are joined."""
    result = answer(spark, folder)
    page = K.page_ranks(result.scored.select("qkey", "site", "doc_id", "score"), result.requests.filter("status = 'ok'"))
    return page.select("query_id", "site", "doc_id", "score", "rank")


def with_urls(spark: SparkSession, folder: str) -> DataFrame:
    return documents_of(shown_page(spark, folder), corpus_index(spark, folder), "url")


def every_document(spark: SparkSession, folder: str) -> DataFrame:
    """All hits of one star query."""
    star = spark.createDataFrame([("all", ROOT)], "qkey string, site string")
    hits = match_everything(star, corpus_index(spark, folder))
    return hits.select("doc_id", F.round(F.col("doc_score") * F.col("base"), 6).alias("score"))


def star_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of many star queries, from the stored rank list and the lists of their sections."""
    asked = spark.createDataFrame(STARS, REQUEST_SCHEMA)
    index = corpus_index(spark, folder)
    prepared = materialize(prepare_requests(asked, index, ROOT), "star-requests")
    stars = prepared.select("qkey", "site", "section").distinct()
    page = K.page_ranks(top_stars(stars, index, max(start + num for _, _, _, start, num, _ in STARS)), prepared)
    return page.select("query_id", "doc_id", "score", "rank")


def highlighted(spark: SparkSession, folder: str) -> DataFrame:
    """Every section text with the words of a fixed query marked."""
    docs = corpus_index(spark, folder).documents
    words, stems = F.array(F.lit("avec"), F.lit("by-nc")), F.array(F.lit("avec"), F.lit("tionent"))
    prefixes = F.array(F.lit("laleen"))
    return docs.select("doc_id", render.highlight(F.col("body"), words, stems, prefixes).alias("body"))


_HIGHLIGHTED = (f"WITH {Q.CORPUS_INDEX}, given AS (SELECT *, ['avec', 'by-nc'] AS words, ['avec', 'tionent'] AS stems, ['laleen'] AS prefixes "
                f"FROM unique_docs), lit AS (SELECT doc_id, {_highlight('body')} AS body FROM given) ")

CHECKS = {
    "search_term": matched(must("t1", "avec", kind="token") + must("t2", "therhe", kind="token")),
    "synonym_expand": Check(
        lambda s, d: _group_postings(s, d),
        f"WITH {Q.CORPUS_INDEX} SELECT term AS synonym_group, doc_id, field, tf FROM postings WHERE starts_with(term, '~ ')"),
    "synonym_terms": Check(
        lambda s, d: corpus_index(s, d).terms.filter(F.col("term").isin(CORPUS.all_synonyms)).select("term", "df"),
        f"WITH {Q.CORPUS_INDEX} SELECT term, df FROM dictionary WHERE term IN ({Q.words(CORPUS.all_synonyms)})"),
    "search_and": matched(_AND),
    "search_prefix": matched(must("p1", "laleen", kind="prefix") + must("p2", "thorn", kind="prefix") + [("p2", 1, "must", "exact", "ha", "")]),
    "search_match_all": Check(
        lambda s, d: every_document(s, d),
        f"WITH {Q.CORPUS_INDEX} SELECT doc_id, round(score, 6) AS score FROM unique_docs"),
    "search_star_pages": Check(star_pages, _STAR_SQL),
    "search_synonym": matched(must("s1", "pas") + must("s2", "avec", "et") + must("s3", "para")),
    "search_tfidf": matched(must("one", "nicht") + must("stem", "disgusting") + must("plural", "tiones")),
    "search_slop": Check(
        lambda s, d: M.match(slots(s, _AND), corpus_index(s, d)).select("qkey", "doc_id", F.round("slop", 6).alias("slop")),
        slot_sql(_AND) + "SELECT qkey, doc_id, round(slop, 6) AS slop FROM hits"),
    "search_section_boost": Check(
        lambda s, d: answer(s, d).scored.join(answer(s, d).requests.filter("section <> ''").select("query_id", "qkey"), "qkey")
        .select("query_id", "doc_id", "score"),
        _SEARCH + " SELECT query_id, doc_id, score FROM final JOIN prepared USING (qkey) WHERE section <> '' AND ok"),
    "search_tag": Check(
        lambda s, d: M.tagged(answer(s, d).scored, corpus_index(s, d), "url", "type").select("doc_id", "url", "type"),
        _SEARCH + " SELECT doc_id, url, type FROM unique_docs WHERE doc_id IN (SELECT doc_id FROM final)"),
    "search_phrase": matched([("ph", 0, "must", "phrase", "avec les", ""), ("in_title", 0, "must", "phrase", "de la", "title"),
                              ("both", 0, "must", "phrase", "auf der", ""), ("both", 1, "must", "exact", "nicht", "")]),
    "search_not": matched(must("n", "avec") + [("n", 1, "not", "exact", "les", "")]),
    "search_or": matched([("o", 0, "must", "exact", "therhe", ""), ("o", 0, "must", "exact", "thornt", ""), ("o", 1, "must", "exact", "ha", "")]),
    "search_optional": matched(must("opt", "therhe") + [("opt", 1, "should", "exact", "ha", "")]),
    "search_fuzzy": matched(must("fz", "therhe", kind="fuzzy") + [("fz2", 0, "must", "fuzzy", "nicht", ""), ("fz2", 1, "must", "exact", "auf", "")]),
    "search_field": matched(must("title", "avec", field="title") + must("s", "src1", field="s") + must("url", "fr", field="url")),
    "search_total": Check(
        lambda s, d: answer(s, d).totals.filter("status = 'ok'").select("query_id", "total"),
        _SEARCH + " SELECT query_id, coalesce(total, 0) AS total FROM prepared LEFT JOIN totals USING (qkey) WHERE ok"),
    "search_zero_hits": Check(
        lambda s, d: answer(s, d).totals.filter("total = 0").select("query_id", "status", "total"),
        _SEARCH + " SELECT query_id, CASE WHEN ok THEN 'ok' ELSE 'invalid_site' END AS status, 0 AS total FROM prepared "
                  "LEFT JOIN totals USING (qkey) WHERE total IS NULL"),
    "search_rank": Check(
        lambda s, d: K.all_ranks(answer(s, d).scored.select("qkey", "doc_id", "score")),
        _SEARCH + " SELECT qkey, doc_id, score, rank FROM ranked"),
    "search_page": Check(
        lambda s, d: shown_page(s, d).select("query_id", "doc_id", "score", "rank"),
        _SEARCH + " SELECT query_id, doc_id, score, rank FROM page"),
    "search_dedupe_url": Check(
        lambda s, d: K.first_per_url(with_urls(s, d)).select("query_id", "rank", "doc_id", "url"),
        _SEARCH + " SELECT query_id, rank, doc_id, url FROM single"),
    "search_highlight": Check(highlighted, _HIGHLIGHTED + "SELECT doc_id, body FROM lit"),
    "search_summary": Check(
        lambda s, d: highlighted(s, d).select("doc_id", render.summarize(F.col("body")).alias("summary")),
        _HIGHLIGHTED + ", cut AS (SELECT *, string_split_regex(body, '[ \\t\\n\\r\\f]+') AS ws FROM lit), placed_at AS (SELECT *, "
                       "greatest(list_position(list_transform(ws, lambda w: contains(w, '<b>')), true) - 4, 1) AS first_at FROM cut) "
                       "SELECT doc_id, CASE WHEN contains(body, '<b>') THEN array_to_string(ws[first_at:first_at + 9], ' ') || '... ' ELSE body END AS summary FROM placed_at"),
    "search_with_landing": Check(
        lambda s, d: answer(s, d).hits.select("query_id", "rank", "url"), _RESULTS + "SELECT query_id, rank, url FROM results"),
    "search_report": Check(
        lambda s, d: answer(s, d).hits.select("query_id", "rank", render.report_line(answer(s, d).hits).alias("report")),
        _RESULTS + "SELECT query_id, rank, CASE WHEN hierarchy = '' THEN title ELSE hierarchy || ' > ' || title END || chr(10) || "
                   "CASE WHEN section_title <> '' THEN '[' || section_title || ']' || chr(10) ELSE '' END || url || chr(10) || "
                   "CASE WHEN body = '' THEN 'NO BODY' ELSE body END AS report FROM results"),
    "search_response": Check(
        lambda s, d: render.responses(answer(s, d).hits, answer(s, d).totals.filter("status = 'ok'").select("query_id", "total")),
        _RESULTS + "SELECT query_id, to_json({'total': coalesce(any_value(total), 0), 'results': coalesce(list({'title': title, "
                   "'section_title': section_title, 'hierarchy': CASE WHEN hierarchy = '' THEN [] ELSE string_split(hierarchy, ' > ') END, "
                   "'body': body, 'url': url} ORDER BY rank) FILTER (WHERE rank IS NOT NULL), [])})::VARCHAR AS response "
                   "FROM prepared LEFT JOIN totals USING (qkey) LEFT JOIN results USING (query_id) WHERE ok GROUP BY query_id"),
    "search_end_to_end": Check(
        lambda s, d: flat(fresh_answer(s, d).hits), END_TO_END_SQL),
}


def _group_postings(spark: SparkSession, folder: str) -> DataFrame:
    from pagesearch.functions.text import SYNONYM_MARK

    rows = corpus_index(spark, folder).postings.filter(F.startswith("term", F.lit(SYNONYM_MARK)))
    return rows.select(F.col("term").alias("synonym_group"), "doc_id", F.inline("fields")) \
        .select("synonym_group", "doc_id", "field", "tf")
