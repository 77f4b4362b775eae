"""Checks of the request rules, on requests derived from every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagesearch.functions import requests as R
from pagesearch.functions.urls import join_url, url_section
from pagesearch.operators.skew import lookup_join
from pagesearch.operators.postings import word_runs
from pagesearch.plans.search import query_pieces, resolve_sites, synonym_phrases
from pagesearch.sources.catalogue import configured_landing_pages
from pagesearch.sources.pages import site_registry
from pagesearch.workload import Check, sqltext as Q, table
from pagesearch.workload.sites import CORPUS, ROOT

T = CORPUS.literal_terms
OTHER = "https://unknown.example.net"

REQUESTS_SQL = f"""
base AS (
  SELECT *, split_part(split_part(text, chr(10), 1), '.', 1) AS title, '{ROOT}/' || source || '/' || lang || '/' || doc_id AS url FROM documents),
requests AS (
  SELECT doc_id * 10 AS query_id, split_part(text, ' ', 1) || '*' AS q, url AS from_url, CAST(NULL AS INTEGER) AS start,
         CAST(NULL AS INTEGER) AS num, CAST(NULL AS VARCHAR) AS site FROM base
  UNION ALL SELECT doc_id * 10 + 1, lower(left(text, 1)) || '*', NULL, CAST(n_chars % 50 AS INTEGER), CAST(n_chars AS INTEGER), '{ROOT}' FROM base
  UNION ALL SELECT doc_id * 10 + 2, title || '-*', url || '?page=2', 0, 10, '{OTHER}' FROM base
  UNION ALL SELECT doc_id * 10 + 3, '[' || lang || '] <' || source || '> +' || title, 'https://elsewhere.example.com/a', NULL, 10, NULL FROM base
  UNION ALL SELECT doc_id * 10 + 4, '  by-nc 2.0 ' || lang || ' ', '{ROOT}//' || source || '//x', 20, NULL, '{ROOT}' FROM base
  UNION ALL SELECT doc_id * 10 + 5, CASE lang WHEN 'fr' THEN 'avec*' WHEN 'de' THEN 'nicht-*' WHEN 'es' THEN 'para*' ELSE source END, '', 5, 1000, '{ROOT}' FROM base)"""

_WIDE = "CASE " + " ".join(f"WHEN q = '{a}*' THEN '{b}*'" for a, b in R.SINGLE_CHAR_PREFIXES.items()) + " ELSE q END"
_CLEAN = Q.escape(Q.strip(f"translate(replace({Q.strip(_WIDE)}, '-*', '*'), '[]<>+', '     ')"), T)
_SYNONYMS = Q.words(CORPUS.all_synonyms)
_BARE = r"regexp_replace(clean, '\*+\z', '')"

PREPARED_SQL = REQUESTS_SQL + f""",
cleaned AS (SELECT *, {_WIDE} AS wide, {_CLEAN} AS clean, coalesce(site, '{ROOT}') AS asked_site FROM requests),
prepared AS (
  SELECT query_id, asked_site AS site, CASE WHEN asked_site = '{ROOT}' THEN 'ok' ELSE 'invalid_site' END AS status,
         coalesce(start, 0) AS start, least(coalesce(num, 30), 100) AS num, replace(wide, '*', '') AS landing_key,
         CASE WHEN ends_with(clean, '*') AND {_BARE} IN ({_SYNONYMS}) THEN {_BARE} ELSE clean END AS query_text,
         {Q.section('asked_site', "coalesce(from_url, '')")} AS section
  FROM cleaned)"""


def derived_requests(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    title = F.substring_index(F.substring_index("text", "\n", 1), ".", 1)
    url = F.concat_ws("/", F.lit(ROOT), "source", "lang", F.col("doc_id").cast("string"))
    nothing, none_text = F.lit(None).cast("int"), F.lit(None).cast("string")
    by_lang = (F.when(F.col("lang") == "fr", "avec*").when(F.col("lang") == "de", "nicht-*")
               .when(F.col("lang") == "es", "para*").otherwise(F.col("source")))
    rows = [
        (F.concat(F.substring_index("text", " ", 1), F.lit("*")), url, nothing, nothing, none_text),
        (F.concat(F.lower(F.substring("text", 1, 1)), F.lit("*")), none_text, (F.col("n_chars") % 50).cast("int"),
         F.col("n_chars").cast("int"), F.lit(ROOT)),
        (F.concat(title, F.lit("-*")), F.concat(url, F.lit("?page=2")), F.lit(0), F.lit(10), F.lit(OTHER)),
        (F.concat(F.lit("["), "lang", F.lit("] <"), "source", F.lit("> +"), title),
         F.lit("https://elsewhere.example.com/a"), nothing, F.lit(10), none_text),
        (F.concat(F.lit("  by-nc 2.0 "), "lang", F.lit(" ")), F.concat(F.lit(ROOT + "//"), "source", F.lit("//x")),
         F.lit(20), nothing, F.lit(ROOT)),
        (by_lang, F.lit(""), F.lit(5), F.lit(1000), F.lit(ROOT)),
    ]
    structs = [F.struct(q.alias("q"), f.alias("from_url"), a.alias("start"), n.alias("num"), w.alias("site"))
               for q, f, a, n, w in rows]
    split = docs.select("doc_id", F.posexplode(F.array(*structs)).alias("v", "r"))
    return split.select((F.col("doc_id") * 10 + F.col("v")).alias("query_id"), "r.*")


def resolved(spark: SparkSession, folder: str) -> DataFrame:
    return resolve_sites(derived_requests(spark, folder), site_registry(spark, [CORPUS]), ROOT)


def landing_pages(spark: SparkSession) -> DataFrame:
    return configured_landing_pages(spark, ROOT, CORPUS.landing_pages)


LANDING_SQL = "landing AS " + Q.values(
    [(p.query, p.title, p.section_title, p.hierarchy, p.body, p.url) for p in CORPUS.landing_pages],
    "query, title, section_title, hierarchy, body, url")
_LANDING_URL = rf"regexp_replace('{ROOT}', '/+\z', '') || '/' || regexp_replace(url, '\A/+', '')"


def landed(spark: SparkSession, folder: str) -> DataFrame:
    keyed = resolved(spark, folder).withColumn("query", R.landing_key(R.widen_single_char(F.col("q"))))
    return lookup_join(keyed.select("query_id", "site", "query"), landing_pages(spark), ["site", "query"], ["query_id"])


_WITH = f"WITH {PREPARED_SQL} "


def phrased(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's text as one long request, cut into words and synonyms of several words."""
    asked = table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("qkey"), F.lit(ROOT).alias("site"), F.lower("text").alias("query_text"))
    pieces = query_pieces(asked, synonym_phrases(spark, CORPUS))
    return pieces.select(F.col("qkey").alias("doc_id"), "slot", "kind", "text")


# each word between bars; a synonym of several words is replaced from left to right
_PIECES = f"regexp_extract_all(lower(text), {Q.lit('(' + Q.TOKEN[1:-1] + chr(92) + '*?)')}, 1)"
_BARRED = f"array_to_string(list_transform(list_filter(list_transform({_PIECES}, lambda p: {Q.unescape('p')}), lambda p: p NOT IN ({Q.words(Q.STOP_WORDS)})), lambda p: '|' || p || '|'), '')"
for _group, _words in word_runs(CORPUS):
    _BARRED = f"replace({_BARRED}, {Q.lit(''.join('|' + w + '|' for w in _words))}, {Q.lit('|~ ' + _group + '|')})"
_PHRASED = f"""WITH barred AS (SELECT doc_id, {_BARRED} AS b FROM documents),
pieces AS (SELECT doc_id, string_split(b[2:-2], '||') AS ps FROM barred WHERE b <> ''),
numbered AS (SELECT doc_id, generate_subscripts(ps, 1) - 1 AS slot, unnest(ps) AS piece FROM pieces)
SELECT doc_id::VARCHAR AS doc_id, slot::INTEGER AS slot, CASE WHEN starts_with(piece, '~ ') THEN 'token' WHEN ends_with(piece, '*') THEN 'prefix' ELSE 'exact' END AS kind,
       CASE WHEN ends_with(piece, '*') THEN left(piece, length(piece) - 1) ELSE piece END AS text FROM numbered"""

CHECKS = {
    "query_site_resolve": Check(
        lambda s, d: resolved(s, d).select("query_id", "site", "status"), _WITH + "SELECT query_id, site, status FROM prepared"),
    "query_invalid_site": Check(
        lambda s, d: resolved(s, d).filter("status <> 'ok'").select("query_id", "q", "site"),
        _WITH + f"SELECT query_id, q, asked_site AS site FROM cleaned WHERE asked_site <> '{ROOT}'"),
    "query_single_char": Check(
        lambda s, d: derived_requests(s, d).select("query_id", R.widen_single_char(F.col("q")).alias("q")),
        _WITH + "SELECT query_id, wide AS q FROM cleaned"),
    "query_normalize": Check(
        lambda s, d: derived_requests(s, d).select("query_id", R.normalize_query(R.widen_single_char(F.col("q")), T).alias("q")),
        _WITH + "SELECT query_id, clean AS q FROM cleaned"),
    "query_exact_synonym": Check(
        lambda s, d: derived_requests(s, d).select("query_id", R.drop_star_of_synonym(
            R.normalize_query(R.widen_single_char(F.col("q")), T), CORPUS.all_synonyms).alias("q")),
        _WITH + "SELECT query_id, query_text AS q FROM prepared"),
    "query_section_boost": Check(
        lambda s, d: resolved(s, d).select("query_id", R.section_query(
            R.drop_star_of_synonym(R.normalize_query(R.widen_single_char(F.col("q")), T), CORPUS.all_synonyms),
            url_section(F.col("site"), F.coalesce("from_url", F.lit("")))).alias("q")),
        _WITH + "SELECT query_id, CASE WHEN query_text <> '' AND section <> '' THEN '((@s:' || section || ') => {$weight: 10} ' "
                "|| query_text || ') | ' || query_text ELSE query_text END AS q FROM prepared"),
    "query_synonym_phrases": Check(phrased, _PHRASED),
    "query_defaults": Check(
        lambda s, d: derived_requests(s, d).select(
            "query_id", F.coalesce("from_url", F.lit("")).alias("from_url"), R.start_or_default(F.col("start")).alias("start"),
            R.num_or_default(F.col("num")).alias("num")),
        _WITH + "SELECT query_id, coalesce(from_url, '') AS from_url, coalesce(start, 0) AS start, least(coalesce(num, 30), 100) AS num FROM requests"),
    "landing_lookup": Check(
        lambda s, d: landed(s, d).select("query_id", "query", "title", "body"),
        _WITH + f", {LANDING_SQL} SELECT query_id, query, title, body FROM prepared JOIN landing ON query = landing_key AND site = '{ROOT}'"),
    "landing_url_join": Check(
        lambda s, d: landed(s, d).select("query_id", join_url(F.col("site"), F.col("url")).alias("url")),
        _WITH + f", {LANDING_SQL} SELECT query_id, {_LANDING_URL} AS url FROM prepared JOIN landing ON query = landing_key AND site = '{ROOT}'"),
}
