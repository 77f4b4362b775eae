"""SQL for DuckDB: the text rules as SQL expressions, and the corpus as a chain of CTEs."""

from __future__ import annotations

from collections.abc import Sequence

from pagesearch.config import STOP_WORDS, SiteConfig
from pagesearch.functions.text import PUNCTUATION
from pagesearch.workload.sites import CORPUS, ROOT

# The characters that Python's str.strip() removes, as a character class.
WHITESPACE = (
    r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
# the same language as the Spark pattern, written for an engine without backtracking
TOKEN = r"((?:[^\s!-/:-@\[-^`{-~]|\\[^\p{L}\p{N}\s])+)"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(items: Sequence[str]) -> str:
    return ", ".join(lit(item) for item in items)


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '\A[{WHITESPACE}]+|[{WHITESPACE}]+\z', '', 'g')"


def escape(x: str, terms: Sequence[str]) -> str:
    if not terms:
        return x
    pattern = lit("(?i)" + "|".join(terms))
    escaped = rf"regexp_replace(e[2], {lit(PUNCTUATION)}, '\\\0', 'g')"
    return (f"array_to_string(list_transform(list_zip(string_split_regex({x}, {pattern}), "
            f"regexp_extract_all({x}, {pattern}, 0)), lambda e: e[1] || coalesce({escaped}, '')), '')")


def prepare(x: str, terms: Sequence[str] = (), strip_symbols: bool = False) -> str:
    base = f"replace({strip(x)}, chr(10), ' ')"
    if strip_symbols:
        base = f"replace({base}, '#', ' ')"
    return escape(base, terms)


def unescape(x: str) -> str:
    return rf"replace({x}, '\', '')"


def all_tokens(x: str) -> str:
    return f"regexp_extract_all(lower({x}), {lit(TOKEN)}, 1)"


def tokens(x: str) -> str:
    kept = f"list_filter({all_tokens(x)}, lambda t: t NOT IN ({words(STOP_WORDS)}))"
    return f"list_transform({kept}, lambda t: {unescape('t')})"


def stem(x: str) -> str:
    return (f"CASE WHEN length({x}) <= 3 THEN {x} "
            f"WHEN {x} LIKE '%ies' AND {x} NOT LIKE '%eies' AND {x} NOT LIKE '%aies' THEN left({x}, length({x}) - 3) || 'y' "
            f"WHEN {x} LIKE '%es' AND {x} NOT LIKE '%aes' AND {x} NOT LIKE '%ees' AND {x} NOT LIKE '%oes' THEN left({x}, length({x}) - 1) "
            f"WHEN {x} LIKE '%s' AND {x} NOT LIKE '%us' AND {x} NOT LIKE '%ss' THEN left({x}, length({x}) - 1) ELSE {x} END")


def trim_slashes(x: str) -> str:
    return rf"regexp_replace({x}, '/+\z', '')"


def section(root: str, url: str) -> str:
    path = f"replace(replace({url}, {root}, ''), '//', '/')"
    first = f"list_filter(string_split({path}, '/'), lambda p: p <> '')[1]"
    return f"CASE WHEN starts_with({url}, {root}) THEN coalesce({first}, '') ELSE '' END"


# Entities that the given pages use, and a few more; the ampersand comes last.
ENTITIES = {
    "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ",
    "&copy;": "©", "&reg;": "®", "&middot;": "·", "&mdash;": "—",
    "&ndash;": "–", "&hellip;": "…", "&amp;": "&",
}


def markup_free(x: str) -> str:
    from pagesearch.functions.text import MARKUP

    text = f"regexp_replace({x}, {lit(MARKUP)}, '', 'g')"
    for entity, char in ENTITIES.items():
        text = f"replace({text}, {lit(entity)}, {lit(char)})"
    return text


def values(rows: Sequence[Sequence], names: str) -> str:
    def one(value):
        if value is None:
            return "NULL"
        if isinstance(value, (list, tuple)):
            return f"[{words(value)}]" if value else "CAST([] AS VARCHAR[])"
        return lit(value) if isinstance(value, str) else str(value)

    body = ", ".join("(" + ", ".join(one(v) for v in row) + ")" for row in rows)
    return f"(SELECT * FROM (VALUES {body}) AS v({names}))"


# ---- the corpus ---------------------------------------------------------------------------

_T = CORPUS.literal_terms
_TITLE = prepare("split_part(split_part(text, chr(10), 1), '.', 1)", _T, True)
_PART_BODY = f"CASE WHEN n = 0 THEN {prepare('raw', _T, True)} ELSE {prepare('raw', _T)} END"



def _page_id(url: str) -> str:
    return f"-('0x' || substr(md5({url}), 1, 12))::BIGINT - 1"


def corpus_parts(source: str = "documents", tag: str = "") -> str:
    """CTEs up to ``docs`` over a table of documents; the tag tells two versions apart."""
    return f"""
doc_parts{tag} AS (
  SELECT doc_id AS page_id, '{ROOT}/' || source || '/' || lang || '/' || doc_id AS url, {_TITLE} AS title,
         generate_subscripts(parts, 1) - 1 AS n, unnest(parts) AS raw
  FROM (SELECT *, list_concat([text], string_split(text, chr(10))) AS parts FROM {source})),
index_parts{tag} AS (
  SELECT DISTINCT {_page_id(f"'{ROOT}/' || source")} AS page_id, '{ROOT}/' || source AS url, 'Source ' || source AS title, 0 AS n, 'Source ' || source AS raw FROM {source}
  UNION ALL
  SELECT DISTINCT {_page_id(f"'{ROOT}/' || source || '/' || lang")}, '{ROOT}/' || source || '/' || lang, 'Language ' || lang, 0, 'Language ' || lang FROM {source}),
bodies{tag} AS (
  SELECT page_id, '{ROOT}' AS site, url, title, '' AS section_title, {section(lit(ROOT), 'url')} AS s,
         {_PART_BODY} AS body, CASE WHEN n = 0 THEN 'page' ELSE 'section' END AS type, CAST(greatest(n - 1, 0) AS INTEGER) AS position
  FROM (SELECT * FROM doc_parts{tag} UNION ALL SELECT * FROM index_parts{tag})),
docs{tag} AS (
  SELECT *, 'search:' || site || ':doc:' || doc_id AS doc_key FROM (
    SELECT *, url || CASE WHEN type = 'page' THEN ':page:' || md5(body || title)
                          ELSE ':section:' || md5(body || section_title || title || CAST(position AS VARCHAR)) END AS doc_id
    FROM bodies{tag}))"""


CORPUS_PARTS = corpus_parts()

CORPUS_HIERARCHY = CORPUS_PARTS + f""",
titles AS (SELECT site, {trim_slashes('url')} AS url, replace(arg_max(title, page_id), '//', '') AS title
           FROM docs GROUP BY ALL),
steps AS (
  SELECT site, url, k, '{ROOT}/' || array_to_string(path[1:k], '/') AS prefix
  FROM (SELECT site, url, path, unnest(range(1, len(path) + 1)) AS k
        FROM (SELECT site, url, string_split(trim(replace(replace(url, site, ''), '//', '/'), '/'), '/') AS path FROM titles))),
hierarchies AS (
  SELECT s.site, s.url, list(t.title ORDER BY s.k) AS hierarchy
  FROM steps s JOIN titles t ON t.site = s.site AND t.url = s.prefix WHERE t.title <> '' GROUP BY ALL),
scored AS (
  SELECT *, greatest(boosted - log10(greatest(len(hierarchy), 1)) / 2, 0.01) AS score FROM (
    SELECT d.*, coalesce(h.hierarchy, CAST([] AS VARCHAR[])) AS hierarchy,
           greatest(CAST(1.0 AS DOUBLE) - CASE WHEN type <> 'page' THEN 0.25 ELSE 0 END, 0.01) AS boosted
    FROM docs d LEFT JOIN hierarchies h ON h.site = d.site AND h.url = {trim_slashes('d.url')}))"""


def _runs(config: SiteConfig) -> str:
    """Rows of synonym members of several words, found as neighbouring tokens of one field."""
    pieces = []
    for group, members in config.active_groups.items():
        for member in members:
            parts = member.lower().split()
            if len(parts) < 2:
                continue
            joins = "".join(
                f" JOIN toks t{i} ON t{i}.doc_id = t0.doc_id AND t{i}.field = t0.field AND t{i}.position = t0.position + {i}"
                f" AND t{i}.token = {lit(w)}" for i, w in enumerate(parts) if i)
            pieces.append(f" UNION ALL SELECT t0.site, t0.doc_id, t0.field, t0.position, {lit('~ ' + group)} "
                          f"FROM toks t0{joins} WHERE t0.token = {lit(parts[0])}")
    return "".join(pieces)


def _singles(config: SiteConfig) -> str:
    from pagesearch.operators.postings import single_word_groups

    return "".join(f" UNION ALL SELECT site, doc_id, field, position, {lit('~ ' + g)} FROM toks WHERE token IN ({words(ws)})"
                   for g, ws in single_word_groups(config))


_FIELDS = list(CORPUS.field_weights)
_WEIGHT = "CASE field " + " ".join(f"WHEN {lit(f)} THEN {float(w)}" for f, w in CORPUS.field_weights.items()) + " END"

CORPUS_INDEX = CORPUS_HIERARCHY + f""",
unique_docs AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY doc_key ORDER BY page_id DESC) = 1),
field_lists AS (
  SELECT site, doc_id, {', '.join(f"{tokens(f)} AS tk_{f}" for f in _FIELDS)} FROM unique_docs),
toks AS (
  {' UNION ALL '.join(
    f"SELECT site, doc_id, {lit(f)} AS field, {' + '.join(['0'] + [f'len(tk_{g})' for g in _FIELDS[:i]])} "
    f"+ generate_subscripts(tk_{f}, 1) - 1 AS position, unnest(tk_{f}) AS token FROM field_lists"
    for i, f in enumerate(_FIELDS))}),
occurrences AS (
  SELECT site, doc_id, field, position, token AS term FROM toks
  UNION ALL SELECT site, doc_id, field, position, '+ ' || {stem('token')} FROM toks WHERE field <> 's' AND {stem('token')} <> token
  {_singles(CORPUS)}{_runs(CORPUS)}),
postings AS (
  SELECT site, term, doc_id, field, count(*) AS tf, count(*) * {_WEIGHT} AS wtf, list(position ORDER BY position) AS positions
  FROM occurrences GROUP BY site, term, doc_id, field),
term_docs AS (SELECT site, term, doc_id, sum(wtf) AS wtf FROM postings GROUP BY ALL),
norms AS (SELECT doc_id, max(wtf) AS max_wtf FROM term_docs WHERE NOT starts_with(term, '+ ') AND NOT starts_with(term, '~ ') GROUP BY ALL),
dictionary AS (SELECT site, term, count(*) AS df FROM term_docs GROUP BY ALL),
sizes AS (SELECT site, count(*) AS n_docs FROM unique_docs GROUP BY ALL),
weighted AS (
  SELECT p.*, d.score AS doc_score, p.wtf / n.max_wtf * log2(1 + (z.n_docs + 1) / CAST(k.df AS DOUBLE)) AS part
  FROM postings p JOIN norms n USING (doc_id) JOIN dictionary k ON k.site = p.site AND k.term = p.term
  JOIN sizes z ON z.site = p.site JOIN unique_docs d ON d.doc_id = p.doc_id)"""
