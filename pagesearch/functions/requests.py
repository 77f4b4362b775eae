"""Search request clean-up, one column expression per rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from pagesearch.config import DEFAULT_NUM, MAX_NUM, SINGLE_CHAR_PREFIXES
from pagesearch.functions.text import escape_literals, strip


def widen_single_char(q: Column) -> Column:
    """``x*`` with one letter a-z becomes a two-letter prefix from the fixed map."""
    pairs = [F.lit(part) for pair in SINGLE_CHAR_PREFIXES.items() for part in pair]
    wider = F.try_element_at(F.create_map(*pairs), F.substring(q, 1, 1))
    is_single = (F.length(q) == 2) & q.endswith("*") & wider.isNotNull()
    return F.when(is_single, F.concat(wider, F.lit("*"))).otherwise(q)


def normalize_query(q: Column, terms: Sequence[str] = ()) -> Column:
    clean = F.replace(strip(q), F.lit("-*"), F.lit("*"))
    clean = F.translate(clean, "[]<>+", "     ")
    return escape_literals(strip(clean), terms)


def drop_star_of_synonym(q: Column, synonyms: Sequence[str]) -> Column:
    """A prefix query for a whole synonym term is an exact query."""
    if not synonyms:
        return q
    bare = F.regexp_replace(q, r"\*+\z", "")
    return F.when(q.endswith("*") & bare.isin(*synonyms), bare).otherwise(q)


def section_query(q: Column, section: Column) -> Column:
    """The boosted form of a query, as text; matching itself adds the weight in the score."""
    boosted = F.concat(F.lit("((@s:"), section, F.lit(") => {$weight: 10} "), q, F.lit(") | "), q)
    return F.when((q != "") & (section != ""), boosted).otherwise(q)


def landing_key(q: Column) -> Column:
    return F.replace(q, F.lit("*"), F.lit(""))


def start_or_default(start: Column) -> Column:
    return F.coalesce(start, F.lit(0))


def num_or_default(num: Column) -> Column:
    return F.least(F.coalesce(num, F.lit(DEFAULT_NUM)), F.lit(MAX_NUM))
