"""Text clean-up, literal-term escaping, tokens and stems as native column expressions."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from functools import reduce
from html import _invalid_charrefs
from html.entities import html5
from operator import or_

from pyspark.sql import Column, functions as F

from pagesearch.config import STOP_WORDS

# The characters that Python's str.strip() removes.
WHITESPACE = "".join(map(chr, [
    *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
    0x202F, 0x205F, 0x3000]))
# Punctuation that gets a backslash inside a literal term.
PUNCTUATION = r"""[,.<>{}\[\]\\"':;!@#$%^&*()\-+=~]"""
# A token is a run of characters that are neither space nor ASCII punctuation (the underscore
# joins); a backslash keeps the punctuation after it inside the token. Listing the characters one by
# one makes the regex engine test them in one table look-up. Possessive repeats run in a loop, not in
# recursion, so a token may be of any length.
SEPARATORS = r"""\t\n\f\r !"#$%&'()*+,\-./:;<=>?@\[\\\]\^`{|}~"""
TOKEN = rf"((?:[^{SEPARATORS}]++|\\[^\p{{L}}\p{{N}}\s])++)"

NEVER = r"\z\A."     # a pattern that matches nowhere

REGEX_SIGNS = set(r".^$*+?{}[]\|()")

# Index terms that are not plain tokens carry a mark with a space, which no token can contain.
STEM_MARK = "+ "
SYNONYM_MARK = "~ "


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(WHITESPACE))


def literal_pattern(terms: Sequence[str]) -> str:
    """Alternation of the literal terms, each a regular expression matched in any case.

    When no term can start with anything but its first letter or digit, a look-ahead on these
    characters skips most of the text without trying every term.
    """
    starts = sorted({term[0] for term in terms})
    either = "|".join(terms)
    if all(term[0].isalnum() and not REGEX_SIGNS & set(term[:2]) and "|" not in term for term in terms):
        return f"(?iud)(?=[{''.join(starts)}])(?:{either})"
    return f"(?iud){either}"


def escape_literals(text: Column, terms: Sequence[str] | Column) -> Column:
    """Backslash the punctuation inside each case-insensitive match of a literal term.

    The text is cut at the matches, each match is escaped, and both are laced together again; a
    term may match inside a word. A text without a match passes through. A column holds each row's own
    ``literal_pattern``, empty or null for none.
    """
    if isinstance(terms, Column):
        pattern = F.when(terms != "", terms).otherwise(NEVER)
    else:
        terms = [term for term in terms if term]
        if not terms:
            return text
        pattern = F.lit(literal_pattern(terms))
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    around = F.split(text, pattern, -1)
    laced = F.zip_with(
        around, found,
        lambda gap, hit: F.concat(gap, F.coalesce(F.regexp_replace(hit, PUNCTUATION, r"\\$0"), F.lit(""))))
    return F.when(F.rlike(text, pattern), F.array_join(laced, "")).otherwise(text)


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit("\\"), F.lit(""))


def prepare_text(text: Column, terms: Sequence[str] | Column = (), strip_symbols: bool = False) -> Column:
    base = F.replace(strip(text), F.lit("\n"), F.lit(" "))
    if strip_symbols:
        base = F.replace(base, F.lit("#"), F.lit(" "))
    return escape_literals(base, terms)


def all_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(1))


def tokens(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Tokens without stop words, unescaped; a position counts kept tokens only."""
    kept = F.filter(all_tokens(text), lambda t: ~t.isin(*stop_words))
    return F.transform(kept, unescape)


def stem(token: Column) -> Column:
    """Harman's S-stemmer for words longer than three letters."""
    ends = lambda *suffixes: reduce(or_, [F.endswith(token, F.lit(s)) for s in suffixes])
    size = F.length(token)
    without_s = F.left(token, size - 1)
    return (
        F.when(size <= 3, token)
        .when(ends("ies") & ~ends("eies", "aies"), F.concat(F.left(token, size - 3), F.lit("y")))
        .when(ends("es") & ~ends("aes", "ees", "oes"), without_s)
        .when(ends("s") & ~ends("us", "ss"), without_s)
        .otherwise(token)
    )


# the named references of HTML with and without a semicolon, and what stands for numbers that are no characters, as the
# standard library has them; the tree of a page decodes by the same tables
NAMED = json.dumps(html5)
LONGEST_BARE = max(len(name) for name in html5 if not name.endswith(";"))
REPLACED = json.dumps({f"{number:08X}": char for number, char in _invalid_charrefs.items()})
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9A-Fa-f]+;?|[^\t\n\f <&#;]{1,32};?)"
MARKUP = r"(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>|<!--.*?-->|<!doctype[^>]*>|<[^>]+>"


def _numbered(reference: Column) -> Column:
    """The character of a numeric reference of any length."""
    digits = F.regexp_extract(reference, r"\A&#[xX]?0*([0-9A-Fa-f]*)", 1)
    number = F.when(reference.rlike(r"\A&#[xX]"), F.when(F.length(digits) <= 6, F.upper(digits))) \
        .when(digits == "", "0").when(F.length(digits) <= 7, F.conv(digits, 10, 16))
    code = F.lpad(number, 8, "0")
    nothing = (code.between("00000001", "00000008") | (code == "0000000B") | code.between("0000000E", "0000001F")
               | code.between("0000007F", "0000009F") | code.between("0000FDD0", "0000FDEF") | F.right(code, F.lit(4)).isin("FFFE", "FFFF"))
    outside = code.isNull() | (code > "0010FFFF") | code.between("0000D800", "0000DFFF")
    return F.coalesce(F.try_element_at(F.from_json(F.lit(REPLACED), "map<string,string>"), code),
                      F.when(outside, "\ufffd").when(nothing, "").otherwise(F.decode(F.unhex(code), "UTF-32")))


def _named(reference: Column) -> Column:
    """The characters of a named reference, or of the longest name that it starts with; what stands for none stays."""
    names = F.from_json(F.lit(NAMED), "map<string,string>")
    name = F.substr(reference, F.lit(2))
    starts = [F.when(F.length(name) > n, F.concat(F.try_element_at(names, F.left(name, F.lit(n))), F.substr(name, F.lit(n + 1))))
              for n in range(LONGEST_BARE, 1, -1)]
    return F.coalesce(F.try_element_at(names, name), *starts, reference)


def _referred(reference: Column) -> Column:
    return F.when(F.startswith(reference, F.lit("&#")), _numbered(reference)).otherwise(_named(reference))


def decode_entities(text: Column) -> Column:
    """Decode named and numeric character references once, from left to right."""
    def decoded(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(REFERENCE), F.lit(0))
        laced = F.zip_with(F.split(t, REFERENCE, -1), found,
                           lambda gap, hit: F.concat(gap, F.coalesce(_referred(hit), F.lit(""))))
        return F.when(F.contains(t, F.lit("&")), F.array_join(laced, "")).otherwise(t)

    return let(text, decoded)


def element_text(html: Column) -> Column:
    return decode_entities(F.regexp_replace(html, MARKUP, ""))
