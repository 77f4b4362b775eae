"""Site settings: which fields, terms, synonyms, filters, scorers and landing pages a site uses."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column

# The default English stop words of the index.
STOP_WORDS = (
    "a an and are as at be but by for if in into is it no not of on or such that the their then "
    "there these they this to was will with"
).split()

# One-letter prefix queries are answered as these two-letter prefixes.
SINGLE_CHAR_PREFIXES = {
    "a": "ac", "b": "be", "c": "co", "d": "de", "e": "en", "f": "fi", "g": "ge", "h": "hi",
    "i": "in", "j": "ja", "k": "ku", "l": "lo", "m": "ma", "n": "ne", "o": "of", "p": "pe",
    "q": "qu", "r": "ra", "s": "se", "t": "ta", "u": "us", "v": "vo", "w": "we", "x": ".x",
    "y": "ya", "z": "zo",
}

DEFAULT_NUM = 30
MAX_NUM = 100
ELIDE_LENGTH = 100
SUMMARY_WORDS = 10
SECTION_WEIGHT = 10.0
SCORE_FLOOR = 0.01

# Order gives each field its place in the document-wide token positions.
DEFAULT_FIELDS = {"title": 10.0, "section_title": 1.0, "body": 1.5, "url": 1.0, "s": 1.0}

Scorer = Callable[[Column, Column, Column], Column]  # (score, type, hierarchy) -> score
Validator = tuple[str, Callable[[dict[str, Column]], Column]]  # (reason, columns -> failed?)


@dataclass(frozen=True)
class LandingPage:
    query: str
    title: str
    url: str
    body: str = ""
    section_title: str = ""
    hierarchy: tuple[str, ...] = ()


@dataclass(frozen=True)
class SiteConfig:
    url: str
    key_prefix: str = "search"
    field_weights: dict[str, float] = field(default_factory=lambda: dict(DEFAULT_FIELDS))
    no_stem_fields: tuple[str, ...] = ("s",)
    content_selectors: tuple[str, ...] = ()
    header_tags: tuple[str, ...] = ("h2", "h3")
    allow: tuple[str, ...] = ()
    deny: tuple[str, ...] = ()
    literal_terms: tuple[str, ...] = ()
    synonym_groups: dict[str, tuple[str, ...]] = field(default_factory=dict)
    first_group_only: bool = False
    landing_pages: tuple[LandingPage, ...] = ()
    scorers: tuple[Scorer, ...] = ()
    validators: tuple[Validator, ...] = ()
    # 'parsed': scorers see the empty hierarchy a parsed page has; 'resolved': they see the breadcrumbs
    score_hierarchy: str = "parsed"

    @property
    def all_synonyms(self) -> list[str]:
        return sorted({term for terms in self.active_groups.values() for term in terms})

    @property
    def active_groups(self) -> dict[str, tuple[str, ...]]:
        if self.first_group_only:
            return dict(list(self.synonym_groups.items())[:1])
        return self.synonym_groups
