"""The write path for many sites at once, each read by its own settings.

Settings are a table, a row per site, that is joined to the pages: selectors, literal terms, validators, scorers, field
weights and synonyms are values of that row, so one plan serves any number of sites and settings.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagesearch.config import DEFAULT_FIELDS, SiteConfig
from pagesearch.functions.scores import boost_pages, boost_top_level_pages
from pagesearch.functions.text import STEM_MARK, SYNONYM_MARK, element_text, literal_pattern, prepare_text, stem, tokens
from pagesearch.functions.urls import normalize_url, url_section
from pagesearch.operators import extract as X, postings as P
from pagesearch.operators.hierarchy import with_hierarchy
from pagesearch.operators.refresh import upsert_latest
from pagesearch.operators.skew import lookup_join
from pagesearch.operators.validate import drop_root_page, hierarchy_marker, title_marker, url_suffix
from pagesearch.plans.index_site import SearchIndex
from pagesearch.plans.search import SearchResult, search
from pagesearch.session import materialize

SCORERS = {"pages": boost_pages, "top_level_pages": boost_top_level_pages}
VALIDATORS: dict[str, Callable] = {"title": title_marker, "url": url_suffix, "hierarchy": hierarchy_marker}
# the tests of VALIDATORS with a value from the row
_FAILS: dict[str, Callable[[Column], Column]] = {
    "title": lambda v: F.contains("title", v), "url": lambda v: F.endswith("url", v),
    "hierarchy": lambda v: F.array_contains("hierarchy", v)}
SETTINGS_SCHEMA = (
    "site string, content_tags array<string>, literal_pattern string, field_weights map<string,double>, no_stem_fields array<string>, "
    "scorers array<string>, see_hierarchy boolean, validators array<struct<kind:string,value:string>>, "
    "groups map<string,array<string>>, runs array<struct<mark:string,words:array<string>>>")


@dataclass(frozen=True)
class SiteSettings:
    """What one site is read with; rules that are code in ``SiteConfig`` are named here."""

    site: str
    content_tags: tuple[str, ...] = ()
    literal_terms: tuple[str, ...] = ()
    field_weights: dict[str, float] = field(default_factory=lambda: dict(DEFAULT_FIELDS))
    no_stem_fields: tuple[str, ...] = ("s",)
    scorers: tuple[str, ...] = ()
    validators: tuple[tuple[str, str], ...] = ()    # (kind, value)
    synonym_groups: dict[str, tuple[str, ...]] = field(default_factory=dict)
    score_hierarchy: str = "parsed"

    def config(self) -> SiteConfig:
        """The same settings for the plans of one site."""
        return SiteConfig(self.site, content_selectors=self.content_tags, literal_terms=self.literal_terms, field_weights=dict(self.field_weights),
                          no_stem_fields=self.no_stem_fields, scorers=tuple(SCORERS[name] for name in self.scorers),
                          validators=tuple(VALIDATORS[kind](value) for kind, value in self.validators),
                          synonym_groups=dict(self.synonym_groups), score_hierarchy=self.score_hierarchy)


def settings_table(spark: SparkSession, settings: Sequence[SiteSettings]) -> DataFrame:
    """A row per site. Fields keep the order of ``DEFAULT_FIELDS``; those without a weight are not indexed."""
    def row(s: SiteSettings) -> tuple:
        groups: dict[str, list[str]] = {}
        for group, members in P.single_word_groups(s.config()):
            for member in members:
                groups.setdefault(member, []).append(SYNONYM_MARK + group)
        runs = [(SYNONYM_MARK + group, m.lower().split()) for group, members in s.synonym_groups.items() for m in members if len(m.split()) > 1]
        return (s.site, list(s.content_tags), literal_pattern(s.literal_terms) if s.literal_terms else "", dict(s.field_weights),
                list(s.no_stem_fields), list(s.scorers), s.score_hierarchy == "resolved", list(s.validators), groups, runs)

    unknown = {n for s in settings for n in s.field_weights} - set(DEFAULT_FIELDS)
    if unknown:
        raise ValueError(f"unknown fields {sorted(unknown)}")
    return spark.createDataFrame([row(s) for s in settings], SETTINGS_SCHEMA)


def page_documents(pages: DataFrame, settings: DataFrame) -> DataFrame:
    """One document per titled page of a site with settings; see ``extract.page_documents``."""
    html = F.coalesce("html", F.lit(""))
    ruled = lookup_join(pages, settings.select("site", "content_tags", "literal_pattern"), ["site"], ["page_id"])
    titled = ruled.withColumn("raw_title", X.raw_title(html)).filter(F.col("raw_title").isNotNull())
    content = F.coalesce(F.get(F.filter(F.transform("content_tags", lambda tag: X.element_content(html, tag)), lambda c: c.isNotNull()),
                               F.lit(0)), html)
    terms = F.col("literal_pattern")
    rows = titled.select(
        "page_id", "site", normalize_url(F.col("url")).alias("url"), X.page_title(F.col("raw_title"), terms).alias("title"),
        F.lit("").alias("section_title"), F.array().cast("array<string>").alias("hierarchy"),
        url_section(F.col("site"), F.col("url")).alias("s"), prepare_text(element_text(content), terms, True).alias("body"),
        F.lit("page").alias("type"), F.lit(0).alias("position"))
    return X.with_ids(rows, SiteConfig(""))


def rejects(docs: DataFrame, settings: DataFrame) -> DataFrame:
    """One row ``(page_id, url, reason)`` per page and reason; the first validator of the site that fails gives it."""
    ruled = lookup_join(docs, settings.filter(F.size("validators") > 0).select("site", "validators"), ["site"], ["page_id"])

    def failed(v: Column) -> Column:
        held = F.lit(False)
        for kind, test in _FAILS.items():
            held = F.when(v["kind"] == kind, test(v["value"])).otherwise(held)
        return held

    first = F.get(F.filter("validators", failed), F.lit(0))
    words = F.create_map(*[F.lit(x) for kind, text in (("title", "title has "), ("url", "url ends with "), ("hierarchy", "hierarchy has "))
                           for x in (kind, text)])
    marked = ruled.withColumn("_first", first).filter(F.col("_first").isNotNull())
    return marked.select("page_id", "url", F.concat(F.element_at(words, F.col("_first.kind")), "_first.value").alias("reason")).distinct()


def with_score(docs: DataFrame, settings: DataFrame) -> DataFrame:
    """Add the document score: the site's scorers in their order."""
    ruled = lookup_join(docs, settings.select("site", "scorers", "see_hierarchy"), ["site"], ["doc_id"])
    seen = F.when(F.col("see_hierarchy"), F.col("hierarchy")).otherwise(F.array().cast("array<string>"))

    def step(score: Column, name: Column) -> Column:
        next_score = score
        for known, scorer in SCORERS.items():
            next_score = F.when(name == known, scorer(score, F.col("type"), seen)).otherwise(next_score)
        return next_score

    return ruled.withColumn("score", F.aggregate("scorers", F.lit(1.0), step)).drop("scorers", "see_hierarchy")


def term_postings(docs: DataFrame, settings: DataFrame) -> DataFrame:
    """See ``postings.term_postings``; weights, stems and synonyms are those of the document's site."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = P._keyed(docs)
    fields, weights = list(DEFAULT_FIELDS), settings.select("site", "field_weights")
    spread = lookup_join(keyed.repartition(partitions, *P.KEY), weights, ["site"], ["doc_id"])
    used = [F.when(F.map_contains_key("field_weights", name), tokens(F.col(name))).otherwise(F.array().cast("array<string>")).alias(name)
            for name in fields]
    split = spread.select(*P.KEY, "site", "field_weights", *used)
    entries, offset = [], F.lit(0)
    for name in fields:
        weight = F.try_element_at("field_weights", F.lit(name))
        entries.append(F.struct(F.lit(name).alias("field"), offset.alias("offset"), weight.alias("weight"), F.col(name).alias("tokens")))
        offset = offset + F.size(name)
    per_field = lookup_join(split.select(*P.KEY, "site", F.inline(F.array(*entries))).filter(F.size("tokens") > 0),
                            settings.select("site", "no_stem_fields", "groups", "runs"), ["site"], P.KEY)
    stemmed = ~F.array_contains("no_stem_fields", F.col("field"))

    def terms_at(token: Column, i: Column) -> Column:
        root = stem(token)
        own = F.filter(F.array(token, F.when(stemmed & (root != token), F.concat(F.lit(STEM_MARK), root))), lambda t: t.isNotNull())
        started = F.transform(F.filter("runs", lambda r: (F.get(r["words"], F.lit(0)) == token)
                                       & (F.slice("tokens", i + 1, F.size(r["words"])) == r["words"])), lambda r: r["mark"])
        single = F.coalesce(F.try_element_at("groups", token), F.array().cast("array<string>"))
        return F.struct((F.col("offset") + i).alias("position"), F.concat(own, F.array_union(single, started)).alias("terms"))

    placed = per_field.select(*P.KEY, "field", "weight", F.inline(F.transform("tokens", terms_at)))
    return P.collected(keyed, placed.select(*P.KEY, "field", "weight", "position", F.explode("terms").alias("term")))


def index_sites(pages: DataFrame, settings: DataFrame) -> SearchIndex:
    """The index tables of all sites; pages ``(page_id, site, url, html)`` of sites without settings are left out."""
    parsed = materialize(page_documents(pages, settings), "parsed")
    valid = drop_root_page(parsed.join(rejects(parsed, settings).select("page_id").distinct(), "page_id", "left_anti"))
    unique = materialize(upsert_latest(with_score(with_hierarchy(valid), settings), ["page_id"]), "documents")
    rows = materialize(term_postings(unique, settings), "postings")
    return SearchIndex(unique, rows, P.dictionary(rows), P.corpus_size(unique), SiteConfig(""))


def search_sites(index: SearchIndex, requests: DataFrame, settings: Sequence[SiteSettings], default_site: str,
                 landing_pages: DataFrame | None = None) -> list[SearchResult]:
    """Answer requests by the settings of their sites: a search per distinct set of rules that queries know.

    Those are literal terms, synonyms and fields without stems; sites that differ in other settings share one. Requests
    to sites without settings are among those of the first search, which finds their site invalid.
    """
    alike: dict[str, list[SiteSettings]] = {}
    for s in settings:
        alike.setdefault(repr((s.literal_terms, sorted(s.synonym_groups.items()), s.no_stem_fields)), []).append(s)
    asked = requests.withColumn("site", F.coalesce("site", F.lit(default_site)))
    spark, found = requests.sparkSession, []
    for number, group in enumerate(alike.values()):
        others = [s.site for g in alike.values() if g is not group for s in g]
        sites = spark.createDataFrame([(site,) for site in (others if number == 0 else [s.site for s in group])], "site string")
        own = lookup_join(asked, sites, ["site"], ["query_id"], "left_anti" if number == 0 else "left_semi").select(*requests.columns)
        found.append(search(replace(index, config=group[0].config()), own, default_site, landing_pages))
    return found
