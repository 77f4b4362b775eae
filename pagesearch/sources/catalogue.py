"""Curated landing pages, from settings and from a catalogue of commands."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pagesearch.config import LandingPage

CATALOGUE_TYPE = "map<string,struct<summary:string>>"
LANDING_SCHEMA = (
    "site string, query string, title string, section_title string, "
    "hierarchy array<string>, body string, url string"
)


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``(name, summary)`` of a JSON file ``{NAME: {"summary": ...}}``."""
    text = spark.read.text(path, wholetext=True)
    entries = text.select(F.explode(F.from_json("value", CATALOGUE_TYPE)).alias("name", "entry"))
    return entries.select("name", F.col("entry.summary").alias("summary"))


def command_landing_pages(catalogue: DataFrame, site: Column) -> DataFrame:
    """One page per name without a space, reachable by the name as written and in lower case.

    Names that differ in case share a key; the page of the last in byte order keeps it.
    """
    low = F.lower("name")
    columns = ["title", "section_title", "hierarchy", "body", "url"]
    # The sentence and the breadcrumb of a command without a summary
    default = F.concat(F.lit("Documentation for command '"), low, F.lit("'"))
    pages = (
        catalogue.filter(~F.contains("name", F.lit(" ")))
        .withColumn("query", F.explode(F.array_distinct(F.array("name", low))))
        .select(
            site.alias("site"), "query", F.col("name").alias("title"), F.lit("").alias("section_title"),
            F.array(F.lit("Commands")).alias("hierarchy"),
            F.coalesce("summary", default).alias("body"),
            F.concat(F.lit("/commands/"), low, F.lit("/")).alias("url"))
    )
    return pages.groupBy("site", "query").agg(F.max(F.struct(*columns)).alias("page")).select(
        "site", "query", *[f"page.{c}" for c in columns])


def configured_landing_pages(spark: SparkSession, site: str, pages: Sequence[LandingPage]) -> DataFrame:
    rows = [(site, p.query, p.title, p.section_title, list(p.hierarchy), p.body, p.url) for p in pages]
    return spark.createDataFrame(rows, LANDING_SCHEMA)


def merge_landing_pages(base: DataFrame, override: DataFrame) -> DataFrame:
    """Union in which the second source wins for a key both have."""
    payload = ["title", "section_title", "hierarchy", "body", "url"]
    both = base.withColumn("_priority", F.lit(0)).unionByName(override.withColumn("_priority", F.lit(1)))
    best = F.max(F.struct("_priority", *payload)).alias("best")
    return both.groupBy("site", "query").agg(best).select("site", "query", *[f"best.{c}" for c in payload])
