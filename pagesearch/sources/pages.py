"""Crawled pages and the registry of sites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pagesearch.config import SiteConfig
from pagesearch.functions.urls import site_of
from pagesearch.operators.skew import lookup_join

PAGE_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGE_SCHEMA).parquet(path)


def on_site(pages: DataFrame, site_url: str) -> DataFrame:
    return pages.filter(F.startswith("url", F.lit(site_url))).withColumn("site", F.lit(site_url))


def site_registry(spark: SparkSession, configs: Sequence[SiteConfig]) -> DataFrame:
    return spark.createDataFrame([(c.url,) for c in configs], "site string")


def assign_sites(pages: DataFrame, sites: DataFrame) -> DataFrame:
    """Give each page the sites whose URL it starts with, by an equi join on scheme and host."""
    registry = sites.select("site", site_of(F.col("site")).alias("_host"))
    hosted = pages.withColumn("_host", site_of(F.col("url")))
    joined = lookup_join(hosted, registry, ["_host"], ["page_id"])
    return joined.filter(F.startswith("url", F.col("site"))).drop("_host")
