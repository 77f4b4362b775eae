"""Upserts and the difference between two crawls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from pagesearch.operators.skew import salted_join


def upsert_latest(docs: DataFrame, order_by: Sequence[str], *keys: str) -> DataFrame:
    """One row per key (``doc_key`` when none is given), the last by ``order_by``; copies of one key are combined before the shuffle."""
    keys = keys or ("doc_key",)
    rest = [c for c in docs.columns if c not in keys and c not in order_by]
    last = F.max(F.struct(*order_by, *rest)).alias("_last")
    return docs.groupBy(*keys).agg(last).select(
        *[F.col(c) if c in keys else F.col(f"_last.{c}").alias(c) for c in docs.columns])


def stale_documents(indexed: DataFrame, seen: DataFrame) -> DataFrame:
    """Ids in the index that the latest crawl did not produce."""
    known = indexed.filter(F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return known.join(seen.select("doc_id").distinct(), "doc_id", "left_anti")


def refresh_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Each id as kept, new, changed (new content at a known URL), replaced or gone."""
    before = old.select("doc_id", "url").distinct().withColumn("in_old", F.lit(True))
    after = new.select("doc_id", "url").distinct().withColumn("in_new", F.lit(True))
    both = before.join(after, ["doc_id", "url"], "full_outer")
    kept = F.col("in_old").isNotNull() & F.col("in_new").isNotNull()
    per_url = both.groupBy("url").agg(
        F.max(F.coalesce("in_old", F.lit(False))).alias("url_in_old"),
        F.max(F.coalesce("in_new", F.lit(False))).alias("url_in_new"))
    # many versions of one page may meet here, so its rows are spread over salts
    moved = salted_join(both.filter(~kept), per_url, ["url"], ["doc_id"])
    status = (
        F.when(F.col("in_new").isNotNull(), F.when(F.col("url_in_old"), "changed").otherwise("new"))
        .otherwise(F.when(F.col("url_in_new"), "replaced").otherwise("gone")))
    return both.filter(kept).select("doc_id", "url", F.lit("kept").alias("status")) \
        .unionByName(moved.select("doc_id", "url", status.alias("status")))


def site_urls(docs: DataFrame) -> DataFrame:
    return docs.select("site", "url").distinct()


def stale_urls(indexed: DataFrame, seen: DataFrame) -> DataFrame:
    return site_urls(indexed).join(site_urls(seen), ["site", "url"], "left_anti")
