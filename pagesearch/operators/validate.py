"""Validators, and the rule that one failing document drops its whole page."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from pagesearch.config import Validator
from pagesearch.functions.urls import trim_slashes


def title_marker(marker: str) -> Validator:
    return f"title has {marker}", lambda c: F.contains(c["title"], F.lit(marker))


def url_suffix(suffix: str) -> Validator:
    return f"url ends with {suffix}", lambda c: F.endswith(c["url"], F.lit(suffix))


def hierarchy_marker(marker: str) -> Validator:
    return f"hierarchy has {marker}", lambda c: F.array_contains(c["hierarchy"], marker)


# The markers that documentation sites reject.
skip_release_notes = title_marker("Release Notes")
skip_404_url = url_suffix("404.html")
skip_404_hierarchy = hierarchy_marker("404 Page not found")


def with_reason(docs: DataFrame, validators: Sequence[Validator]) -> DataFrame:
    """Add the reason of the first validator that fails, null when all pass."""
    columns = {name: F.col(name) for name in docs.columns}
    reasons = [F.when(failed(columns), F.lit(reason)) for reason, failed in validators]
    return docs.withColumn("reason", F.coalesce(*reasons, F.lit(None).cast("string")))


def rejects(docs: DataFrame, validators: Sequence[Validator]) -> DataFrame:
    """One row per page and reason."""
    failed = with_reason(docs, validators).filter(F.col("reason").isNotNull())
    return failed.select("page_id", "url", "reason").distinct()


def keep_valid_pages(docs: DataFrame, validators: Sequence[Validator]) -> DataFrame:
    if not validators:
        return docs
    failed = rejects(docs, validators).select("page_id").distinct()
    return docs.join(failed, "page_id", "left_anti")


def drop_root_page(docs: DataFrame) -> DataFrame:
    return docs.filter(trim_slashes(F.col("url")) != trim_slashes(F.col("site")))
