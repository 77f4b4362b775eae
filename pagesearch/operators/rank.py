"""Totals, ranks and result pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from pagesearch.config import SECTION_WEIGHT
from pagesearch.operators.skew import salted_join
from pagesearch.session import fits_broadcast, materialize

# Up to this depth a rank comes from a window with a literal limit, which Spark applies before
# the shuffle. Deeper pages are ranked by a range sort over all tasks.
WINDOW_DEPTH = 1000


def final_score(hits: DataFrame) -> DataFrame:
    """Document score times the query's score, with the boosted branch added inside the section."""
    boosted = F.coalesce(F.lit(SECTION_WEIGHT) * F.col("section_part") + F.col("base"), F.lit(0.0))
    return hits.withColumn("score", F.round(F.col("doc_score") * (F.col("base") + boosted), 6))


def totals(hits: DataFrame) -> DataFrame:
    return hits.groupBy("qkey").agg(F.count("*").alias("total"))


def top_ranks(hits: DataFrame, depth: int) -> DataFrame:
    """Ranks 1 to ``depth`` per query; every task passes on its own best ``depth`` rows only."""
    order = W.partitionBy("qkey").orderBy(F.desc("score"), "doc_id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= F.lit(depth))


def by_rank(hits: DataFrame) -> DataFrame:
    """Hits by query and rank, range by range, each with the number of its range.

    The split is written, as a second run of it could cut elsewhere.
    """
    split = hits.repartitionByRange(F.asc("qkey"), F.desc("score"), F.asc("doc_id"))
    return materialize(split.withColumn("_task", F.spark_partition_id()), "by-rank")


def ranks_of(split: DataFrame) -> DataFrame:
    """The hits of ``by_rank`` with their ranks: count per range, add up, number inside each range."""
    counts = split.groupBy("qkey", "_task").agg(F.count("*").alias("_n"))
    before = W.partitionBy("qkey").orderBy("_task").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("qkey", "_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = F.row_number().over(W.partitionBy("_task", "qkey").orderBy(F.desc("score"), F.asc("doc_id")))
    return split.withColumn("_local", local).join(offsets, ["qkey", "_task"]) \
        .withColumn("rank", (F.col("_before") + F.col("_local")).cast("int")).drop("_task", "_local", "_before")


def all_ranks(hits: DataFrame) -> DataFrame:
    """Exact ranks of any depth. No query is gathered in one task, however many hits it has."""
    return ranks_of(by_rank(hits))


def first_ranks(hits: DataFrame, depth: int) -> DataFrame:
    """Ranks 1 to ``depth`` per query, however deep that is."""
    return top_ranks(hits, depth) if depth <= WINDOW_DEPTH else all_ranks(hits).filter(F.col("rank") <= F.lit(depth))


def page_ranks(hits: DataFrame, requests: DataFrame, window_depth: int = WINDOW_DEPTH) -> DataFrame:
    """The hits of each request's page: rows of ``hits`` plus ``query_id`` and ``rank``.

    ``requests`` has rows ``(query_id, qkey, start, num)``.
    """
    end = F.col("start").cast("long") + F.col("num")
    asked = requests.select("query_id", "qkey", "start", end.alias("end"))
    deepest = asked.agg(F.max("end"), F.max(F.when(F.col("end") <= window_depth, F.col("end")))).first()
    parts = []
    if deepest[1] is not None:
        shallow = asked.filter(F.col("end") <= window_depth)
        parts.append(_cut(top_ranks(hits, int(deepest[1])), shallow))
    if deepest[0] is not None and deepest[0] > window_depth:
        deep = asked.filter(F.col("end") > window_depth)
        wanted = hits.join(deep.select("qkey").distinct(), "qkey", "left_semi")
        parts.append(_cut(all_ranks(wanted), deep))
    if not parts:
        parts.append(_cut(top_ranks(hits, 0), asked))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _cut(ranked: DataFrame, asked: DataFrame) -> DataFrame:
    """The asked ranks; many requests may share one query, so they are the side that is spread."""
    if fits_broadcast(asked):
        joined = ranked.join(F.broadcast(asked), "qkey")
    else:
        joined = salted_join(asked, ranked, ["qkey"], ["query_id"])
    return joined.filter((F.col("rank") > F.col("start")) & (F.col("rank") <= F.col("end"))).drop("start", "end")


def first_per_url(page: DataFrame) -> DataFrame:
    """One hit per request and URL, the best ranked; a page of results is at most 100 rows."""
    order = W.partitionBy("query_id", "url").orderBy("rank")
    return page.withColumn("_nth", F.row_number().over(order)).filter(F.col("_nth") == 1).drop("_nth")
