"""Sharding by longest processing time: equal texts stay together, the largest job goes to the least loaded shard.

Groups of equal texts that hold a notable share of all bytes are jobs of their own, of which there are few
by definition; all smaller groups are dealt by hash to a fixed number of bundles. So the heap sees a bounded
number of jobs for any input, and bundles are small enough to even out what the large groups leave.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesearch.llm.common import number_rows, texts
from pagesearch.session import materialize

SHARDS = 8
BUNDLES = 4096          # jobs that the small groups are dealt to
OWN_JOB = 1 / 4096      # share of all bytes from which a group is a job of its own: at most 4,096 groups


def longest_first(jobs: dict[int, int], shards: int) -> dict[int, int]:
    """The shard of each job (id to size): sizes descending, each to the least loaded shard through a heap."""
    heap = [(0, shard) for shard in range(shards)]
    placed = {}
    for job, size in sorted(jobs.items(), key=lambda x: (-x[1], x[0])):
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + size, shard))
        placed[job] = shard
    return placed


def _bundle(group: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("bundle"), group), F.lit(BUNDLES))


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Every row of ``docs(doc_id, text)`` with ``size``, ``text_crc32``, ``shard`` and ``slot``.

    ``size`` is the UTF-8 bytes of the text and 1; a null text counts as empty and stays with the empty
    ones. Groups are equal 64-bit hashes of the text: equal texts always meet. Repeated rows take slots
    each, in any order; an empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    rows = materialize(texts(docs).select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("group")), "shard-rows")
    groups = materialize(rows.groupBy("group").agg(F.sum("size").alias("held")), "shard-groups")
    everything = groups.agg(F.sum("held").alias("s")).first().s or 0
    large = {r.group: r.held for r in groups.where(F.col("held") >= max(1.0, everything * OWN_JOB)).collect()}
    small = groups.where(F.col("held") < max(1.0, everything * OWN_JOB))
    bundles = {r.bundle: r.held for r in small.groupBy(_bundle(F.col("group")).alias("bundle"))
               .agg(F.sum("held").alias("held")).collect()}
    # both kinds of job in one heap; a large group's job is told apart by its key
    placed = longest_first({("g", k): v for k, v in large.items()} | {("b", k): v for k, v in bundles.items()}, shards)
    spark = docs.sparkSession
    own = spark.createDataFrame([(k[1], v) for k, v in placed.items() if k[0] == "g"], "group long, own int")
    dealt = [placed.get(("b", b), 0) for b in range(BUNDLES)]
    # at most 4,096 rows on the side that is sent to every executor
    assigned = rows.join(F.broadcast(own), "group", "left").withColumn(
        "shard", F.coalesce("own", F.get(F.array(*[F.lit(s) for s in dealt]), _bundle(F.col("group")).cast("int"))))
    stored = materialize(assigned.select("doc_id", "size", "text_crc32", "shard"), "sharded")
    return number_rows(stored, ["shard"], ["doc_id", "text_crc32", "size"], "slot")


def op5_lpt_sharding(docs: DataFrame) -> DataFrame:
    return shard(docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
                              "slot", F.lit(None).cast("int").alias("grown_shard"))
