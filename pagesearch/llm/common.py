"""Column helpers and gapless numbering shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The words of a text, between the six ASCII white space characters
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
SPANS = "array<struct<kind:int,start:int,end:int,value:string>>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(text: Column) -> Column:
    """Lower-case A to Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column, pattern: str = WORD) -> Column:
    """All words of the whole text in order; none for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array().cast("array<string>"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda so_far, x: so_far + x)


def _ends(lengths: Column) -> Column:
    """Running sums of an array of numbers, by blocks, so that long arrays do not cost their square."""
    block = 256

    def run(x: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / block).cast("int")),
                             lambda b: total(F.slice(x, b * block + 1, block)))
        return let(blocks, lambda sums: F.transform(x, lambda _, i: total(
            F.slice(sums, 1, F.floor(i / block).cast("int"))) + total(
            F.slice(x, F.floor(i / block).cast("int") * block + 1, i % block + 1))))

    return F.when(F.size(lengths) > 0, let(lengths, run)).otherwise(F.array().cast("array<bigint>"))


def spans_of(text: Column, pattern: str, kind: int, gate: Column) -> Column:
    """Every match with its place in code points; ``gate`` skips texts without any."""
    def found(parts: Column, hits: Column) -> Column:
        # the pieces between the matches, each with the match that follows it
        lengths = F.transform(hits, lambda m, i: (F.length(F.get(parts, i)) + F.length(m)).cast("long"))
        return let(_ends(lengths), lambda ends: F.transform(hits, lambda m, i: F.struct(
            F.lit(kind).alias("kind"), (F.get(ends, i) - F.length(m)).cast("int").alias("start"),
            F.get(ends, i).cast("int").alias("end"), m.alias("value"))))

    spans = let(F.split(text, pattern, -1), lambda parts: let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: found(parts, hits)))
    return F.when(gate, spans).otherwise(F.array().cast(SPANS))


def texts(docs: DataFrame) -> DataFrame:
    """Only the columns an operator reads, so that extra columns of any name do no harm."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def number_rows(rows: DataFrame, groups: Sequence[str], order: Sequence[str], name: str,
                rows_per_bucket: int = 5_000, most_buckets: int = 20_000) -> DataFrame:
    """Number the rows of each group from 0 without gaps, without gathering a group in one task.

    Rows are dealt to hash buckets (small ones, up to ``most_buckets``), numbered within ``(group, bucket)``, and shifted
    by the rows of the group's earlier buckets. ``groups`` must not hold nulls. ``rows`` should be a
    stored table: it is counted and read twice. Rows equal in ``order`` get numbers in any order.
    """
    buckets = min(most_buckets, max(1, -(-rows.count() // rows_per_bucket)))
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    keys = [*groups, "_bucket"]
    counts = dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(*keys, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_shift"))
    within = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1
    return (dealt.withColumn("_within", within).join(shifts, keys)
            .withColumn(name, (F.col("_shift") + F.col("_within")).cast("long"))
            .drop("_bucket", "_within", "_shift"))
