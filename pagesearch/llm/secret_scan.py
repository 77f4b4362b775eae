"""Secrets: fixed patterns, and values in the context of a credential that would take many guesses.

A value that stands behind a name such as ``password`` or ``private key`` is a secret when guess_cost says that
no cheap combination of words, dates, repeats, keyboard walks and brute force makes it. The words and their
costs are counted in the corpus itself, over all texts, without what the values hold.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import log2

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesearch.llm.common import spans_of, texts
from pagesearch.llm.guess_cost import LONGEST_WORD, SHORTEST_WORD, guess_bits, word_pieces
from pagesearch.operators.skew import lookup_join
from pagesearch.session import fits_broadcast, materialize

KINDS = ["assign", "access", "hex", "value"]
_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
_ACCESS = r"AKIA[A-Z0-9]{16,}"      # of a run that starts with AKIA only its first start can be long enough
_HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"

# Names that a credential stands behind, as patterns in lower case
CREDENTIAL_NAMES = (
    "password", "passwd", "passphrase", "passcode", "pwd", "pass", "secret", "token", "credentials?",
    "(?:api|access|secret|private|encryption|signing|account|auth)[_ -]?key", "bearer", "auth(?:orization)?",
    "connection[_ -]?string",
)
LEAST_BITS = 40.0


def context_pattern(names: Sequence[str]) -> str:
    """A name, a separator, and in one of three groups the value: quoted by one sign or the other, or bare."""
    named = "|".join(names)
    return (rf"""(?i)(?<![a-z0-9])(?:{named})["']?(?:\x20*(?:=>|:=|[:=])\x20*|\x20is\x20)(?:bearer\x20|basic\x20)?"""
            r"""(?:"([^"\r\n]+)"|'([^'\r\n]+)'|([^\s"',;<>()]+))""")


def base_spans(text: Column) -> Column:
    """The spans of the fixed patterns in a text that is not null."""
    assign = F.filter(spans_of(text, _ASSIGN, 0, text.rlike(_ASSIGN)),
                      lambda x: F.length(F.regexp_extract(x["value"], _ASSIGN, 1)) >= 6)
    access = spans_of(text, _ACCESS, 1, text.contains("AKIA"))
    return F.concat(assign, access, spans_of(text, _HEX, 2, text.rlike(_HEX)))


def credential_values(text: Column, names: Sequence[str] = CREDENTIAL_NAMES) -> Column:
    """``array<struct<start, end, value>>``: what stands behind the names."""
    pattern = context_pattern(names)

    def inner(x: Column) -> Column:
        quoted = F.concat(F.regexp_extract(x["value"], pattern, 1), F.regexp_extract(x["value"], pattern, 2))
        value = F.when(quoted != "", quoted).otherwise(F.regexp_extract(x["value"], pattern, 3))
        end = x["end"] - F.when(quoted != "", 1).otherwise(0)
        return F.struct((end - F.length(value)).alias("start"), end.alias("end"), value.alias("value"))

    return F.transform(spans_of(text, pattern, 3, text.rlike(pattern)), inner)


def _words(text: Column) -> Column:
    """The words of a text that a guess may use: whole runs of ASCII letters, in lower case."""
    return F.transform(F.regexp_extract_all(text, F.lit(rf"(?<![A-Za-z])[A-Za-z]{{{SHORTEST_WORD},{LONGEST_WORD}}}(?![A-Za-z])"), F.lit(0)), F.lower)


def guess_costs(values: DataFrame, docs: DataFrame) -> DataFrame:
    """``value, bits`` of the distinct values of ``values(value)``, a stored table with a row per occurrence in ``docs``."""
    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for value in batch["value"]:
                found = sorted(word_pieces(value))
                if found:
                    yield pd.DataFrame({"value": value, "piece": found})

    def cost(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bits = [guess_bits(value, {} if words is None else dict(zip(words, costs, strict=True)))
                    for value, words, costs in zip(batch["value"], batch["words"], batch["costs"], strict=True)]
            yield pd.DataFrame({"value": batch["value"], "bits": bits})

    distinct = values.select("value").distinct()
    asked = materialize(distinct.mapInPandas(pieces, "value string, piece string"), "secret-pieces")
    wanted = asked.select("piece").distinct()
    written = texts(docs).select(F.explode(_words(F.col("text"))).alias("piece"))
    if fits_broadcast(wanted):
        # all other words are one group: few rows are shuffled
        written = written.join(F.broadcast(wanted.withColumn("asked", F.lit(True))), "piece", "left") \
            .select(F.when(F.col("asked"), F.col("piece")).alias("piece"))
    counted = materialize(written.groupBy("piece").agg(F.count(F.lit(1)).alias("n")), "secret-words")
    everything = counted.agg(F.sum("n").alias("n")).first().n
    own = values.select(F.explode(_words(F.col("value"))).alias("piece")).groupBy("piece").agg(F.count(F.lit(1)).alias("own"))
    left = F.col("n") - F.coalesce("own", F.lit(0))
    known = materialize(counted.join(wanted, "piece").join(own, "piece", "left").where(left > 0)
                        .select("piece", (F.lit(log2(everything or 1)) - F.log2(left)).alias("bits")), "secret-word-costs")
    lexicon = lookup_join(asked, known, ["piece"], ["value"]).groupBy("value").agg(
        F.collect_list(F.struct("piece", "bits")).alias("words"))
    return (distinct.join(lexicon, "value", "left").select(
        "value", F.transform("words", lambda w: w["piece"]).alias("words"), F.transform("words", lambda w: w["bits"]).alias("costs"))
        .mapInPandas(cost, "value string, bits double"))


def find_secrets(docs: DataFrame, least_bits: float = LEAST_BITS, names: Sequence[str] = CREDENTIAL_NAMES) -> DataFrame:
    """``doc_id, base, more`` of every row of ``docs(doc_id, text)``.

    ``base`` and ``more`` are arrays of ``start, kind, end``: spans of the fixed patterns, and credential values of
    at least ``least_bits``, with ``bits`` in ``more``. A null text counts as empty and has none; repeated rows each get their
    spans; an empty table gives no rows; other columns are ignored. Values may be of any length.
    """
    named = texts(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = materialize(named.select(
        F.monotonically_increasing_id().alias("row_id"), "doc_id",
        F.array_sort(F.transform(base_spans(F.col("text")), lambda x: F.struct(x["start"], x["kind"], x["end"]))).alias("base"),
        credential_values(F.col("text"), names).alias("values")), "secrets-found")
    placed = materialize(found.where(F.size("values") > 0).select("row_id", F.inline("values")), "secret-values")
    nothing = F.array().cast("array<struct<start:int,kind:int,end:int,bits:double>>")
    if not placed.head(1):
        return found.select("doc_id", "base", nothing.alias("more"))
    strong = materialize(guess_costs(placed, docs).where(F.col("bits") >= least_bits), "secret-costs")
    more = lookup_join(placed, strong, ["value"], ["row_id"]).groupBy("row_id").agg(F.array_sort(F.collect_list(
        F.struct("start", F.lit(KINDS.index("value")).alias("kind"), "end", "bits"))).alias("more"))
    return lookup_join(found.drop("values"), more, ["row_id"], ["row_id"], "left").select(
        "doc_id", "base", F.coalesce("more", nothing).alias("more"))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(kind) for kind in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def op11_secret_scan(docs: DataFrame) -> DataFrame:
    """``n_value`` and ``most_bits`` tell the values that the method found and the cost of the best of them."""
    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    plain = F.transform("more", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    return find_secrets(docs).select(
        "doc_id", *[count(k) for k in range(3)], F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _written(F.array_sort(F.concat("base", plain))).alias("spans"), F.size("more").cast("long").alias("n_value"),
        F.array_max(F.transform("more", lambda x: x["bits"])).alias("most_bits"))
