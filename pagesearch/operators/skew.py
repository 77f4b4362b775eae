"""Joins whose big side may hold a third of its rows under one key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, functions as F

from pagesearch.session import fits_broadcast

SALTS = 16
MOST_HASHES = 2_000_000     # ids that are broadcast as hashes


def salted_join(big: DataFrame, small: DataFrame, keys: Sequence[str], spread_by: Sequence[str],
                how: str = "inner", salts: int = SALTS) -> DataFrame:
    """Equi join that spreads each key of ``big`` over ``salts`` tasks and repeats ``small`` as often."""
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def lookup_join(big: DataFrame, small: DataFrame, keys: Sequence[str], spread_by: Sequence[str],
                how: str = "inner", fits: bool | None = None) -> DataFrame:
    """Broadcast ``small`` when its size allows, otherwise join salted.

    ``fits`` is the outcome of an earlier size check; without one the rows are counted here.
    """
    if fits_broadcast(small) if fits is None else fits:
        return big.join(F.broadcast(small), list(keys), how)
    return salted_join(big, small, keys, spread_by, how)


def by_ids(rows: DataFrame, ids: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Semi or anti join with ids; rows stay where they lie as long as the ids, or 128 bits of hash for each, fit a broadcast.

    ``ids`` may have a column ``_until``: then only rows of a smaller ``_seq`` match.
    """
    until = [c for c in ("_until",) if c in ids.columns]
    ids = ids.select(*keys, *until).dropna(subset=list(keys))
    earlier = (lambda left, right: [left["_seq"] < right["_until"]]) if until else (lambda left, right: [])

    def joined(left: DataFrame, right: DataFrame, on: Sequence[str], few: bool) -> DataFrame:
        matched = reduce(and_, [left[c] == right[c] for c in on] + earlier(left, right))
        return left.join(F.broadcast(right) if few else right, matched, how)

    if fits_broadcast(ids):
        return joined(rows, ids, keys, True)
    hashes = {"_h1": F.xxhash64(*keys), "_h2": F.xxhash64(*reversed(keys), F.lit("#"))}
    short = ids.select(*[h.alias(name) for name, h in hashes.items()], *until).distinct()
    if fits_broadcast(short, max_rows=MOST_HASHES):
        return joined(rows.withColumns(hashes), short, list(hashes), True).drop(*hashes)
    return joined(rows, ids, keys, False)
