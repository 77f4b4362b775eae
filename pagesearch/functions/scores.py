"""Document scores: each scorer takes the score so far and the document's columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from pagesearch.config import SCORE_FLOOR, Scorer


def _floored(score: Column) -> Column:
    return F.greatest(score, F.lit(SCORE_FLOOR))


def boost_pages(score: Column, doc_type: Column, hierarchy: Column) -> Column:
    return _floored(F.when(doc_type != "page", score - F.lit(0.25)).otherwise(score))


def boost_top_level_pages(score: Column, doc_type: Column, hierarchy: Column) -> Column:
    depth = F.greatest(F.size(hierarchy), F.lit(1))
    return _floored(score - F.log10(depth) / 2)


def document_score(scorers: Sequence[Scorer], doc_type: Column, hierarchy: Column) -> Column:
    score = F.lit(1.0)
    for scorer in scorers:
        score = scorer(score, doc_type, hierarchy)
    return score
