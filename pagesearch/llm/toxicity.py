"""Toxicity by logistic regression over hashed word n-grams and skip-grams, learnt by FTRL-proximal.

Per-coordinate learning rates suit rare words, and the L1 part keeps only weights that earn their place, so
the model that is sent to every executor is small. It is learnt from a bounded sample of the labelled rows;
every row is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesearch.llm.common import texts
from pagesearch.session import materialize

DIMENSIONS = 1 << 20
ALPHA, BETA, L1, L2 = 1.0, 1.0, 10.0, 0.1
EPOCHS = 8
MOST_LABELLED = 12_000      # labelled rows that are learnt from, in expectation; more are thinned by a hash of the id
HELD_OUT_OF = 5             # rows whose crc32(doc_id) is divisible by this are never learnt from
_P = np.uint64(0x9E3779B97F4A7C15)
_PUNCTUATION = b".,;:!?\"'()[]"


class _Hashes(dict):
    """Word to a 64-bit hash of its letters without punctuation around them; emptied when large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word.strip(_PUNCTUATION))
        return value


def features(text: str | None, hashes: _Hashes) -> np.ndarray:
    """Distinct buckets of a whole text's words, pairs of words, and pairs with one word between them."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    with np.errstate(over="ignore"):
        parts = [h * _P]
        for gap in (1, 2):
            parts.append((h[:-gap] * _P + h[gap:]) * _P + np.uint64(gap) if len(h) > gap else h[:0])
    return np.unique((np.concatenate(parts) >> np.uint64(44)).astype(np.int32))


class Ftrl:
    """FTRL-proximal on rows of distinct features with value 1, and a bias that is not regularised."""

    def __init__(self):
        self.z, self.n = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        kept = np.sign(z) * np.maximum(np.abs(z) - np.where(at == DIMENSIONS, 0, L1), 0)
        return -kept / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, np.int32(DIMENSIONS))
        w = self.weights(at)
        gradient = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        sigma = (np.sqrt(self.n[at] + gradient * gradient) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += gradient - sigma * w
        self.n[at] += gradient * gradient


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT_OF == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """Non-zero weights ``bucket, weight``; bucket DIMENSIONS is the bias. Held-out rows and null labels take no part."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id"))).distinct()
    rows = known.count()
    share = min(1.0, most / max(rows, 1))
    part = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))
    # bounded by ``most``, so the sample goes to the documents and not the other way
    sample = materialize(texts(docs).join(F.broadcast(known.where(part)), "doc_id"), "toxic-sample")

    def learn(group: pd.DataFrame) -> pd.DataFrame:
        hashes, model = _Hashes(), Ftrl()
        group = group.sort_values("order", kind="stable")
        rows = [(features(text, hashes), label) for text, label in zip(group["text"], group["toxic"], strict=True)]
        for _ in range(EPOCHS):
            for at, label in rows:
                model.learn(at, label)
        w = model.weights(np.arange(DIMENSIONS + 1))
        kept = np.flatnonzero(w)
        return pd.DataFrame({"bucket": kept, "weight": w[kept]})

    dealt = sample.select("text", "toxic", F.xxhash64(F.lit("order"), "doc_id", "text").alias("order"))
    return dealt.groupBy().applyInPandas(learn, "bucket long, weight double")


def score(docs: DataFrame, weights: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs(doc_id, text)``.

    A null or empty text has the bias alone; without any weights the score is 0.5. Repeated rows each get
    theirs; an empty table gives no rows; other columns are ignored. The weights are at most DIMENSIONS + 1
    rows, in practice the few that L1 leaves.
    """
    model = weights.toPandas()
    table = np.zeros(DIMENSIONS, dtype=np.float32)
    words = model[model["bucket"] < DIMENSIONS]
    bias = float(model.loc[model["bucket"] == DIMENSIONS, "weight"].sum())
    at, values = words["bucket"].to_numpy(np.int64), words["weight"].to_numpy(np.float32)

    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, weight = _Hashes(), table.copy()
        weight[at] = values
        for batch in batches:
            sums = np.array([bias + weight[features(text, hashes)].sum(dtype=np.float64) for text in batch["text"]])
            out = batch[["doc_id", "held_out"]].astype({"doc_id": "Int64"})
            out["score"] = 1 / (1 + np.exp(-np.clip(sums, -35, 35)))
            out["predicted"] = (out["score"] >= 0.5).astype("int32")
            yield out

    return (texts(docs).select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
            .mapInPandas(rate, "doc_id long, held_out boolean, score double, predicted int"))


def op6_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, materialize(train(docs, labels), "toxic-weights"))
