"""Pack tokenised documents into as few sequences as possible.

Lengths are whole numbers up to the capacity, so a histogram of bounded size says all that a packing
needs. The driver plans on it (bins); every piece then finds its place by its length and its rank among
the pieces of that length, which Spark counts without gathering a length in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesearch.llm.bins import plan
from pagesearch.llm.common import number_rows, texts
from pagesearch.llm.tokens import text_ids
from pagesearch.session import materialize

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """The pieces of each document's ids, closed by id 0: cut every ``capacity`` tokens."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in range(0, len(batch), 500):
                rows = []
                some = batch.iloc[part:part + 500]
                for doc_id, text in zip(some["doc_id"], some["text"], strict=True):
                    ids = memoryview(text_ids(text, tokenizer) + bytes(4))
                    for start in range(0, len(ids), 4 * capacity):
                        piece = ids[start:start + 4 * capacity]
                        rows.append((doc_id, start // (4 * capacity), start // 4, len(piece) // 4, zlib.crc32(piece)))
                yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return texts(docs).mapInPandas(cut, _SCHEMA)


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """Every piece of ``docs(doc_id, text)`` with its ``sequence_id`` and ``offset`` there.

    A null or empty text is one piece, the closing id alone. Repeated rows are packed each; equal pieces
    may trade places. No rows give no rows; other columns are ignored.
    """
    cut = materialize(pieces(docs, capacity, tokenizer), "pieces")
    histogram = {r.length: r.n for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    # length << 40 | first rank, sorted, with the sequence and place of that rank: as large as the plan, not the data
    keys, first_sequence, offsets, sequence = [], [], [], 0
    for run in plan(histogram, capacity):
        for length, rank, offset in run.items:
            keys.append(length << 40 | rank)
            first_sequence.append(sequence)
            offsets.append(offset)
        sequence += run.count
    order = np.argsort(np.array(keys, dtype=np.int64))
    keys = np.array(keys, dtype=np.int64)[order]
    first_sequence, offsets = (np.array(x, dtype=np.int64)[order] for x in (first_sequence, offsets))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            key = (batch["length"].to_numpy(np.int64) << 40) | batch["_rank"].to_numpy(np.int64)
            at = np.searchsorted(keys, key, side="right") - 1
            out = batch.drop(columns="_rank").astype({"doc_id": "Int64"})
            out["sequence_id"] = first_sequence[at] + (key - keys[at])
            out["offset"] = offsets[at]
            yield out

    ranked = number_rows(cut, ["length"], ["doc_id", "piece", "ids_crc32"], "_rank")
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "_rank").mapInPandas(
        place, _SCHEMA + ", sequence_id long, offset long")
