"""Vector code compression: every vector as one codebook index per part, fitted on all distinct parts.

A vector is cut into PARTS equal parts. Equal parts of one position are counted once: they are sorted, written
in blocks, and every round walks a block as a trie of prefixes (prefix_trie), which shares the distances of
common prefixes, takes the nearest entry at each leaf and adds up the leaves with their counts. Only the
codebooks (PARTS * ENTRIES short vectors) come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagesearch.llm.prefix_trie import nearest
from pagesearch.operators.skew import lookup_join
from pagesearch.session import materialize

PARTS, ENTRIES, ROUNDS = 8, 16, 6
SCALE = 4096
LARGEST = 1 << 27       # components are kept within this, so that squared distances fit 64 bits


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, vector, label`` of the rows whose vector has only finite components."""
    wide = vectors.select(F.col("vec_id").cast("long").alias("vec_id"),
                          F.col("embedding").cast("array<double>").alias("vector"), "label")
    finite = F.forall("vector", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    kept = wide.where(F.col("vector").isNotNull() & finite)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), F.size("vector")).select(F.size("vector").alias("n")).head()
    return kept.where(F.size("vector") == (first.n if first else 0))


def whole_numbers(values: np.ndarray, rows: int) -> np.ndarray:
    """``rows`` vectors of integers, a third axis for the parts; zeros fill a last part that would be shorter."""
    whole = np.clip(np.floor(values.reshape(rows, -1) * SCALE), -LARGEST, LARGEST).astype(np.int64)
    return np.pad(whole, ((0, 0), (0, -whole.shape[1] % PARTS))).reshape(rows, PARTS, -1)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return whole_numbers(batch.column("vector").flatten().to_numpy(zero_copy_only=False), batch.num_rows)


def distinct_parts(kept: DataFrame) -> DataFrame:
    """Blocks ``position, parts, counts``: sorted distinct parts as a matrix of 32-bit integers, and their numbers of rows.

    Copies are counted before they are shuffled, and the distinct parts are dealt by range, so that a
    position's common prefixes meet in few blocks and no value is a hot key.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                # big-endian with the sign bit turned over: bytes sort as the numbers do
                shifted = (_matrix(batch) + (1 << 31)).astype(">u4")
                width = shifted.shape[2] * 4
                held = shifted.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(np.arange(PARTS, dtype=np.int32), batch.num_rows)),
                     pa.array([held[i * width:(i + 1) * width] for i in range(batch.num_rows * PARTS)], pa.binary())],
                    ["position", "part"])

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for position, rows in batch.groupby("position"):
                parts = np.frombuffer(b"".join(rows["part"]), dtype=">u4").astype(np.int64) - (1 << 31)
                yield pd.DataFrame({"position": [position], "parts": [parts.astype(np.int32).tobytes()],
                                    "counts": [rows["n"].to_numpy(np.int64).tobytes()]})

    counted = (kept.select("vector").mapInArrow(cut, "position int, part binary")
               .groupBy("position", "part").agg(F.count(F.lit(1)).alias("n")))
    return (counted.repartitionByRange("position", "part").sortWithinPartitions("position", "part")
            .mapInPandas(pack, "position int, parts binary, counts binary"))


def next_codebooks(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: all parts go to their nearest entries, and each used entry becomes the floor of its parts' mean."""
    width = books.shape[2]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        used = np.zeros(books.shape[:2], dtype=np.int64)
        sums = np.zeros(books.shape, dtype=np.int64)
        for batch in batches:
            for position, held, numbers in zip(batch["position"], batch["parts"], batch["counts"], strict=True):
                counts = np.frombuffer(numbers, dtype=np.int64)
                parts = np.frombuffer(held, dtype=np.int32).astype(np.int64).reshape(len(counts), width)
                best, _ = nearest(parts, books[position])
                order = np.argsort(best, kind="stable")
                entries, starts = np.unique(best[order], return_index=True)
                used[position, entries] += np.add.reduceat(counts[order], starts)
                sums[position, entries] += np.add.reduceat((parts * counts[:, None])[order], starts, axis=0)
        position, entry = np.nonzero(used)
        if len(position):
            yield pd.DataFrame({"position": position, "entry": entry, "n": used[position, entry],
                                "sums": list(sums[position, entry])})

    found = blocks.mapInPandas(walk, "position int, entry int, n long, sums array<long>")
    numbers = found.select("position", "entry", F.posexplode(F.concat(F.array("n"), "sums")).alias("place", "x"))
    totals = np.zeros((*books.shape[:2], width + 1), dtype=np.int64)
    for row in numbers.groupBy("position", "entry", "place").agg(F.sum("x").alias("x")).collect():
        totals[row.position, row.entry, row.place] = row.x      # as many rows as the codebooks have numbers
    n = totals[:, :, :1]
    return np.where(n > 0, totals[:, :, 1:] // np.maximum(n, 1), books)


def first_codebooks(kept: DataFrame) -> np.ndarray:
    """The parts of the smallest ids; of an id with several vectors the smallest counts."""
    ids = [row.vec_id for row in kept.where("vec_id is not null").select("vec_id").distinct().orderBy("vec_id").limit(ENTRIES).collect()]
    rows = kept.where(F.col("vec_id").isin(ids)).groupBy("vec_id").agg(F.min("vector").alias("vector")).orderBy("vec_id").collect()
    vectors = np.array([row.vector for row in rows], dtype=np.float64)
    return whole_numbers(vectors, len(rows)).transpose(1, 0, 2) if rows else np.zeros((PARTS, 0, 0), dtype=np.int64)


def fitted_codebooks(kept: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks as ``[part, entry, place]`` after all rounds."""
    books = first_codebooks(kept)
    if books.shape[1]:
        blocks = materialize(distinct_parts(kept), "vector-parts")
        for _ in range(rounds):
            books = next_codebooks(blocks, books)
    return books


def encoded(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """``vec_id, label, code, error`` of every vector; nulls for code and error when there are no entries."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = np.array([f"{i:02x}" for i in range(books.shape[1])])
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = _matrix(batch)
            codes = np.empty((batch.num_rows, PARTS), dtype="U2")
            error = np.zeros(batch.num_rows, dtype=np.int64)
            for position in range(PARTS):
                order = np.lexsort(whole[:, position, ::-1].T) if whole.shape[2] else np.arange(len(whole))
                best, distance = nearest(whole[order, position], books[position])
                codes[order, position] = digits[best]
                error[order] += distance
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(["".join(code) for code in codes]), pa.array(error)],
                ["vec_id", "label", "code", "error"])

    schema = T.StructType([kept.schema["vec_id"], kept.schema["label"], T.StructField("code", T.StringType()),
                           T.StructField("error", T.LongType())])
    if not books.shape[1]:
        return kept.select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return kept.mapInArrow(encode, schema)


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress_vectors(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, label, code, error`` of the kept rows of ``vectors(vec_id, embedding, label)``, and the codebooks.

    Dropped: null vectors, vectors with a null or non-finite component, and those of another length than the
    vector of the smallest id. Lengths that PARTS does not divide are filled up with zeros; components are
    kept within LARGEST / SCALE. A null id takes no part in the first codebooks, but its vector is counted and coded;
    repeated rows count as often as they come. Fewer than ENTRIES ids give smaller codebooks, none give
    null codes; an empty table gives no rows. Other columns are ignored.
    """
    kept = kept_vectors(vectors)
    books = fitted_codebooks(kept, rounds)
    return encoded(kept, books), books


def _same(label: Column) -> list[Column]:
    return [label.isNull().alias("_none"), F.coalesce(label.cast("string"), F.lit("")).alias("_label")]


def op12_vector_codes(vectors: DataFrame) -> DataFrame:
    rows, books = compress_vectors(vectors)
    rows = materialize(rows.select("vec_id", "code", "error", *_same(F.col("label"))), "vector-codes")
    sums = rows.groupBy("_none", "_label").agg(F.sum("error").alias("label_error"))
    return lookup_join(rows, sums, ["_none", "_label"], ["vec_id", "code"]).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _round_sql(number: int) -> str:
    old = f"book{number}"
    return f"""
near{number} AS MATERIALIZED (SELECT rid, p, min_by(e, struct_pack(d := d, e := e)) AS e, min(d) AS d FROM (
  SELECT x.rid, x.p, b.e, sum((x.x - b.x) * (x.x - b.x))::BIGINT AS d FROM nums x JOIN {old} b USING (p, i) GROUP BY 1, 2, 3) GROUP BY 1, 2),
book{number + 1} AS MATERIALIZED (SELECT b.p, b.e, b.i, coalesce(m.x, b.x) AS x FROM {old} b LEFT JOIN (
  SELECT n.p, n.e, x.i, floor(sum(x.x) / count(*))::BIGINT AS x FROM near{number} n JOIN nums x USING (rid, p) GROUP BY 1, 2, 3) m USING (p, e, i)),"""


# parts count from 0, places in them from 1
SQL = f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
cells AS (SELECT rid, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS nth, len(v) // {PARTS} AS k FROM kept),
nums AS MATERIALIZED (SELECT rid, nth // k AS p, nth % k AS i, x FROM cells),
firsts AS (SELECT rid, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT {ENTRIES}),
book0 AS MATERIALIZED (SELECT p, e, i, x FROM nums JOIN firsts USING (rid)),{"".join(_round_sql(r) for r in range(ROUNDS + 1))}
coded AS (SELECT rid, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM near{ROUNDS} GROUP BY rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY p, e, i)) FROM book{ROUNDS}) AS codebooks_sha256
FROM kept JOIN coded USING (rid)
"""
