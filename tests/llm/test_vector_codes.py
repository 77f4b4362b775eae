"""Vector codes against plain Python and SQL."""

import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from pagesearch.llm import vector_codes as V
from pagesearch.llm.prefix_trie import nearest


def plain(rows):
    """(vec_id, code, error, label_error, digest) of (vec_id, vector, label), by the definition."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    whole = [[math.floor(4096 * x) for x in r[1]] for r in kept]
    k = len(whole[0]) // 8
    parts = [[v[p * k:p * k + k] for p in range(8)] for v in whole]
    smallest = sorted(range(len(kept)), key=lambda i: kept[i][0])[:16]
    books = [[parts[i][p] for i in smallest] for p in range(8)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(part, entry)), e) for e, entry in enumerate(books[p]))
                 for p, part in enumerate(v)] for v in parts]

    for _ in range(6):
        found = assign()
        for p in range(8):
            for e in range(len(books[p])):
                own = [parts[i][p] for i in range(len(parts)) if found[i][p][1] == e]
                if own:
                    books[p][e] = [sum(column) // len(own) for column in zip(*own)]
    found = assign()
    errors = [sum(d for d, _ in row) for row in found]
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    return sorted((r[0], "".join(f"{e:02x}" for _, e in row), error,
                   sum(x for x, other in zip(errors, kept) if other[2] == r[2]), digest)
                  for r, row, error in zip(kept, found, errors))


def vectors(n, seed, dims=16, grid=None):
    rng = random.Random(seed)
    value = (lambda: rng.choice(grid)) if grid else (lambda: rng.uniform(-1, 1))
    rows = [(rng.randrange(10 ** 6) * 1000 + i, [value() for _ in range(dims)], rng.choice([0, 1, 2, None])) for i in range(n)]
    return rows + [(5, None, 1), (6, [0.1] * (dims - 1) + [None], 1), (7, [float("nan")] * dims, 1), (8, [float("inf")] * dims, None)]


SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.mark.parametrize("seed, n, grid", [(1, 150, None), (2, 300, [-0.5, 0.0, 0.25, 0.2501]), (3, 9, None)])
def test_codes_against_plain_python(spark, seed, n, grid):
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label)
            for i, v, label in vectors(n, seed, grid=grid)]
    table = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS code", "'y' AS position", "1 AS error", "2 AS n").repartition(3)
    got = sorted(tuple(r) for r in V.op12_vector_codes(table).collect())
    assert got == plain(rows)


def test_sql_agrees(spark):
    folder = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in V.op12_vector_codes(spark.read.parquet(f"{folder}/embeddings.parquet")).collect())
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    assert got == sorted(connection.execute(V.SQL).fetchall())


@pytest.mark.parametrize("leaves", [1, 3, 50, 10_000])
def test_trie_is_exact(leaves):
    rng = np.random.default_rng(leaves)
    for width, high in ((1, 4), (3, 3), (8, 2), (5, 1000)):
        parts = rng.integers(-high, high, (400, width))
        parts = parts[np.lexsort(parts[:, ::-1].T)]
        entries = rng.integers(-high, high, (16, width))
        entries[5] = entries[2]     # a tie: the lower index wins
        distance = np.square(parts[:, None, :] - entries[None]).sum(axis=2)
        best, least = nearest(parts, entries, leaves)
        assert (best == distance.argmin(axis=1)).all() and (least == distance.min(axis=1)).all()


def test_awkward_tables(spark):
    assert V.op12_vector_codes(spark.createDataFrame([], SCHEMA)).collect() == []
    odd = [(None, [1.0] * 8, None), (3, [2.0] * 8, 1), (3, [2.0] * 8, 1), (4, [1.0] * 9, 1), (9, [1e30] * 8, 1)]
    got = {(r.vec_id, r.code, r.error) for r in V.op12_vector_codes(spark.createDataFrame(odd, SCHEMA)).collect()}
    assert {vec_id for vec_id, _, _ in got} == {None, 3, 9} and all(error >= 0 for _, _, error in got)
    without_ids = V.op12_vector_codes(spark.createDataFrame([(None, [1.0] * 8, 1)], SCHEMA)).collect()
    assert [(r.vec_id, r.code, r.error) for r in without_ids] == [(None, None, None)]
    uneven = V.op12_vector_codes(spark.createDataFrame([(1, [0.5] * 9, 1), (2, [0.25] * 9, 1)], SCHEMA)).collect()
    assert sorted(r.code for r in uneven) == ["00" * 8, "01" * 5 + "00" * 3]
    empty = V.op12_vector_codes(spark.createDataFrame([(1, [], 1), (2, [], 1)], SCHEMA)).collect()
    assert [(r.code, r.error) for r in empty] == [("00" * 8, 0)] * 2
