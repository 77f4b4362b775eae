import re

import corpus_pipeline
import pyarrow.parquet as pq
from llm.fixtures import CLASHING, awkward, awkward_rows
from llm.test_jaccard import brute, near_copies
from llm.test_pii import brute as pii_spans
from pagesearch.llm import quality
from pagesearch.session import materialize

FOLDER = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    given = [(r.doc_id, r.text) for r in docs.collect()]
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], FOLDER), "test-stage"))
    assert all(step.columns == docs.columns for step in out[:-1])
    clean, single, private, mixed, packed = ([r.asDict() for r in step.collect()] for step in out[1:])
    passed = {r.doc_id for r in quality.op2_quality_rules(docs).collect() if r.kept}
    assert {r["doc_id"] for r in clean} == passed and len(clean) == len(passed)
    quality_labels = dict(zip(*[pq.read_table(f"{FOLDER}/labels.parquet")[c].to_pylist() for c in ("doc_id", "quality")]))
    long_enough = {d for d, t in given if len(re.findall("[^\x20\x09-\x0d]+", t)) >= 20 and quality_labels.get(d) == 1}
    assert len(long_enough - passed) <= 0.02 * len(long_enough)
    want = {c if n else d for d, n, c in brute([(r["doc_id"], r["text"]) for r in clean], 80, 5)}
    assert {r["doc_id"] for r in single} == want and len(single) == len(want)
    assert [r["doc_id"] for r in single if pii_spans(r["text"])] and not any(pii_spans(r["text"]) for r in private)
    originals = {r["doc_id"]: r["text"] for r in private}
    assert mixed and all(originals[r["doc_id"]].startswith(r["text"]) for r in mixed)
    assert sum(r["length"] for r in packed) >= len(mixed) and {r["doc_id"] for r in packed} == {r["doc_id"] for r in mixed}


def test_stages_take_awkward_and_empty_tables(spark):
    docs = awkward(spark, awkward_rows() + [(1000 + d, *rest) for d, *rest in near_copies(6, 3, 5)])
    for table in (docs, docs.limit(0)):
        for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, table, FOLDER)
            assert number == 4 or out.columns == ["doc_id", "text", "lang", "source", "n_chars", *CLASHING]
            assert (out.count() == 0) == (table is not docs)


def test_near_copies_with_scattered_edits_go(spark):
    words = [f"word{i}" for i in range(200)]
    edited = [f"edit{i}" if i in (30, 80, 130, 180) else w for i, w in enumerate(words)]     # 176 of 216 shingles of 5 words
    apart = [f"edit{i}" if i % 40 == 20 else w for i, w in enumerate(words)]                 # 171 of 221
    rows = [(i + 1, " ".join(t), "en", "s", 0) for i, t in enumerate((words, edited, apart))]
    assert sorted(c for _, _, c in brute(rows)) == [1, 2, 3]
    kept = corpus_pipeline.near_copies_stage(spark, awkward(spark, rows), FOLDER)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]
