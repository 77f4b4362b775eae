"""A training corpus from raw documents: rules, near copies, personal data, mixing, packing.

Each stage takes the documents that the stage before it kept, as a table, and returns documents again; the
last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagesearch.llm import jaccard, mixing, packing, pii, quality
from pagesearch.session import materialize

NEAR_COPY_WORDS, NEAR_COPY_PERCENT = 5, 80     # op9's own query keeps shingles of 3 words and 90 %


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what passes the current policy, decided in the row: nothing is joined or shuffled."""
    return quality.kept_documents(docs)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of linked documents."""
    return jaccard.one_of_each(docs, NEAR_COPY_PERCENT, NEAR_COPY_WORDS)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind."""
    return pii.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take documents as often as the targets of their sources ask for."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenise and pack into sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_copies_stage),
    ("personal data", personal_data_stage),
    ("source mixing", mixing_stage),
    ("best-fit packing", packing_stage),
]

# iterated components, seeded orders and tokenizer ids: tested against plain Python in tests/llm instead
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{number}")
    return docs
