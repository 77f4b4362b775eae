"""The write path: pages to a published index."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from pagesearch.config import SiteConfig
from pagesearch.operators import postings as P
from pagesearch.operators.hierarchy import with_hierarchy, with_score
from pagesearch.operators.rank import by_rank, ranks_of
from pagesearch.operators.refresh import stale_documents, upsert_latest
from pagesearch.operators.sections import documents_from_parts, parse_pages
from pagesearch.operators.validate import drop_root_page, keep_valid_pages
from pagesearch.session import discard, fits_broadcast, freed_shuffles, materialize
from pagesearch.sources.store import IndexStore, doc_bucket, write_by_id, write_in_place

DOCS_PER_BUCKET = 50_000
PUSHED_IDS = 1_000
CHARS_PER_TASK = 12_000_000     # of the documents of a bucket, whose postings one task sorts and writes

Parser = Callable[[DataFrame, SiteConfig], DataFrame]


@dataclass(frozen=True)
class SearchIndex:
    """The tables a search reads, and the settings they were built with."""

    documents: DataFrame
    postings: DataFrame
    terms: DataFrame
    sites: DataFrame
    config: SiteConfig
    doc_buckets: int | None = None  # buckets of the stored documents, None when not stored
    ranked: DataFrame | None = None  # (site, doc_id, url, score, rank): every site's documents by their own score
    stored_documents: Callable[[], DataFrame] | None = None  # the documents with their bucket


def parse_documents(pages: DataFrame, config: SiteConfig) -> DataFrame:
    return documents_from_parts(parse_pages(pages, config), config)


def enrich(docs: DataFrame, config: SiteConfig) -> DataFrame:
    """Validated documents with breadcrumbs and score.

    The parsed documents are written first, as titles, breadcrumbs and validation all read them.
    """
    return enriched(materialize(docs, "parsed"), config)


def enriched(parsed: DataFrame, config: SiteConfig) -> DataFrame:
    valid = drop_root_page(keep_valid_pages(parsed, config.validators))
    return with_score(with_hierarchy(valid), config)


def settle(docs: DataFrame, config: SiteConfig) -> DataFrame:
    """``enrich``, written as a table of its own that ``store_index`` may drop.

    The parsed documents and the shuffle that brought breadcrumbs to them are gone before the documents move on to their buckets.
    """
    parsed = materialize(docs, "parsed")
    settled = materialize(enriched(parsed, config), "scored")
    discard(parsed)
    return settled


def index_documents(unique: DataFrame, config: SiteConfig, partitions: int | None = None) -> SearchIndex:
    """Index tables as lazy DataFrames, for scored documents with one row per key.

    The score rides along through the tokens of its document, so no join brings it back.
    """
    rows = P.term_postings(unique, config, partitions)
    return SearchIndex(unique, rows, P.dictionary(rows), P.corpus_size(unique), config)


def own_scores(docs: DataFrame) -> DataFrame:
    """The documents of each site as the hits of a star query without a section."""
    return docs.select(F.col("site").alias("qkey"), "doc_id", "url", F.round("score", 6).alias("score"))


def buckets_for(docs: int, chars: int) -> int:
    """How many document buckets that many documents and characters get."""
    return max(1, -(-docs // DOCS_PER_BUCKET), -(-chars // CHARS_PER_TASK))


def store_index(docs: DataFrame, config: SiteConfig, store: IndexStore, buckets: int = 64,
                version: str | None = None, doc_buckets: int | None = None, settled: bool = False) -> str:
    """Write all tables of a new version; each is computed from the one written before it.

    Without a number, documents get the buckets of ``buckets_for``. ``settled`` documents are a table that goes once they are
    stored. Documents with a ``doc_bucket`` of the given number are partitioned by it already.
    """
    version = version or store.new_version()
    with freed_shuffles(store.spark):
        return _write_tables(docs, config, store, buckets, version, doc_buckets, settled)


def _write_tables(docs: DataFrame, config: SiteConfig, store: IndexStore, buckets: int, version: str, doc_buckets: int | None,
                  settled: bool) -> str:
    path = lambda table: store.table_path(version, table)
    if doc_buckets is None:
        chars = F.sum(sum((F.coalesce(F.length(name), F.lit(0)) for name in config.field_weights), F.lit(0)).cast("long"))
        held = docs.agg(F.count(F.lit(1)).alias("docs"), chars.alias("chars")).first()
        doc_buckets = buckets_for(held.docs, held.chars or 0)
    moved = docs
    if "doc_bucket" not in docs.columns:
        # the copies of a key meet in the bucket where the last of them is stored, so the documents move once
        moved = docs.withColumn("doc_bucket", doc_bucket(F.col("site"), F.col("doc_id"), doc_buckets)).repartition(doc_buckets, "doc_bucket")
    write_by_id(upsert_latest(moved, ["page_id"], "doc_bucket", "doc_key"), path("documents"))
    if settled:
        discard(docs)
    if store.is_empty(version):
        return version
    stored = store.read("documents", version)
    P.corpus_size(stored).write.mode("overwrite").parquet(path("sites"))
    sites = [row.site for row in store.read("sites", version).select("site").take(2)]
    only = sites[0] if len(sites) == 1 else None    # None also when documents have no site
    # a stored key names its site and id, so their copies have met already
    write_in_place(P.stored_postings(stored, config, with_site=only is None), path("postings"), only)
    P.dictionary(store.read("postings", version)).write.mode("overwrite").option("compression", "zstd").parquet(path("terms"))
    split = by_rank(own_scores(stored))
    ranks_of(split).withColumnRenamed("qkey", "site").hint("rebalance", "site").sortWithinPartitions("site", "rank") \
        .write.mode("overwrite").option("compression", "zstd").parquet(path("ranked"))
    discard(split)
    layout = (buckets, doc_buckets, list(config.field_weights), [float(w) for w in config.field_weights.values()])
    store.spark.createDataFrame([layout], "buckets int, doc_buckets int, fields array<string>, weights array<double>") \
        .write.mode("overwrite").parquet(path("layout"))
    return version


def open_index(store: IndexStore, config: SiteConfig, version: str | None = None) -> SearchIndex:
    """The published index, or one version of it; its fields and number of document buckets are stored with it."""
    version = version or store.current()
    read = lambda table: store.read(table, version)
    layout = read("layout").first()
    postings = P.read_postings(read("postings"), layout.fields, layout.weights)
    return SearchIndex(read("documents").drop("doc_bucket"), postings, read("terms"), read("sites"), config,
                       layout.doc_buckets, read("ranked"), lambda: read("documents"))


def documents_of(wanted: DataFrame, index: SearchIndex, *columns: str) -> DataFrame:
    """``wanted(site, doc_id, ...)`` with columns of their documents.

    Ids that fit a broadcast name the document buckets to read, and up to ``PUSHED_IDS`` of them are pushed to the
    scan, whose files are sorted by id. More ids are joined, and the documents are read as a whole.
    """
    small = fits_broadcast(wanted)
    docs = index.documents
    if small and index.stored_documents is not None:
        docs = index.stored_documents()
        ids = wanted.select("doc_id").distinct().take(PUSHED_IDS + 1)
        buckets = wanted.select(doc_bucket(F.col("site"), F.col("doc_id"), index.doc_buckets)).distinct().collect()
        docs = docs.filter(F.col("doc_bucket").isin([row[0] for row in buckets]))
        if len(ids) <= PUSHED_IDS:
            docs = docs.filter(F.col("doc_id").isin([row.doc_id for row in ids]))
    found = docs.select("site", "doc_id", *columns)
    return found.join(F.broadcast(wanted) if small else wanted, ["site", "doc_id"])


def reindex(pages: DataFrame, config: SiteConfig, store: IndexStore, parser: Parser = parse_documents,
            buckets: int = 64) -> DataFrame | None:
    """Build, publish and clean up one alias; returns the ids that became stale, None if nothing was found."""
    return publish(store, store_index(settle(parser(pages, config), config), config, store, buckets, settled=True))


def publish(store: IndexStore, version: str) -> DataFrame | None:
    """Move the alias to a version and drop the older ones; the ids that became stale are written before these go."""
    before = store.read("documents") if store.current() else None
    if not store.publish_unless_empty(version):
        return None
    seen = store.read("documents", version)
    stale = seen.select("doc_id").limit(0) if before is None else materialize(stale_documents(before, seen), "stale")
    store.drop_old_versions()
    return stale
