"""Versioned index tables on a shared file system: build, publish, clean up."""

from __future__ import annotations

import time
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagesearch.session import setting

POINTER = "CURRENT"
DICTIONARY_BYTES = 8 << 20     # of a column of postings, instead of 1 MB: room for the ids of a file's documents


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def children(spark: SparkSession, path: str) -> list[str]:
    fs, target = _fs(spark, path)
    if not fs.exists(target):
        return []
    return sorted(entry.getPath().getName() for entry in fs.listStatus(target))


def _delete(spark: SparkSession, path: str) -> None:
    fs, target = _fs(spark, path)
    fs.delete(target, True)


def write_in_place(rows: DataFrame, path: str, site: str | None = None) -> None:
    """Postings that their tasks have sorted by term, a file per task and site, which its term statistics prune by the page.

    A file per bucket would hold the ids of all documents of the task once more. Each file of documents is a task of its
    own, and rows go to the files of their sites without a sort. Rows that are all of one ``site``, and do not have it, go to its folder
    as they are.
    """
    spark = rows.sparkSession
    with setting(spark, spark__sql__files__openCostInBytes="1g", spark__sql__maxConcurrentOutputFileWriters="64"):
        writer = rows.write.mode("overwrite").option("parquet.dictionary.page.size", DICTIONARY_BYTES).option("compression", "zstd")
        if site is None:
            writer.partitionBy("site").parquet(path)
        else:
            folder = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString("site", site)
            writer.parquet(f"{path}/{folder}")


def write_by_id(docs: DataFrame, path: str, buckets: int | None = None) -> None:
    """Documents in hash buckets of their key, sorted inside, so that a point look-up reads few row groups.

    Without a number of buckets the documents have their ``doc_bucket`` and lie by it already.
    """
    if buckets is not None:
        bucketed = docs.withColumn("doc_bucket", doc_bucket(F.col("site"), F.col("doc_id"), buckets))
        docs = bucketed.hint("rebalance", "doc_bucket")
    docs.sortWithinPartitions("doc_bucket", "doc_id") \
        .write.mode("overwrite").option("compression", "zstd").partitionBy("doc_bucket").parquet(path)


def page_hash(site, doc_id):
    """A hash that the documents of one page share: of their site and of what precedes the kind and content hash in their ids.

    A page's text and its sections, which repeat that text, so stay together and compress as one. Equal ids share it always.
    """
    return F.xxhash64(site, F.regexp_replace(doc_id, r":(?:page|section):[0-9a-f]{32}\z", ""))


def page_bucket(site, page, buckets: int):
    """The ``doc_bucket`` of all documents whose ids start with ``page``, from before they have ids."""
    return F.pmod(F.xxhash64(site, page), F.lit(buckets)).cast("int")


def doc_bucket(site, doc_id, buckets: int):
    return F.pmod(page_hash(site, doc_id), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class IndexStore:
    """Index versions of one alias: ``<root>/<alias>/<version>/<table>`` and a pointer file."""

    spark: SparkSession
    root: str
    alias: str

    @property
    def home(self) -> str:
        return f"{self.root}/{self.alias}"

    def new_version(self) -> str:
        return f"v{time.time_ns()}"

    def table_path(self, version: str, table: str) -> str:
        return f"{self.home}/{version}/{table}"

    def versions(self) -> list[str]:
        return [name for name in children(self.spark, self.home) if name.startswith("v")]

    def current(self) -> str | None:
        if POINTER not in children(self.spark, self.home):
            return None
        fs, target = _fs(self.spark, f"{self.home}/{POINTER}")
        stream = fs.open(target)
        try:
            return stream.readLine()
        finally:
            stream.close()

    def publish(self, version: str) -> None:
        """Point the alias at a version: write a side file, then rename it over the pointer."""
        jvm = self.spark._jvm
        fs, side = _fs(self.spark, f"{self.home}/{POINTER}.{version}")
        stream = fs.create(side, True)
        stream.writeBytes(version + "\n")
        stream.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            side.toUri(), self.spark._jsc.hadoopConfiguration())
        overwrite = jvm.org.apache.hadoop.fs.Options.Rename.valueOf("OVERWRITE")
        modes = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        modes[0] = overwrite
        context.rename(side, jvm.org.apache.hadoop.fs.Path(f"{self.home}/{POINTER}"), modes)

    def is_empty(self, version: str) -> bool:
        """True when no bucket was written under the documents of a version."""
        names = children(self.spark, self.table_path(version, "documents"))
        return not any(name.startswith("doc_bucket=") for name in names)

    def publish_unless_empty(self, version: str) -> bool:
        """An empty crawl drops its version and leaves the alias where it was."""
        if self.is_empty(version):
            _delete(self.spark, f"{self.home}/{version}")
            return False
        self.publish(version)
        return True

    def drop_old_versions(self) -> list[str]:
        keep = self.current()
        old = [v for v in self.versions() if v != keep]
        for version in old:
            _delete(self.spark, f"{self.home}/{version}")
        return old

    def drop(self) -> None:
        _delete(self.spark, self.home)

    def read(self, table: str, version: str | None = None) -> DataFrame:
        version = version or self.current()
        if version is None:
            raise LookupError(f"nothing is published under {self.alias}")
        return self.spark.read.parquet(self.table_path(version, table))

    def register(self, tables: Mapping[str, str]) -> None:
        """Make temp views ``{view: table}`` of the current version."""
        for view, table in tables.items():
            self.read(table).createOrReplaceTempView(view)
