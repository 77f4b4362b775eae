"""Session defaults and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join partition even when that costs one more shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **extra: str) -> SparkSession:
    """A session for tests and the bench; on a cluster the session comes from spark-submit."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("pagesearch")
    settings = {**DEFAULTS, "spark.sql.shuffle.partitions": str(shuffle_partitions),
                "spark.driver.memory": "16g", **extra}
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_folders: dict[str, str] = {}


def work_folder(spark: SparkSession) -> str:
    """The folder shared by driver and executors, as named by ``spark.checkpoint.dir``.

    Only a local session may go without the setting: there every executor is this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_folders:
        _local_folders[app] = tempfile.mkdtemp(prefix="pagesearch-")
    return _local_folders[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{work_folder(spark)}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: survives the loss of any executor."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(f"{work_folder(spark)}/checkpoints")
    return df.checkpoint(eager=True)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of an action go when it ends, as all it made is written or collected by then.

    Otherwise they stay until the driver happens to collect its garbage, and a job of many steps holds them all.
    """
    before = spark.conf.get(FREED)
    spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        spark.conf.set(FREED, before)


@contextmanager
def setting(spark: SparkSession, **values: str) -> Iterator[None]:
    """Within, SQL settings have these values; ``__`` in a name stands for a dot."""
    names = {name.replace("__", "."): value for name, value in values.items()}
    before = {name: spark.conf.get(name) for name in names}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    For results that several later steps read: they are computed once, survive lost executors,
    keep plans short and give Spark real sizes to choose joins by.
    """
    path = fresh_path(df.sparkSession, f"tables/{label}")
    with freed_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete what ``materialize`` wrote, when nothing reads it any more."""
    files = table.inputFiles()
    if files:
        folder = files[0].rsplit("/", 1)[0]
        if "/tables/" not in folder:
            raise ValueError(f"{folder} is no intermediate table")
        spark = table.sparkSession
        target = spark._jvm.org.apache.hadoop.fs.Path(folder)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def fits_broadcast(df: DataFrame, max_rows: int = 200_000, max_bytes: int = 64_000_000) -> bool:
    """Count rows and bytes, by partial sums in every task; a side is broadcast only when both are few."""
    size = F.lit(0)
    for field in df.schema.fields:
        column, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.StringType, T.BinaryType)):
            width = F.coalesce(F.octet_length(column), F.lit(0)) + 8
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            width = F.octet_length(F.to_json(F.struct(column)))
        else:
            width = F.lit(8)
        size = size + width
    with freed_shuffles(df.sparkSession):
        held = df.agg(F.count(F.lit(1)).alias("n"), F.sum(size.cast("long")).alias("bytes")).first()
    return held.n <= max_rows and (held.bytes or 0) <= max_bytes
