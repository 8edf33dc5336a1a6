"""Session settings that the engine's plans count on, and tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}
#: Shuffle files of an execution go as it ends, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_folders: dict[str, str] = {}


def build(master: str = "local[*]", partitions: int | None = None, **extra: str) -> SparkSession:
    """A session for tests and benchmarks; on a cluster pass the session that is there instead."""
    builder = SparkSession.builder.master(master).config(map=SETTINGS | extra).config("spark.ui.enabled", "false")
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", partitions)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys into as many partitions as shuffles have.

    A given number is not made smaller by the size of the shuffled files, which tells little of a task's memory.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for a while; one that this Spark does not let change stays as it is."""
    old = spark.conf.get(key, None)
    try:
        spark.conf.set(key, value)
    except AnalysisException:
        yield
        return
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, old)


def _hadoop_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    out = jvm.org.apache.hadoop.fs.Path(path)
    return out, out.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _own_folder(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``; it is deleted as the driver ends.

    Where the setting is missing a local master gets a temporary folder; on a cluster that is an error, as executors would
    each write to a disk of their own.
    """
    context = spark.sparkContext
    if context.applicationId not in _folders:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not (context.master == "local" or context.master.startswith("local[")):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="shared-")
        out = f"{base.rstrip('/')}/lumentrace-{uuid.uuid4().hex}"
        path, files = _hadoop_path(spark, out)
        files.mkdirs(path)
        files.deleteOnExit(path)
        _folders[context.applicationId] = out
    return _folders[context.applicationId]


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in a folder that driver and executors share; what is left there goes as the driver ends."""
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of the shared folder: computed once, with no lineage to repeat."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    with setting(spark, CLEANUP, "true"):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder and all in it; one that is not there is left at that."""
    at, files = _hadoop_path(spark, path)
    files.delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete the files behind tables of ``written`` that no later step reads; other frames have none of their own."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            remove(df.sparkSession, folder)
