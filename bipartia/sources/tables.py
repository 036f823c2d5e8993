"""Reading test tables and cutting lineage with tables in the shared folder."""

from __future__ import annotations

import atexit
import gc
import logging
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

log = logging.getLogger(__name__)

# Data sides up to this many bytes may be broadcast; above it, operators shuffle instead.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def state_of(spark: SparkSession, folder: str) -> tuple:
    """Names, times and sizes of what lies in a folder, by which a changed table is told from the one read before."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(sorted((f.getPath().getName(), f.getModificationTime(), f.getLen()) for f in files))


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session. Only where none is set (tests) is a temporary one made."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame, *range_by: str, folders: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the result has no lineage and survives lost executors.

    With ``range_by``, rows are range-partitioned and sorted by these columns first, so that the order of
    (file name, row in file) is their order. With ``folders``, a column, rows of each of its values lie apart, so that
    a filter on it reads no others; nothing is shuffled for that.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/bipartia-{uuid.uuid4().hex}"
    if range_by:
        df = df.repartitionByRange(*range_by).sortWithinPartitions(*range_by)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(folders) if folders else writer).parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove tables made by ``cut`` that no plan reads any more, such as those of an earlier round."""
    for df in tables:
        _remove(df.sparkSession, df._cut_path)


def collect_garbage(spark: SparkSession) -> None:
    """Let go of shuffle files that no plan refers to any more: they stay until the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception as e:  # the session may be gone when the program ends
        log.debug("%s stays: %s", path, e)
