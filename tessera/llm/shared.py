"""What the operators of this subpackage share: staged tables in the shared folder, and inputs."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.staging import staged_path

#: ASCII white space; what stands between is a word.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

_here = threading.local()


def _written() -> list[str]:
    """Paths of the tables that this thread has staged and not deleted."""
    if not hasattr(_here, "paths"):
        _here.paths = []
    return _here.paths


def staged(df: DataFrame, name: str, **options) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back.

    Cuts the lineage: later steps read the files, also after an executor is lost.
    """
    path = staged_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    _written().append(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def staged_so_far() -> int:
    return len(_written())


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def forget(table: DataFrame) -> None:
    """Deletes a staged table that nothing reads any more.

    Shuffle files of jobs that are over go when the driver collects garbage, which it is told to, as it may not for long.
    """
    _delete(table.sparkSession, table.staged_at)
    _written().remove(table.staged_at)
    table.sparkSession._jvm.System.gc()


def keep_last_staged(spark: SparkSession, since: int) -> None:
    """Deletes the tables that this thread staged after the first ``since`` but for the last, when nothing reads them any more."""
    for path in _written()[since:-1]:
        _delete(spark, path)
    del _written()[since:-1]
    spark._jvm.System.gc()


def text_batches(spark: SparkSession, mb: int = 4) -> None:
    """Python workers get at most ``mb`` MB at once (one row, if that is longer): a worker holds a batch whole.

    The session's setting is lowered where it is higher, and stays so: a query reads it when it runs, which its caller decides on.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    most = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < most <= mb << 20:
        spark.conf.set(key, f"{mb}m")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pooled(rows: DataFrame, mb: int = 128) -> DataFrame:
    """``rows``, read from files, with so many splits to a task that it has some ``mb`` MB; no fewer tasks than run at once.

    For work that each task remembers, as the encoding of words: the more a task reads, the fewer are new to it. Nothing is shuffled.
    """
    spark = rows.sparkSession
    split = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    splits, most = rows.rdd.getNumPartitions(), max(1, (mb << 20) // split)
    return rows.coalesce(max(1, spark.sparkContext.defaultParallelism, -(-splits // most)))


def text_or_empty(text_col: str = "text"):
    return F.coalesce(F.col(text_col), F.lit(""))
