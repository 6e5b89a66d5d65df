"""Tables between steps of a run, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local session (driver and executors are one process) gets a folder
    of its own that goes with the process; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if context.applicationId not in _own_folders:
        own = tempfile.mkdtemp(prefix="spark-tessera-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _own_folders[context.applicationId] = own
    return _own_folders[context.applicationId]


def staged_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tessera-{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, **options) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back.

    Cuts the lineage: later steps read the files, also after an executor is lost.
    """
    path = staged_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(table: DataFrame) -> None:
    """Deletes a staged table that nothing reads any more."""
    spark = table.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(table.staged_at)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
