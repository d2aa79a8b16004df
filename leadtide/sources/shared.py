"""Tables that several steps of a query read, written once to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders of sessions on one machine that name none, by application.
_own: dict[str, str] = {}


def shared_top(spark: SparkSession) -> str:
    """The folder that driver and executors share, with its scheme.

    It is the session's ``spark.checkpoint.dir``, else the context's checkpoint folder. Only a session on
    one machine may have neither: a temporary folder serves it. On a cluster that is an error, as each
    machine would write to its own disk.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        top = _own[app]
    # A path without a scheme belongs to Spark's default file system, on executors too.
    at = spark._jvm.org.apache.hadoop.fs.Path(top)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/")


def _folder(spark: SparkSession) -> str:
    return f"{shared_top(spark)}/leadtide-tables-{spark.sparkContext.applicationId}"


def written(df: DataFrame) -> DataFrame:
    """The frame as a Parquet table in the shared folder: readers prune its columns and push filters
    into it, and a lost executor doesn't repeat what made it. The tables of an application stay until
    clear()."""
    path = f"{_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete the table that ``written`` returned, when nothing reads it any more."""
    files = df.inputFiles()
    if files:
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clear(spark: SparkSession) -> None:
    """Delete the tables of this application, when no frame that reads them is needed any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(_folder(spark))
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
