"""Tables written to the shared folder, for what several branches of a plan read."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Paths written by stored() that are still there, oldest first.
_WRITTEN: list[str] = []
#: Folders of applications for which spark.checkpoint.dir is unset; a running session does not let it be set.
_OWN: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, one of the warehouse, or in local mode a temporary one that goes at exit."""
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root.rstrip("/")
    app = spark.sparkContext.applicationId
    if app in _OWN:
        return _OWN[app]
    if spark.sparkContext.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="scratch-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _OWN[app] = f"file://{folder}"
    else:
        _OWN[app] = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return _OWN[app]


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet and read back: it is computed once, its readers prune columns, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete all tables that stored() wrote: to be called when the results that read them have been read or written."""
    while _WRITTEN:
        where = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN[-1])
        where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)
        _WRITTEN.pop()
