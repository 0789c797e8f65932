"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_FOLDERS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Where it is unset, a session that runs in one process gets a folder of its own; every other master must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="bytelake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _session_dir(spark: SparkSession) -> str:
    """A folder of this application in the shared one. Whatever is left in it goes when the application ends."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        _FOLDERS[app] = f"{shared_dir(spark)}/bytelake-{app}-{uuid.uuid4().hex[:8]}"
        where = spark._jvm.org.apache.hadoop.fs.Path(_FOLDERS[app])
        system = where.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(where)
        system.deleteOnExit(where)
    return _FOLDERS[app]


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table: lineage ends there, and nothing is computed twice. The table is deleted when the application ends, if discard() does not do so before."""
    path = f"{_session_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of written() that nothing will read again. Frames that were derived from them and not yet computed can no longer be."""
    for df in tables:
        spark, path = df.sparkSession, df._written_at
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
