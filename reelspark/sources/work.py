"""Work tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where that is unset and driver and executors are one process (tests), a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="reelspark-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def work_dir(spark: SparkSession, label: str) -> str:
    """A new folder name in the shared folder; it is deleted when the application ends."""
    root = f"{shared_dir(spark).rstrip('/')}/reelspark-{spark.sparkContext.applicationId}"
    _delete_at_exit(spark, root)
    return f"{root}/{label}-{uuid.uuid4().hex}"


_leaving: set[str] = set()


def _delete_at_exit(spark: SparkSession, root: str) -> None:
    if root in _leaving:
        return
    _leaving.add(root)

    def drop() -> None:
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the JVM has ended first: the folder stays for the cluster's own cleaning
            pass

    atexit.register(drop)


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and outlives lost executors."""
    path = work_dir(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._work_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that written() made, once all that reads them has been written itself."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._work_path)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
