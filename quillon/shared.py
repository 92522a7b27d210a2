"""Tables that cut a lineage: written to the folder that driver and executors share, and read back."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Unset, a local one where all runs in one process; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quillon-")
        spark.conf.set("spark.checkpoint.dir", found) if spark.conf.isModifiable("spark.checkpoint.dir") else spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Paths of this process below shared folders, still there.
_MADE: dict[str, SparkSession] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/quillon/{name}-{uuid.uuid4().hex}"
    _MADE[path] = spark
    return path


def forget(*paths: str) -> None:
    """Delete intermediate tables; none given: all that this process has made. Results that still read them become unreadable."""
    for path in paths or list(_MADE):
        spark = _MADE.pop(path, None)
        if spark is not None and spark.sparkContext._jsc is not None:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _leave() -> None:
    with contextlib.suppress(Exception):  # the session may be gone by now
        forget()


def table(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of ``df``: write it as Parquet to the shared folder and read it back. The table stays until ``forget`` or the end of the process."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
