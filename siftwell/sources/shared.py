"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_unset_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Where that is unset, a
    temporary folder of this process if all tasks run in it, as in tests, else
    an error: executors elsewhere would write to disks of their own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _unset_dir:
        _unset_dir.append("file://" + tempfile.mkdtemp(prefix="siftwell-"))
    return _unset_dir[0]


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and
    survives the loss of any executor."""
    path = f"{shared_dir(df.sparkSession)}/siftwell/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear_written(spark: SparkSession) -> None:
    """Delete all written() tables; call it once their results are stored."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/siftwell")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
