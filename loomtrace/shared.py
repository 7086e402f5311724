"""The folder that driver and executors share, and cutting lineage through it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, else the context's checkpoint folder; on a local master, else one made for this session.

    A folder of this machine's would lose data on a cluster, so there one has to be named.
    """
    context = spark.sparkContext
    if named := context.getConf().get("spark.checkpoint.dir", None):
        return named
    held = context._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        master = context.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="loomtrace-"))
        held = context._jsc.sc().getCheckpointDir()
    return held.get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder; for narrow rows, as they are written uncompressed."""
    spark = df.sparkSession
    named = shared_dir(spark)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(named)
    return df.checkpoint(eager=True)


def forgotten(spark: SparkSession, path: str) -> str:
    """The path, of which the driver deletes what was written when it ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again. The driver's end deletes it."""
    spark = df.sparkSession
    path = forgotten(spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
