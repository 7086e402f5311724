"""What the corpus operators share: bounded Arrow slices, the shared folder, gapless numbering.

Every operator takes the names of its id and text columns and projects them at once to private
names, so further columns of any name cannot clash with what it computes.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.shared import checkpointed, forgotten, shared_dir

__all__ = ["SLICE_BYTES", "checkpointed", "forgotten", "free", "map_slices", "numbered", "released", "removed", "salts_for", "scratch", "shared_dir", "slices", "written"]

#: Text bytes that a Python worker holds at once, beyond a single longer document.
SLICE_BYTES = 1 << 20


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the strings of ``column`` in each piece stay near ``limit`` bytes."""
    for batch in batches:
        total = batch.column(column).nbytes
        step = batch.num_rows if total <= limit else max(1, batch.num_rows * limit // total)
        for start in range(0, batch.num_rows, max(step, 1)):
            yield batch.slice(start, step)


def map_slices(df: DataFrame, fn: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema, column: str = "text", limit: int = SLICE_BYTES) -> DataFrame:
    """``mapInArrow`` over bounded slices; ``fn()`` runs once a task and returns the per-slice function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = fn()
        for piece in slices(batches, column, limit):
            yield each(piece)

    return df.mapInArrow(run, schema)


def free(name: str, *frames: DataFrame) -> str:
    """``name``, with as many underscores behind it as no column of the frames has."""
    used = {c.lower() for f in frames for c in f.columns}
    while name.lower() in used:
        name += "_"
    return name


def scratch(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet into the shared folder and read it again; for rows that carry texts. Also the folder, for ``removed``."""
    path = forgotten(df.sparkSession, f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    """``scratch``, which the driver's end deletes."""
    return scratch(df, name)[0]


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder of ``scratch`` that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def released(spark: SparkSession) -> None:
    """Let the driver collect its garbage, so that shuffle files and checkpoints of finished steps go now and not at some time."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Rows of a part of a group.
PART = 100_000


def salts_for(most: int, least: int = 64) -> int:
    """Parts of a group of at most ``most`` rows."""
    return max(least, -(-most // PART))


def numbered(df: DataFrame, group: list[str], order: list[str], out: str, salts: int = 64) -> DataFrame:
    """Gapless numbers from 0 within ``group``, with no task holding a whole group.

    Rows are split by a hash of ``order`` into ``salts`` parts of each group; parts are numbered
    alone and shifted by the sizes of the parts before them. Those sizes are one row a part. Give the
    greatest group's rows by PART for ``salts`` (``salts_for``); rows that are equal in ``order`` share a part.
    """
    from pyspark.sql import Window as W

    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    sizes = salted.groupBy(*group, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*group).orderBy("_salt").rowsBetween(W.unboundedPreceding, -1))
    shifts = sizes.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_salt").alias("_s"), F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(W.partitionBy(*group, "_salt").orderBy(*order)) - 1
    on = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)] + [F.col("_salt") == F.col("_s")]
    joined = salted.withColumn("_own", own).join(shifts, on)
    return joined.withColumn(out, (F.col("_own") + F.col("_before")).cast("long")).drop("_own", "_before", "_s", "_salt", *[f"_g{i}" for i in range(len(group))])
