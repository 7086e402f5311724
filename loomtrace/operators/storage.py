"""Trace storage: Hive partitions by subject, time bucket and batch, pruned queries, archival moves.

A batch has a name, and writing it again replaces what it wrote: a retried write or move leaves no row twice.
Partition values are strings whatever they look like, and folders are found through the files' own paths, so any
key is safe. A move copies a batch under its name before its files go; ``read_both`` takes a batch that is in both
stores from the cold one, so that a reader in the midst of a move sees each row once.
"""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtrace.functions.times import bucket

PARTITION = ["p_key", "dt", "batch"]


def segment(value: Column) -> Column:
    return F.coalesce(F.replace(F.nullif(value.cast("string"), F.lit("")), F.lit("/"), F.lit("_")), F.lit("_unknown"))


def partitioned(rows: DataFrame, time: Column, granularity: str = "day", key: str = "subject_id") -> DataFrame:
    """Adds the partition columns p_key and dt."""
    return rows.withColumn("p_key", segment(F.col(key))).withColumn("dt", bucket(time, granularity))


class TraceStore:
    """A folder of Parquet or JSON files under ``p_key=.../dt=.../batch=...``."""

    def __init__(self, spark: SparkSession, root: str, codec: str = "parquet", granularity: str = "day", key: str = "subject_id"):
        self.spark, self.root, self.codec, self.granularity, self.key = spark, root.rstrip("/"), codec, granularity, key

    def _put(self, rows: DataFrame) -> None:
        rows.write.partitionBy(*PARTITION).option("partitionOverwriteMode", "dynamic").mode("overwrite").format(self.codec).save(self.root)

    def write(self, rows: DataFrame, time: Column, files: int = 4, batch: str | None = None) -> None:
        """Add a batch; rows of a partition meet in a few files, and a hot one is dealt over ``files``. The same name replaces it."""
        salt = F.pmod(F.xxhash64(*rows.columns), F.lit(files))
        out = partitioned(rows, time, self.granularity, self.key).withColumn("batch", F.lit(batch or uuid.uuid4().hex))
        self._put(out.repartition(*PARTITION, salt))

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def exists(self) -> bool:
        """Whether the store has any partition."""
        at = self._path(f"{self.root}/p_key=*/dt=*/batch=*")
        found = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(at)
        return found is not None and len(found) > 0

    def read(self) -> DataFrame:
        loaded = lambda r: r.option("mergeSchema", "true").option("basePath", self.root).format(self.codec).load(self.root)
        found = loaded(self.spark.read).schema
        typed = T.StructType([T.StructField(f.name, T.StringType()) if f.name in PARTITION else f for f in found.fields])
        return loaded(self.spark.read.schema(typed))

    def query(self, subject: str | None = None, start: Column | None = None, end: Column | None = None, time: Column | None = None, rollout: str | None = None, limit: int | None = None) -> DataFrame:
        """Rows of a subject and time span, in the order of ``time`` if given; partition filters prune files before any is read."""
        rows = self.read()
        if subject is not None:
            rows = rows.where(F.col("p_key") == (subject.replace("/", "_") or "_unknown"))
        for bound, after in ((start, True), (end, False)):
            if bound is not None:
                name = bucket(bound, self.granularity)
                rows = rows.where(F.col("dt") >= name if after else F.col("dt") <= name)
                if time is not None:
                    rows = rows.where(time >= bound if after else time <= bound)
        if rollout is not None:
            rows = rows.where(F.col("rollout_id") == rollout)
        if time is not None:
            rows = rows.orderBy(time)
        return rows if limit is None else rows.limit(limit)

    def folders(self, plan: DataFrame) -> list[str]:
        """Folders of the batches of the plan's partitions (p_key, dt): one entry a batch, as a listing has."""
        files = self.read().select(*PARTITION, F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("folder"))
        return [r[0] for r in files.join(F.broadcast(plan.select("p_key", "dt")), ["p_key", "dt"], "left_semi").select("folder").distinct().collect()]

    def remove(self, folders: list[str]) -> None:
        """Delete folders, several at a time; one that is gone already is no error."""
        conf, jvm = self.spark._jsc.hadoopConfiguration(), self.spark._jvm

        def one(folder: str) -> None:
            at = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
            at.getFileSystem(conf).delete(at, True)

        with ThreadPoolExecutor(16) as pool:
            list(pool.map(one, folders))

    def delete(self, p_key: str, dt: str) -> bool:
        """Remove a partition's files."""
        if not self.exists():
            return False
        found = self.folders(self.spark.createDataFrame([(p_key, dt)], "p_key string, dt string"))
        self.remove(found)
        return bool(found)

    def partitions(self) -> DataFrame:
        return self.read().groupBy("p_key", "dt").agg(F.count(F.lit(1)).alias("n"))


def read_both(hot: TraceStore, cold: TraceStore) -> DataFrame:
    """Rows of both stores; a batch that a move has copied but not yet removed counts once."""
    if not (hot.exists() and cold.exists()):
        return (hot if hot.exists() else cold).read()
    moved = cold.read().select(*[F.col(c).alias(f"_{c}") for c in PARTITION]).distinct()
    same = [F.col(c) == F.col(f"_{c}") for c in PARTITION]
    return hot.read().join(moved, same, "left_anti").unionByName(cold.read(), allowMissingColumns=True)


def archive(hot: TraceStore, cold: TraceStore, plan: DataFrame) -> DataFrame:
    """Rows of the partitions to migrate, from the hot store."""
    moved = plan.where(F.col("action") == "migrate").select("p_key", "dt")
    return hot.read().join(F.broadcast(moved), ["p_key", "dt"], "left_semi")


def apply(hot: TraceStore, cold: TraceStore, plan: DataFrame, dry_run: bool = False) -> DataFrame:
    """Carry out a plan (p_key, dt, action and, if both stores are planned, tier): move aged partitions to the cold store, delete expired ones.

    What is removed was listed before the copy, so a batch that arrives meanwhile stays. The plan has a row a
    partition and is the driver's list of work, as a listing of folders is; to carry it out again changes nothing.
    """
    if hot.granularity != cold.granularity:
        raise ValueError("both stores need one granularity")
    if dry_run:
        return plan
    tier = F.coalesce(F.col("tier"), F.lit("hot")) if "tier" in plan.columns else F.lit("hot")
    work = plan.select("p_key", "dt", "action", tier.alias("tier"))
    for store, name in ((hot, "hot"), (cold, "cold")):
        own = work.where(F.col("tier") == name)
        if not store.exists():
            continue
        gone = store.folders(own.where(F.col("action").isin("migrate", "delete") if name == "hot" else F.col("action") == "delete"))
        if name == "hot" and gone and not own.where("action = 'migrate'").isEmpty():
            listed = F.regexp_replace("_metadata.file_path", "/[^/]*$", "").isin(gone)
            rows = archive(hot, cold, own).where(listed) if len(gone) <= 1000 else archive(hot, cold, own)
            cold._put(rows.repartition(*PARTITION))
        store.remove(gone)
    return plan
