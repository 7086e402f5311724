"""Latencies of a stream as mergeable states: counts, sums, extremes, and a KLL sketch of the values.

A batch adds one small row a key, under its own number, so a batch that runs again replaces its row. States of
any batches merge in any order; after ``EVERY`` of them they are merged into one, so what is kept is bounded. A
sketch holds all values while they are few and then those that bound the rank error by some 2.3 / k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

K, EVERY = 1000, 32


def state(rows: DataFrame, keys: list[str], latency: Column, sla_ms: float, more: dict[str, Column] | None = None) -> DataFrame:
    """One state a key: n, sum_ms, max_ms, n_within, the sketch, and further sums."""
    own = rows.withColumn("_ms", latency.cast("double"))
    sums = [F.sum(v).cast("long").alias(k) for k, v in (more or {}).items()]
    return own.groupBy(*keys).agg(F.count("_ms").alias("n"), F.sum("_ms").alias("sum_ms"), F.max("_ms").alias("max_ms"), F.count_if(F.col("_ms") <= sla_ms).alias("n_within"), F.kll_sketch_agg_double("_ms", F.lit(K)).alias("sketch"), *sums)


def merged(states: DataFrame, keys: list[str], more: tuple[str, ...] = ()) -> DataFrame:
    """States of a key as one."""
    total = lambda c: F.sum(c).alias(c)
    return states.groupBy(*keys).agg(total("n"), total("sum_ms"), F.max("max_ms").alias("max_ms"), total("n_within"), F.kll_merge_agg_double("sketch", F.lit(K)).alias("sketch"), *[total(c) for c in more])


def quantile(share: float) -> Column:
    """The latency below which the share of a state's values lies; null for a state without values."""
    return F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(share)))


def summary(states: DataFrame, keys: list[str], more: tuple[str, ...] = ()) -> DataFrame:
    m = merged(states, keys, more)
    return m.select(*keys, "n", *more, (F.col("sum_ms") / F.col("n")).alias("mean_ms"), quantile(0.5).alias("p50_ms"), quantile(0.99).alias("p99_ms"), "max_ms", F.when(F.col("n") > 0, F.col("n_within") / F.col("n")).otherwise(1.0).alias("within_sla"))


class States:
    """The states of a stream in a folder: ``batch=<number>`` for each batch since the last merge, which is in ``upto=<number>``."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], more: tuple[str, ...] = ()):
        self.spark, self.path, self.keys, self.more = spark, path.rstrip("/"), keys, more

    def _numbers(self, name: str) -> list[int]:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}=*/_SUCCESS")  # whole ones
        found = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(at)
        return sorted(int(f.getPath().getParent().getName().split("=")[1]) for f in found or [])

    def add(self, rows: DataFrame, batch: int) -> None:
        """Put a batch's states; one that is merged already changes nothing."""
        if batch <= max(self._numbers("upto"), default=-1):
            return
        rows.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        if len(self._current()[1]) >= EVERY:
            self.merge(batch)

    def _current(self) -> tuple[int | None, list[int]]:
        upto = max(self._numbers("upto"), default=None)
        return upto, [b for b in self._numbers("batch") if upto is None or b > upto]

    def read(self) -> DataFrame:
        upto, since = self._current()
        folders = [f"batch={b}" for b in since] + ([f"upto={upto}"] if upto is not None else [])
        if not folders:
            raise FileNotFoundError(f"no batch in {self.path}")
        return merged(self.spark.read.parquet(*[f"{self.path}/{f}" for f in folders]), self.keys, self.more)

    def merge(self, batch: int) -> None:
        """Merge all states; what they were merged from goes once the merge is whole."""
        self.read().write.mode("overwrite").parquet(f"{self.path}/upto={batch}")
        for name in ("batch", "upto"):
            for b in self._numbers(name):
                if b < batch or (name == "batch" and b == batch):
                    at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}={b}")
                    at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
