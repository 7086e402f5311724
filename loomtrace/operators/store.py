"""Materialised trust scores: a table that batches refresh, point look-ups, and a bounded cache before them."""

from __future__ import annotations

import time
import uuid
from collections import OrderedDict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtrace.operators import trust
from loomtrace.shared import written


class Cache:
    """The last ``maxsize`` values used, each for ``ttl`` seconds (0: for good)."""

    def __init__(self, maxsize: int = 512, ttl: float = 300.0, clock=time.monotonic):
        self.maxsize, self.ttl, self.clock, self.held = maxsize, ttl, clock, OrderedDict()

    def get(self, key):
        if key not in self.held:
            return None
        value, at = self.held[key]
        if self.ttl > 0 and self.clock() - at > self.ttl:
            del self.held[key]
            return None
        self.held.move_to_end(key)
        return value

    def set(self, key, value) -> None:
        self.held[key] = (value, self.clock())
        self.held.move_to_end(key)
        while len(self.held) > self.maxsize:
            self.held.popitem(last=False)

    def invalidate(self, key) -> None:
        self.held.pop(key, None)

    def clear(self) -> None:
        self.held.clear()


class TrustStore:
    """Scores of subjects in Parquet, dealt by a hash of the subject so that a look-up reads one folder.

    ``records`` keeps a narrow row a record (subject, order, run_id, trust), so a refresh looks at new records only
    for their trust, and at what is known of their subjects for the rest: two refreshes give what one over both would.
    A batch of a name replaces what it wrote before. ``backend`` is any object with get, set, invalidate and clear.
    """

    def __init__(self, spark: SparkSession, path: str, backend=None, parts: int = 64):
        self.spark, self.path, self.backend, self.parts = spark, path.rstrip("/"), backend if backend is not None else Cache(), parts

    def _part(self, key):
        return F.pmod(F.xxhash64(key), F.lit(self.parts)).cast("int")

    def _put(self, rows: DataFrame, name: str, by: list[str]) -> None:
        rows.withColumn("part", self._part("subject")).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*by, "part").parquet(f"{self.path}/{name}")

    def refresh(self, records: DataFrame, subject: str = "subject_id", order: str = "seq", batch: str | None = None) -> DataFrame:
        """Add records and score their subjects anew, over all that is known of them; other subjects stay."""
        name, at = batch or uuid.uuid4().hex, int(time.time() * 1000)
        fresh = trust.scored(records, subject, order).select(F.col(subject).cast("string").alias("subject"), F.col(order).alias("order"), "run_id", "overall")
        self._put(fresh.withColumn("batch", F.lit(name)), "records", ["batch"])
        known = self._read("records")
        # the folders of the batch's subjects are the only ones read
        own = known.where(F.col("batch") == name).select("part", "subject").distinct()
        rows = known.join(own, ["part", "subject"], "left_semi").select("subject", "order", "run_id", "overall")
        scores = trust.over_time(rows, "subject", "order").withColumn("computed_at_ms", F.lit(at)).withColumn("batch", F.lit(name))
        self._put(scores, "scores", ["batch"])
        self.backend.clear()
        return self.all()

    def _read(self, name: str) -> DataFrame:
        # a batch's name is a string, whatever it looks like
        loaded = lambda r: r.parquet(f"{self.path}/{name}")
        fields = [T.StructField("batch", T.StringType()) if f.name == "batch" else f for f in loaded(self.spark.read).schema.fields]
        return loaded(self.spark.read.schema(T.StructType(fields)))

    def all(self) -> DataFrame:
        """The last score of each subject."""
        rows = self._read("scores")
        rest = [c for c in rows.columns if c not in ("subject", "part", "batch")]
        return rows.groupBy("part", "subject").agg(F.max_by(F.struct(*rest), F.struct("computed_at_ms", "n_records", "batch")).alias("r")).select("subject", "r.*")

    def compact(self) -> None:
        """Leave the last score of each subject alone, as one batch."""
        kept = written(self.all(), "scores")
        before = [r[0] for r in self._read("scores").select("batch").distinct().collect()]
        self._put(kept.withColumn("batch", F.lit(uuid.uuid4().hex)), "scores", ["batch"])
        for name in before:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/scores/batch={name}")
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def get(self, subject: str) -> dict | None:
        found = self.backend.get(subject)
        if found is None:
            part = self.spark.range(1).select(self._part(F.lit(subject)).alias("p")).first()["p"]
            rows = self._read("scores").where((F.col("part") == part) & (F.col("subject") == subject)).orderBy(F.desc("computed_at_ms"), F.desc("n_records"), F.desc("batch")).drop("batch").limit(1).collect()
            found = rows[0].asDict() if rows else None
            if found:
                self.backend.set(subject, found)
        return found
