"""Event-sourced registries, checkpoints and job manifests, over JSON lines that are only appended to."""

from __future__ import annotations

import hashlib
import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.operators import datasets, lineage, training
from loomtrace.sources import jsonl

ENTRY = "id string, type string, version string, digest string, path string, metadata string"
EVENT = f"seq long, event string, ts timestamp, {ENTRY}"
CHECKPOINT = "checkpoint_id string, mode string, dataset_version string, base_ref string, status string, path string, metrics map<string,double>, created_at_ms long"
MODES = ("sft", "dpo", "ppo")
#: Entries of an index.
MOST = 100_000
ORCHESTRATORS = ("local", "slurm", "kubernetes", "ray")


class Registry:
    """Entries by id; the log has every change, ``save`` writes the index of what is live. One writer at a time."""

    def __init__(self, spark: SparkSession, root: str, types: tuple[str, ...] = ()):
        self.spark, self.root, self.types = spark, root.rstrip("/"), types

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def log(self) -> DataFrame:
        path = f"{self.root}/events"
        return self.spark.read.schema(EVENT).json(path) if self._exists(path) else self.spark.createDataFrame([], EVENT)

    def _append(self, event: str, entry: dict) -> None:
        seq = (self.log().agg(F.max("seq")).first()[0] or 0) + 1
        row = self.spark.createDataFrame([tuple(entry.get(c.split()[0]) for c in ENTRY.split(", "))], ENTRY)
        row.select(F.lit(seq).cast("long").alias("seq"), F.lit(event).alias("event"), F.current_timestamp().alias("ts"), "*").coalesce(1).write.mode("append").json(f"{self.root}/events")

    def register(self, **entry: str) -> None:
        if self.types and entry.get("type") not in self.types:
            raise ValueError(f"unknown type {entry.get('type')!r}")
        if entry.get("path") and not entry.get("digest"):
            raise ValueError("an entry with a path needs the digest of its file")
        self._append("register", entry)

    def remove(self, id: str) -> None:
        if not self.lookup(id).isEmpty():
            self._append("remove", {"id": id})

    def rollback(self, **entry: str) -> None:
        self._append("rollback", entry)

    def entries(self) -> DataFrame:
        """The live entries, in the order of their first registration."""
        first = self.log().groupBy("id").agg(F.min("seq").alias("first"))
        return lineage.current(self.log(), "id").join(first, "id").orderBy("first").drop("first", "event", "ts")

    def lookup(self, id: str) -> DataFrame:
        return self.entries().where(F.col("id") == id)

    def list_by_type(self, kind: str) -> DataFrame:
        return self.entries().where(F.col("type") == kind)

    def save(self, sign=None) -> str:
        """Write the index as one JSON text, signed by ``sign`` (bytes -> text) if given; its digest.

        The index is one signed document, so it passes through the driver: ``MOST`` entries at most, else an error.
        """
        if self.entries().limit(MOST + 1).count() > MOST:
            raise ValueError(f"an index has at most {MOST} entries; read the live ones with entries()")
        text = json.dumps({"entries": [r.asDict() for r in self.entries().collect()]}, indent=2, ensure_ascii=False, default=str)
        parts = {"index": text} | ({"signature": sign(text.encode())} if sign else {})
        for name, value in parts.items():
            self.spark.createDataFrame([(value,)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\x1e").text(f"{self.root}/{name}")
        return hashlib.sha256(text.encode()).hexdigest()

    def index_digest(self) -> str:
        """Digest of the saved index, empty without one."""
        if not self._exists(f"{self.root}/index"):
            return ""
        text = self.spark.read.option("lineSep", "\x1e").text(f"{self.root}/index").first()[0]
        return hashlib.sha256(text.encode()).hexdigest()

    def verify(self, files: DataFrame) -> DataFrame:
        """Each entry against files (path, content): ok and why."""
        actual = files.select(F.col("path").alias("_p"), F.sha2("content", 256).alias("_d"))
        rows = self.entries().join(actual, F.col("path") == F.col("_p"), "left")
        blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
        why = F.when(blank("path"), "no file").when(blank("digest"), "a file without a digest").when(F.col("_d").isNull(), "file not found").when(F.col("_d") == F.col("digest"), "digest verified").otherwise("digest mismatch")
        return rows.select("id", why.isin("no file", "digest verified").alias("ok"), why.alias("message"))


def register_checkpoints(entries: DataFrame, known: DataFrame) -> DataFrame:
    """``known`` and the entries whose id it lacks; unknown modes are an error."""
    bad = entries.where(~F.col("mode").isin(*MODES)).limit(1).collect()
    if bad:
        raise ValueError(f"unknown mode {bad[0]['mode']!r}")
    now = F.lit(int(time.time() * 1000)).cast("long")
    return lineage.insert_absent(entries.withColumn("created_at_ms", F.when(F.coalesce("created_at_ms", F.lit(0)) == 0, now).otherwise(F.col("created_at_ms"))), known, "checkpoint_id")


def latest(checkpoints: DataFrame, mode: str | None = None) -> DataFrame:
    """The newest checkpoint, of a mode if given: no row without any."""
    rows = checkpoints if mode is None else checkpoints.where(F.col("mode") == mode)
    cols = rows.columns
    return rows.agg(F.max_by(F.struct(*cols), F.struct("created_at_ms", "checkpoint_id")).alias("r")).where("r is not null").select("r.*")


def records_for_mode(rollouts: DataFrame, mode: str) -> DataFrame:
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}; one of {MODES}")
    return {"sft": training.sft, "dpo": training.dpo, "ppo": training.ppo}[mode](rollouts)


def job_manifest(rows: DataFrame, order: str, mode: str, out_dir: str, base_ref: str = "", orchestrator: str = "local", hyperparameters: dict | None = None, save_steps: int = 50, save_total_limit: int = 3, resume_from: str | None = None) -> dict:
    """Version a dataset and write the manifest of the job that is to train on it."""
    if mode not in MODES or orchestrator not in ORCHESTRATORS:
        raise ValueError(f"unknown mode or orchestrator: {mode!r}, {orchestrator!r}")
    data, now = datasets.version(rows, order, mode, out_dir), int(time.time() * 1000)
    job = {
        "job_id": f"{mode}-{data['version']}-{now}", "mode": mode, "orchestrator": orchestrator, "dataset": data, "base_ref": base_ref,
        "checkpoint_plan": {"save_steps": save_steps, "save_total_limit": save_total_limit, "resume_from": resume_from},
        "telemetry_sink": f"{out_dir}/{mode}-{data['version']}.telemetry", "hyperparameters": hyperparameters or {}, "created_at_ms": now,
    }
    save_json(rows.sparkSession, job, f"{out_dir}/training-job.manifest")
    save_json(rows.sparkSession, data, f"{data['path']}.manifest")
    return job


def save_json(spark: SparkSession, value: dict, path: str) -> None:
    """A manifest, receipt or report as indented JSON."""
    spark.createDataFrame([(json.dumps(value, indent=2, ensure_ascii=False, default=str),)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\x1e").text(path)


def load_json(spark: SparkSession, path: str) -> dict:
    """What ``save_json`` wrote, or any single JSON file: dataset manifests, receipts, reports."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0].replace("\x1e", ""))


def load_log(spark: SparkSession, path: str) -> DataFrame:
    return jsonl.read(spark, path, ENTRY + ", event string")
