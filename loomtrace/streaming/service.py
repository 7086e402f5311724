"""Ingestion and evaluation of evidence as a stream: several sinks a batch, each once.

A batch's number names what it writes to every sink, and writing it again replaces it; so a stream that was
killed anywhere within a batch and begun again gives each row once. The source's checkpoint says which batch is
next, ``most_files`` bounds a batch, and ``availableNow`` ends when all that is there is done.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomtrace import schemas
from loomtrace.operators import ingestion, tenancy, trust
from loomtrace.streaming import compliance, latency

STATE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
VERDICTS = ("pass", "quarantine", "reject")


def source(spark: SparkSession, folder: str, most_files: int = 100) -> DataFrame:
    """Lines of JSON of the files that a folder has and gets, or of one file: the record's fields, ``value``, and for a bad line ``error``."""
    schema = schemas.AEP.replace("\n", " ")
    at, reader = spark._jvm.org.apache.hadoop.fs.Path(folder), spark.readStream.option("maxFilesPerTrigger", most_files)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).isFile(at):
        reader, folder = reader.option("pathGlobFilter", at.getName()), at.getParent().toString()
    lines = reader.text(folder).where((F.col("value") != "") & ~F.col("value").startswith("#"))
    got = lines.select("value", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    error = F.when(F.col("r._bad").isNotNull(), F.concat(F.lit("JSON parse error: "), F.substring("value", 1, 80)))
    return got.select("value", "r.*", error.alias("error")).drop("_bad")


def sinks(root: str, targets: dict[str, Callable[[DataFrame], DataFrame]], then: Callable[[DataFrame, int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each target's rows of the batch to ``root/<target>/batch=<number>``; the batch is evaluated once."""

    def put(rows: DataFrame, batch: int) -> None:
        kept = rows.persist()
        try:
            for name, of in targets.items():
                of(kept).write.mode("overwrite").parquet(f"{root}/{name}/batch={batch}")
            if then is not None:
                then(kept, batch)
        finally:
            kept.unpersist()

    return put


def _started(rows: DataFrame, put: Callable[[DataFrame, int], None], checkpoint: str, once: bool, mode: str = "append") -> StreamingQuery:
    out = rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode(mode)
    return (out.trigger(availableNow=True) if once else out).start()


def ingest(records: DataFrame, root: str, checkpoint: str, shards: int = 16, signature: Column | None = None, actor: str = "system", once: bool = True) -> StreamingQuery:
    """A stream of records (``source``) to ``accepted`` and ``refused``, by shard, and an ``audit`` event a shard and batch."""
    rows = ingestion.ingest(records.withColumn("user_id", F.col("user_id") if "user_id" in records.columns else F.lit(None).cast("string")), shards, signature=signature)

    def events(r: DataFrame) -> DataFrame:
        counted = ingestion.ingested(r)
        outcome = F.when(F.col("n_invalid") == 0, "success").when(F.col("n_valid") == 0, "failure").otherwise("partial")
        return tenancy.events(counted, "ingest", F.lit(None), outcome, {c: F.col(c) for c in ("n", "n_valid", "n_invalid")}, F.concat(F.lit("shard="), F.col("shard").cast("string")), actor)

    targets = {"accepted": lambda r: r.where("passed").drop("errors", "error"), "refused": lambda r: r.where(~F.col("passed")).select("shard", "run_id", "value", "errors"), "audit": events}
    return _started(rows, sinks(root, targets), checkpoint, once)


def evaluate(records: DataFrame, root: str, checkpoint: str, budget: int = 3, floor: float = 1.0, signature: Column | None = None, admission: bool = True, sla_ms: float = 1000.0, once: bool = True) -> StreamingQuery:
    """A stream of records to ``feedback`` (verdicts, with the admission of those that don't end early) and ``stats`` (``latency.States``).

    A record's place among its subject's of the batch is its time. Its latency is what it waited for its batch's
    feedback. The counts of a subject are keyed state.
    """
    spark = records.sparkSession
    if spark.conf.get(STATE, ROCKS) != ROCKS:
        raise RuntimeError(f"keyed state needs {STATE}={ROCKS}")
    spark.conf.set(STATE, ROCKS)
    seq = F.coalesce(F.col("created_at_ms").try_cast("long"), F.lit(0))
    rows = records.withColumn("_seq", seq)
    if admission:
        rows = trust.admission(rows, keep=tuple(c for c in rows.columns if c != "run_id"))
        rows = rows.withColumns({"admission": "score", "admission_category": "category"})
    extra = ("admission", "admission_category") if admission else ()
    checked = compliance.checks(rows, "_seq", floor, signature, extra)
    checked = checked.withColumns({c: F.when(F.col("hard").isNull(), F.col(c)) for c in extra})
    held = states(spark, root)

    def put(batch_rows: DataFrame, batch: int) -> None:
        began = time.time()

        def counted(kept: DataFrame, number: int) -> None:
            waited = F.lit((time.time() - began) * 1000)
            held.add(latency.state(kept, [], waited, sla_ms, {f"n_{v}": (F.col("verdict") == v).cast("long") for v in VERDICTS}), number)

        sinks(root, {"feedback": lambda r: r}, counted)(batch_rows, batch)

    return _started(compliance.stream(checked, budget), put, checkpoint, once)


def states(spark: SparkSession, root: str) -> latency.States:
    return latency.States(spark, f"{root}/stats", [], tuple(f"n_{v}" for v in VERDICTS))


def stats(spark: SparkSession, root: str) -> DataFrame:
    """One row: records, verdicts, latencies with their 99th percentile, and the share within the limit."""
    return latency.summary(states(spark, root).read(), [], tuple(f"n_{v}" for v in VERDICTS))
