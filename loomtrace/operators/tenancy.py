"""Tenants: admission of batches under quotas, access checks, usage, and the audit log of all three.

The audit log is a folder of JSON lines that is only appended to; filters on it are ordinary filters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.operators.routing import allows

EVENT = "event_type string, tenant_id string, actor string, resource string, outcome string, detail map<string,string>, timestamp timestamp"


def events(rows: DataFrame, kind: Column | str, tenant: Column, outcome: Column | str, detail: dict[str, Column], resource: Column | str = "traces", actor: str = "system") -> DataFrame:
    """Audit events, one a row."""
    text = lambda c: F.lit(c) if isinstance(c, str) else c
    pairs = [x for k, v in detail.items() for x in (F.lit(k), v.cast("string"))]
    return rows.select(text(kind).alias("event_type"), tenant.cast("string").alias("tenant_id"), F.lit(actor).alias("actor"), text(resource).alias("resource"), text(outcome).alias("outcome"), F.create_map(*pairs).alias("detail"), F.current_timestamp().alias("timestamp"))


class AuditLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, rows: DataFrame) -> None:
        rows.write.mode("append").json(self.path)

    def read(self, tenant: str | None = None, kind: str | None = None) -> DataFrame:
        rows = self.spark.read.schema(EVENT).json(self.path)
        if tenant is not None:
            rows = rows.where(F.col("tenant_id") == tenant)
        return rows if kind is None else rows.where(F.col("event_type") == kind)


def usage(admitted: DataFrame, tenant: str = "tenant_id", day: str = "day", size: str = "n_bytes", subject: str = "subject_id", today: Column | None = None) -> DataFrame:
    """Per tenant: today's records, all bytes, and distinct subjects."""
    now = F.current_date() if today is None else today
    named = F.when(F.col(subject) != "", F.col(subject))
    return admitted.groupBy(tenant).agg(F.count_if(F.col(day) == now).alias("records_today"), F.sum(size).cast("long").alias("storage_bytes"), F.count_distinct(named).alias("n_subjects"))


def admit(batch: DataFrame, admitted: DataFrame, quotas: DataFrame, today: Column) -> DataFrame:
    """Per tenant of the batch: what it asks for, what it has, and the first limit that it would exceed.

    ``batch`` and ``admitted`` have tenant_id, subject_id, n_bytes and day; quotas: tenant_id and the
    three limits, null for none, a row a tenant, which is a dimension small enough to broadcast. A tenant's
    batch is admitted whole or not at all, each on its own.
    """
    named = F.when(F.col("subject_id") != "", F.col("subject_id"))
    asked = batch.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n_records"), F.sum("n_bytes").cast("long").alias("n_bytes"), F.count_distinct(named).alias("n_subjects"))
    known = admitted.select("tenant_id", "subject_id").distinct()
    fresh = batch.select("tenant_id", named.alias("subject_id")).where("subject_id is not null").distinct().join(known, ["tenant_id", "subject_id"], "left_anti").groupBy("tenant_id").agg(F.count(F.lit(1)).alias("n_new"))
    held = usage(admitted, today=today).select("tenant_id", F.col("records_today").alias("has_records"), F.col("storage_bytes").alias("has_bytes"), F.col("n_subjects").alias("has_subjects"))
    rows = asked.join(fresh, "tenant_id", "left").join(held, "tenant_id", "left").join(F.broadcast(quotas), "tenant_id", "left").na.fill(0, ["n_new", "has_records", "has_bytes", "has_subjects"])
    over = [("records_per_day", "has_records", "n_records", "max_records_per_day"), ("storage_bytes", "has_bytes", "n_bytes", "max_storage_bytes"), ("subjects", "has_subjects", "n_new", "max_subjects")]
    breach = F.coalesce(*[F.when(F.col(a) + F.col(b) > F.col(limit), F.lit(name)) for name, a, b, limit in over])
    return rows.withColumn("breach", breach)


def ingest(batch: DataFrame, admitted: DataFrame, quotas: DataFrame, today: Column, log: AuditLog | None = None, actor: str = "system") -> DataFrame:
    """The rows of the tenants that stay within their quotas; one audit event a tenant, blocked or not."""
    decided = admit(batch, admitted, quotas, today)
    if log is not None:
        blocked = F.col("breach").isNotNull()
        log.append(events(decided, F.when(blocked, "quota_exceeded").otherwise("ingest"), F.col("tenant_id"), F.when(blocked, "blocked").otherwise("success"), {"resource": F.col("breach"), "n_records": F.col("n_records"), "n_subjects": F.col("n_subjects")}, actor=actor))
    return batch.join(decided.where("breach is null").select("tenant_id"), "tenant_id", "left_semi")


def access(asked: DataFrame, prefixes: dict[str, list[str]], actor: str = "system") -> DataFrame:
    """Audit events of queries (tenant_id, subject_id): denied where the tenant admits no such subject."""
    allowed = F.lit(True)
    for tenant, own in prefixes.items():
        allowed = F.when(F.col("tenant_id") == tenant, allows(own, F.col("subject_id"))).otherwise(allowed)
    denied = ~allowed & F.col("subject_id").isNotNull()
    resource = F.when(F.col("subject_id").isNull(), "traces").otherwise(F.concat(F.lit("traces/subject_id="), F.col("subject_id")))
    return events(asked, F.when(denied, "access_denied").otherwise("query"), F.col("tenant_id"), F.when(denied, "failure").otherwise("success"), {"subject_id": F.col("subject_id")}, resource, actor)
