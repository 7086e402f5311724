"""Consistent-hash shards, tenants, and retention."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.functions.times import age_days


def ring(shards: int = 16, points: int = 150) -> list[tuple[str, int]]:
    """(md5 in hex, shard) of every virtual node, in order; hex of one length orders like the number."""
    return sorted((hashlib.md5(f"shard-{s}-vnode-{v}".encode()).hexdigest(), s) for s in range(shards) for v in range(points))


def shard_of(key: Column, shards: int = 16, points: int = 150) -> Column:
    """Shard of the first ring node at or after the key's md5, around the end.

    The ring is split by its first hex digits, so a key looks at a few nodes, not at all of them.
    """
    nodes = ring(shards, points)
    hashed = F.md5(key.cast("binary"))
    parts: dict[str, list[tuple[str, int]]] = {f"{i:02x}": [] for i in range(256)}
    for h, s in nodes:
        parts[h[:2]].append((h, s))
    after = nodes[0]
    rows = {}
    for prefix in sorted(parts, reverse=True):
        rows[prefix] = [*parts[prefix], ("g", after[1])]  # "g" sorts after every hex digit
        after = parts[prefix][0] if parts[prefix] else after
    pairs = []
    for prefix in sorted(rows):
        inner = ",".join(f"named_struct('h','{h}','s',{s})" for h, s in rows[prefix])
        pairs.append(f"'{prefix}',array({inner})")
    table = F.expr(f"map({','.join(pairs)})")
    return F.element_at(F.filter(F.element_at(table, F.substring(hashed, 1, 2)), lambda n: n["h"] >= hashed), 1)["s"]


def ring_ranges(spark: SparkSession, shards: int = 16, points: int = 150) -> DataFrame:
    """The ring as ranges (lo exclusive, hi inclusive, shard): a small dimension table for joins."""
    nodes = ring(shards, points)
    rows = [(nodes[k - 1][0] if k else "", h, s) for k, (h, s) in enumerate(nodes)] + [(nodes[-1][0], "g", nodes[0][1])]
    return spark.createDataFrame(rows, "lo string, hi string, shard int")


def routing_key() -> Column:
    """user_id, subject_id, run_id, each first of the record and then of its context."""
    return F.coalesce("user_id", "run_context.user_id", "subject_id", "run_context.subject_id", "run_id", "run_context.run_id", F.lit("_unknown"))


def tenant(configs: list[tuple[str, list[str]]], default: str = "_default") -> Column:
    """The record's tenant: named, of its context, by the first configuration whose prefix fits, or the default."""
    named = lambda c: F.when(F.col(c) != "", F.col(c))
    subject = F.coalesce(named("subject_id"), F.col("run_context.subject_id"))
    by_prefix = [F.when(subject.startswith(p), F.lit(t)) for t, prefixes in configs for p in prefixes]
    return F.coalesce(named("tenant_id"), named("organization_id"), named("run_context.org"), named("run_context.organization_id"), named("run_context.tenant_id"), *by_prefix, F.lit(default))


def allows(prefixes: list[str], subject: Column) -> Column:
    out = F.lit(not prefixes)
    for p in prefixes:
        out = out | subject.startswith(p)
    return out


def retention(partitions: DataFrame, bucket: str, now: Column, hot_days: float, delete_after: float | None = None, granularity: str = "day", tier: str = "hot") -> DataFrame:
    """Planned action of each partition: keep, migrate or delete; cold ones are only deleted or kept."""
    if hot_days < 0 or (delete_after is not None and delete_after < hot_days):
        raise ValueError("ages can't be negative, nor can a partition be deleted before it leaves the hot store")
    age = age_days(F.col(bucket), now, granularity)
    gone = F.col("age_days") >= delete_after if delete_after is not None else F.lit(False)
    action = F.when(gone, "delete").when((F.col("age_days") >= hot_days) & F.lit(tier == "hot"), "migrate").otherwise("keep")
    return partitions.withColumn("age_days", age).withColumn("action", action).withColumn("tier", F.lit(tier))
