"""Admission of single records under a tenant's limits, of which a refused record uses nothing up.

Whether a record is admitted depends on which were admitted before it, so this is no running sum. A tenant's
records are cut into ranges of the order. A day's count begins anew wherever the day changes in the order, so a
day that comes back is a new turn; a row's number within its turn and range is a window, and what a turn brings
from earlier ranges follows from a row a range. A range is summed up once: its turns, their bytes as far as the
day's limit leaves them if none was refused for storage, and the least size. A walk over the summaries of a
tenant (a row a range) passes a range whose outcome is certain:

* the first turn went undisturbed and its admissible records fit into the storage left: all of them enter,
* the range's one turn is used up, or not even the smallest record fits: none enters.

At any other range the walk stops, that range is run through record by record from the state at its start, all
tenants' stops in one job, and the walk goes on behind it. What storage is left after a refusal is less than
the refused record, so few later ranges hold one that still fits; there are at most as many jobs as ranges of
a tenant. ``stream`` does the same with one small state a tenant.

A null tenant is a tenant, a null size is 0, a null order comes first; records equal in order and ties are
admitted in the order of their days.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomtrace.functions.running import HOT, ranges
from loomtrace.shared import checkpointed, written

RECORDS, STORAGE = "records_per_day", "storage_bytes"
RANGE = ["t", "part"]
OUT = "records_today long, storage_bytes long, breach string"


@dataclass
class Usage:
    """What a tenant has used up: the records of its last day, and all bytes."""

    per_day: int | None
    storage: int | None
    day: str | None = None
    records: int = 0
    used: int = 0

    def on(self, day: str) -> None:
        if day != self.day:
            self.day, self.records = day, 0

    def admit(self, day: str, size: int) -> str | None:
        """Count the record in, or name the limit that it would exceed."""
        self.on(day)
        if self.per_day is not None and self.records >= self.per_day:
            return RECORDS
        if self.storage is not None and self.used + size > self.storage:
            return STORAGE
        self.records, self.used = self.records + 1, self.used + size
        return None


def _carried(tenant: pd.DataFrame) -> pd.DataFrame:
    """The rows that the first turn of each range of a tenant has in earlier ranges; -1 if it begins there."""
    out, last, held = [], None, 0
    for r in tenant.sort_values("part").to_dict("records"):
        carry = held if last == r["first"] else -1
        held = r["n_last"] + (max(carry, 0) if r["turns"] == 0 else 0)
        last = r["last"]
        out.append((r["t"], r["part"], carry))
    return pd.DataFrame(out, columns=[*RANGE, "carry"])


def _walk(per_day: int | None, storage: int | None):
    """The state at the start of each range of a tenant, and what becomes of it, up to the first that has to be run."""

    def over(tenant: pd.DataFrame) -> pd.DataFrame:
        out, records, used = [], 0, 0
        for r in tenant.sort_values("part").to_dict("records"):
            if r["carry"] < 0:
                records = 0
            start = (records, used)
            undisturbed = per_day is None or records == min(per_day, max(r["carry"], 0))
            if r["end_used"] >= 0:
                kind, records, used = "run", r["end_records"], r["end_used"]
            elif undisturbed and (storage is None or used + r["bytes"] <= storage):
                kind, records, used = "all", r["n_last"] + (records if r["turns"] == 0 else 0), used + r["bytes"]
                records = records if per_day is None else min(per_day, records)
            elif (per_day is not None and r["turns"] == 0 and records >= per_day) or used + r["least"] > storage:
                kind, records = "none", records if r["turns"] == 0 else 0
            else:
                kind = "stop"
            out.append((r["t"], r["part"], kind, *start))
            if kind == "stop":
                break
        return pd.DataFrame(out, columns=[*RANGE, "kind", "records", "used"])

    return over


def _run(per_day: int | None, storage: int | None, ends: bool):
    """A range record by record: the usage at its end, or its records with what each found."""

    def one(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        now = Usage(per_day, storage, rows["d"][0].as_py(), rows["records"][0].as_py(), rows["used"][0].as_py())
        found = [(now.admit(d, s), now.records, now.used) for d, s in zip(rows["d"].to_pylist(), rows["s"].to_pylist(), strict=True)]
        if ends:
            return rows.slice(0, 1).select(RANGE).append_column("end_records", pa.array([now.records], pa.int64())).append_column("end_used", pa.array([now.used], pa.int64()))
        breach, records, used = zip(*found, strict=True)
        rows = rows.drop_columns(["records", "used"])
        return rows.append_column("records_today", pa.array(records, pa.int64())).append_column("storage_bytes", pa.array(used, pa.int64())).append_column("breach", pa.array(breach, pa.string()))

    return one


def within_quota(rows: DataFrame, tenant: str, day: Column, order: str, size: Column, per_day: int | None = None, storage: int | None = None, ties: tuple[str, ...] = (), hot: int = HOT) -> DataFrame:
    """``rows`` with the tenant's admitted records of the day and bytes after each, and the limit that refused it, or null."""
    own = [f"c{i}" for i in range(len(rows.columns))]
    by = ["o", *[f"o{i}" for i in range(len(ties))], "d"]
    flat = rows.select(
        *[F.col(c).alias(o) for c, o in zip(rows.columns, own, strict=True)], F.coalesce(F.concat(F.lit("t"), F.col(tenant).cast("string")), F.lit("n")).alias("t"), F.coalesce(day.cast("string"), F.lit("")).alias("d"),
        F.coalesce(size.cast("long"), F.lit(0)).alias("s"), *[F.col(c).alias(o) for c, o in zip((order, *ties), by[:-1], strict=True)],
    )
    cut = ranges(flat, ["t"], "o", hot)
    kept = flat.withColumn("part", F.lit(0)) if cut is None else cut.withColumn("part", F.coalesce("_part", F.lit(0))).drop("_part")
    # the place in the range, the turns begun in it before, and the place in the turn as far as it lies in the range
    inside = W.partitionBy(*RANGE).orderBy(*by)
    upto = inside.rowsBetween(W.unboundedPreceding, 0)
    kept = kept.withColumns({"at": F.row_number().over(inside).cast("long"), "_turned": F.lag("d").over(inside) != F.col("d")})
    kept = kept.withColumns({"turn": F.sum(F.when(F.col("_turned"), 1).otherwise(0)).over(upto), "_from": F.coalesce(F.max(F.when(F.col("_turned"), F.col("at"))).over(upto), F.lit(1))})
    kept = written(kept.withColumn("place", F.col("at") - F.col("_from") + 1).drop("_turned", "_from", *by[:-1]), "quota")

    ends_of = kept.groupBy(*RANGE).agg(F.max("turn").alias("turns"), F.min_by("d", "at").alias("first"), F.max_by("d", "at").alias("last"), F.max_by("place", "at").alias("n_last"))
    ends_of = checkpointed(ends_of)
    carried = ends_of.join(ends_of.groupBy("t").applyInPandas(_carried, "t string, part int, carry long"), RANGE).select(*RANGE, "turns", "n_last", "carry")
    carried = checkpointed(carried)
    earlier = F.when(F.col("turn") == 0, F.greatest("carry", F.lit(0))).otherwise(0)
    fits = F.col("place") + earlier <= per_day if per_day is not None else F.lit(True)
    sums = kept.join(carried.select(*RANGE, "carry"), RANGE).groupBy(*RANGE).agg(F.min("s").alias("least"), F.coalesce(F.sum(F.when(fits, F.col("s"))), F.lit(0)).alias("bytes"))
    sums = checkpointed(sums.join(carried, RANGE))
    ends = rows.sparkSession.createDataFrame([], "t string, part int, end_records long, end_used long")
    while True:
        known = sums.join(ends, RANGE, "left").na.fill(-1, ["end_records", "end_used"])
        plan = checkpointed(known.groupBy("t").applyInPandas(_walk(per_day, storage), "t string, part int, kind string, records long, used long"))
        stops = plan.where("kind = 'stop'").drop("kind")
        if stops.isEmpty():
            break
        ran = kept.select(*RANGE, "d", "s", "at").join(stops, RANGE).groupBy(*RANGE).applyInArrow(_run(per_day, storage, True), ends.schema)
        ends = checkpointed(ends.unionByName(ran))

    placed = kept.join(plan, RANGE)
    start = F.when(F.col("turn") == 0, F.col("records")).otherwise(0)
    reached = start + F.col("place")
    all_in = F.col("kind") == "all"
    enters = all_in & (reached <= per_day) if per_day is not None else all_in
    today = F.when(all_in, F.least(reached, F.lit(per_day)) if per_day is not None else reached).otherwise(start)
    so_far = W.partitionBy(*RANGE).orderBy("at").rowsBetween(W.unboundedPreceding, 0)
    whole = placed.where("kind <> 'run'").withColumn("records_today", today).withColumn("storage_bytes", F.col("used") + F.sum(F.when(enters, F.col("s")).otherwise(0)).over(so_far))
    full = F.col("records_today") >= per_day if per_day is not None else F.lit(False)
    whole = whole.withColumn("breach", F.when(~enters, F.when(full, RECORDS).otherwise(STORAGE)))
    schema = T.StructType([*kept.schema.fields, *T._parse_datatype_string(OUT).fields])
    singly = placed.where("kind = 'run'").select(*kept.columns, "records", "used").groupBy(*RANGE).applyInArrow(_run(per_day, storage, False), schema)
    out = whole.select(*schema.names).unionByName(singly.select(*schema.names))
    return out.select(*[F.col(o).alias(c) for c, o in zip(rows.columns, own, strict=True)], *[x.split()[0] for x in OUT.split(", ")])


class _Admission(StatefulProcessor):
    def __init__(self, per_day: int | None, storage: int | None):
        self.limits = (per_day, storage)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.usage = handle.getValueState("usage", "day string, records long, used long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = Usage(*self.limits, *(self.usage.get() if self.usage.exists() else ()))
        f = pd.concat(list(rows)).sort_values("seq", kind="stable")
        found = [(now.admit(d, int(s)), now.records, now.used) for d, s in zip(f["day"], f["size"], strict=True)]
        self.usage.update((now.day, now.records, now.used))
        f[["breach", "records_today", "storage_bytes"]] = pd.DataFrame(found, index=f.index, dtype=object)
        yield f[["tenant", "seq", "day", "size", "records_today", "storage_bytes", "breach"]]

    def close(self) -> None:
        pass


def stream(rows: DataFrame, per_day: int | None = None, storage: int | None = None) -> DataFrame:
    """The same from a stream of (tenant, seq, day, size) whose records arrive in order of ``seq`` from batch to batch."""
    return rows.select(F.col("tenant").cast("string"), F.col("seq").cast("long"), F.col("day").cast("string"), F.col("size").cast("long")).groupBy("tenant").transformWithStateInPandas(
        _Admission(per_day, storage), f"tenant string, seq long, day string, size long, {OUT}", "append", "none"
    )
