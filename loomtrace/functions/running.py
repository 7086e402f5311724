"""Running sums and values at ranks within keys, of which one may hold most rows.

Keys of up to ``HOT`` rows are windows. A larger key's rows are cut into ranges of its order, at quantiles
of that key, so that an outlier leaves no range with more than its share; sums of whole ranges are added up
first, and enter each range as a row before its first. So no task sorts a whole key. The input is counted by
key (a scan of the key columns), and only if a key is hot it is written once, and the ranges read from there.

The order may be a number, a time, a date or a string, and null, which sorts first. Rows that are equal in
order and ties add up in any order; rows of one and the same order stay in one range.
"""

from __future__ import annotations

import math
import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtrace.shared import written

#: Rows of a key that one task may sort, and the most ranges of a key.
HOT, PARTS = 200_000, 4096


def place(rows: DataFrame, order: str) -> Column:
    """A number that never falls where the order rises."""
    kind = rows.schema[order].dataType
    if isinstance(kind, T.StringType):  # six bytes behind what all have in common, as strings sort by bytes
        ends = rows.agg(F.min(order).alias("a"), F.max(order).alias("b")).first()
        shared = len(os.path.commonprefix([(ends[c] or "").encode() for c in "ab"]))
        return F.conv(F.rpad(F.hex(F.substring(F.encode(order, "utf-8"), shared + 1, 6)), 12, "0"), 16, 10).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(order).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return F.col(order).cast("timestamp").cast("double")
    return F.col(order).cast("double")


def hot_keys(rows: DataFrame, keys: list[str], hot: int) -> DataFrame:
    """The keys with more than ``hot`` rows as _k0, _k1 ..., and their rows as _rows."""
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > hot)
    return counted.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_rows")


def same_keys(keys: list[str]) -> list[Column]:
    return [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]


def ranges(rows: DataFrame, keys: list[str], order: str, hot: int = HOT, most: int = PARTS) -> DataFrame | None:
    """``rows``, written once, with the number of each row's range as _part; null if its key has one. None if no key is hot."""
    many = [r["_rows"] for r in hot_keys(rows, keys, hot).agg(F.max("_rows").alias("_rows")).collect()][0]
    if many is None:
        return None
    parts = min(most, 2 * math.ceil(many / hot))
    kept = written(rows, "running")
    kept = kept.withColumn("_place", place(kept, order))
    large = hot_keys(kept, keys, hot).drop("_rows")
    # few keys are hot, so both tables go to the rows: a join by key would read a whole key in one task
    own = kept.join(F.broadcast(large), same_keys(keys)).groupBy(*large.columns)
    cuts = own.agg(F.percentile_approx("_place", [k / parts for k in range(1, parts)], 20 * parts).alias("_cuts"), F.count(F.lit(1)).alias("_rows"))
    # the last cut below the row's place, by halving
    steps = F.array(*[F.lit(1 << k) for k in range(parts.bit_length() - 1, -1, -1)])
    part = F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get("_cuts", at + step - 1) < F.col("_place"), step).otherwise(0))
    return kept.join(F.broadcast(cuts), same_keys(keys), "left").withColumn("_part", F.when(F.col("_rows").isNotNull(), part)).select(*rows.columns, "_part")


def running(rows: DataFrame, keys: list[str], order: str, sums: dict[str, Column], ties: tuple[str, ...] = (), hot: int = HOT) -> DataFrame:
    """Adds each of ``sums`` up to and with the row, in the order of ``order``, then ``ties``; nulls in a sum count 0."""
    names = list(sums)
    valued = rows.withColumns({f"_v_{k}": F.coalesce(v, F.lit(0)) for k, v in sums.items()})
    cut = ranges(valued, keys, order, hot)
    if cut is None:
        by = Window.partitionBy(*keys).orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
        return valued.select(*rows.columns, *[F.sum(f"_v_{k}").over(by).alias(k) for k in names])
    totals = cut.where("_part is not null").groupBy(*keys, "_part").agg(*[F.sum(f"_v_{k}").alias(f"_v_{k}") for k in names])
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*keys, "_part", *[F.coalesce(F.sum(f"_v_{k}").over(earlier), F.lit(0)).alias(f"_v_{k}") for k in names], F.lit(0).alias("_row"))
    both = cut.withColumn("_row", F.lit(1)).unionByName(before, allowMissingColumns=True)
    by = Window.partitionBy(*keys, "_part").orderBy("_row", order, *ties).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumns({k: F.sum(f"_v_{k}").over(by) for k in names}).where("_row = 1").select(*rows.columns, *names)


def at_ranks(rows: DataFrame, keys: list[str], value: str, ranks: dict[str, Column], hot: int = HOT) -> DataFrame:
    """Per key ``n`` non-null values and, under each name, the value at the rank (from 0) that a function of ``n`` gives."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    upto = running(counted, keys, value, {"_upto": F.col("_c")}, hot=hot)
    n = counted.groupBy(*keys).agg(F.sum("_c").alias("n"))
    both = upto.join(n, keys) if keys else upto.crossJoin(F.broadcast(n))
    held = lambda rank: F.max(F.when((F.col("_upto") > rank) & (F.col("_upto") - F.col("_c") <= rank), F.col(value)))
    return both.groupBy(*keys).agg(F.max("n").alias("n"), *[held(r).alias(k) for k, r in ranks.items()])
