"""Connected components of an edge table, by alternating large and small stars.

Each round links every node to the smallest node it knows, in joins and minima only, so a hub's
neighbours are never gathered in one row. Rounds are few (about the logarithm of the longest chain)
and each is cut off through the shared folder; nothing but a count and a checksum reaches the driver.

Defined results: edges of a node with itself and repeated edges add nothing; edges with a null end are
left out; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.llm.common import checkpointed, free


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    return both.join(least, F.col("a") == F.col("k")).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    own = least.select("a", F.col("m").alias("b"))
    other = edges.join(least.select(F.col("a").alias("k"), "m"), F.col("a") == F.col("k")).where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return own.unionByName(other).distinct()


def stars(edges: DataFrame) -> DataFrame:
    """(a, b) edges -> (a, b) with b the smallest node of a's component, for every a but that one."""
    now = checkpointed(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        told = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if told == seen:
            return now
        seen = told
        now = checkpointed(_small(_large(now)))


def first_of_each(df: DataFrame, components: Callable[[DataFrame], DataFrame], id_col: str, text_col: str) -> DataFrame:
    """One row of ``df`` of each component, and all rows without an id, with all their columns.

    ``components`` gives (doc_id, component_id) for rows (doc_id, text); it is asked with (id, hash of
    the text) as id, so that one id with several texts loses none of them and a repeated row stays once.
    """
    row = lambda: F.struct(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("node"))
    own = df.where(F.col(id_col).isNotNull()).select(row().alias("doc_id"), F.col(text_col).alias("text"))
    kept = components(own).where(F.col("doc_id") == F.col("component_id")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    own_row, key, n = (free(name, df) for name in ("_row", "_kept", "_n"))
    kept = checkpointed(kept.select(F.col("doc_id").alias(key), F.col("_n").alias(n)))
    columns = [F.col(f"`{c}`") for c in df.columns]
    joined = df.withColumn(own_row, row()).join(kept.hint("shuffle_hash"), F.col(own_row) == F.col(key), "left")
    joined = joined.where(F.col(key).isNotNull() | F.col(id_col).isNull())
    if kept.where(F.col(n) > 1).isEmpty():
        return joined.select(*columns)
    again = joined.where(F.col(n) > 1).dropDuplicates([own_row])
    return joined.where(F.col(n).isNull() | (F.col(n) == 1)).unionByName(again).select(*columns)
