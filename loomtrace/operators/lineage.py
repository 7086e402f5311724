"""Parent chains, event-sourced registries and checkpoints."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.shared import written

#: Rows up to which what is left of the chains is doubled.
FEW = 50_000


def _cut(df: DataFrame) -> DataFrame:
    # a checkpoint would keep what is inferred of its rows, and that doubles with every self-join
    return written(df, "lineage")


def _doubled(own: DataFrame) -> tuple[DataFrame, bool]:
    """(id, at, depth) with pointers doubled until none moves, and whether some still do after as many hops as rows. A pointer out of the table rests."""
    own, step = _cut(own), 1
    most = own.count()
    while True:
        hop = own.select(F.col("id").alias("h"), F.col("at").alias("to"), F.col("depth").alias("more"))
        moved = F.coalesce(F.col("to") != F.col("at"), F.lit(False))
        next_ = own.join(hop, F.col("at") == F.col("h"), "left").select("id", F.coalesce("to", "at").alias("at"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), moved.alias("moved"))
        next_, step = _cut(next_), 2 * step
        own = next_.drop("moved")
        if next_.where("moved").isEmpty():
            return own, False
        if step > 2 * most:  # a chain has come to rest by now
            return own, True


def _heads(node: str, level: int) -> Column:
    """The level's coin of a node."""
    return F.xxhash64(F.lit(level), F.col(node)) % 2 == 0


def _contracted(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, at, depth) with every pointer at its end, and (c): the ends that are no roots but nodes of a cycle.

    A level sets nodes aside that point to themselves, and those with tails up whose parent has heads: pointers
    to them skip them. A quarter of the rest goes at each level, so all levels together hold four times
    the rows, however long the chains are. What is left below ``FEW`` is doubled; then each level's nodes look
    up where their parents have come to.
    """
    spark, levels, rest = own.sparkSession, [own], own.count()
    while rest > FEW or len(levels) == 1:
        k, rows = len(levels) - 1, levels[-1]
        aside = _aside(k)
        gone = rows.where(aside & (F.col("at") != F.col("id"))).select(F.col("id").alias("g"), F.col("at").alias("to"), F.col("depth").alias("more"))
        stay = rows.where(~aside)
        # a parent with heads up is not skipped
        held, led = stay.where(_heads("at", k)), stay.where(~_heads("at", k)).join(gone, F.col("at") == F.col("g"), "left")
        led = led.select("id", F.coalesce("to", "at").alias("at"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        levels.append(_cut(held.unionByName(led)))
        rest = levels[-1].count()
    last, _ = _doubled(levels[-1])
    # the last rows have no roots among them, so an end among them is on a cycle; so are nodes that lead to themselves after some steps
    rings = [last.select(F.col("at").alias("c")).join(last.select(F.col("id").alias("c")), "c", "left_semi")]
    done = last
    for k in range(len(levels) - 2, -1, -1):
        loop = F.col("id") == F.col("at")
        gone = levels[k].where(_aside(k))
        rings.append(gone.where(loop & (F.col("depth") > 0)).select(F.col("id").alias("c")))
        to = done.where(_heads("id", k)).select(F.col("id").alias("h"), F.col("at").alias("to"), F.col("depth").alias("more"))
        led = gone.where(~loop).join(to, F.col("at") == F.col("h"), "left").select("id", F.coalesce("to", "at").alias("at"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        done = done.unionByName(_cut(gone.where(loop).unionByName(led)))
    return done, _cut(functools.reduce(DataFrame.unionByName, rings).distinct())


def _aside(level: int) -> Column:
    return (F.col("id") == F.col("at")) | (~_heads("id", level) & _heads("at", level))


def roots(nodes: DataFrame, id_col: str, parent_col: str) -> DataFrame:
    """(id, root, depth): the last ancestor present in the table, by contraction of the chains.

    What is moved grows with the rows alone, not with the chains' length. A chain into a cycle ends before the
    first node that it would visit again; only the nodes that lead into a cycle double their pointers, with a join of
    them all for each doubling. Each level is written to the shared folder and read from there. Rows of one id are one
    node; of several parents it has the least.
    """
    rows = nodes.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(parent_col).alias("p"))
    known = rows.select(F.col("id").alias("k"))
    none = F.col("k").isNull() | (F.col("p") == F.col("id"))
    own = _cut(rows.join(known, F.col("p") == F.col("k"), "left").select("id", F.coalesce("k", "id").alias("at"), F.when(none, 0).otherwise(1).cast("long").alias("depth")))
    ends, rings = _contracted(own)
    ends = ends.select("id", F.col("at").alias("root"), F.col("depth").cast("int").alias("depth"))
    if rings.isEmpty():
        return ends
    lost = _cut(ends.join(rings, F.col("root") == F.col("c"), "left_semi").select("id"))
    return ends.join(rings, F.col("root") == F.col("c"), "left_anti").unionByName(_into_cycles(own.join(lost, "id", "left_semi")))


def _into_cycles(own: DataFrame) -> DataFrame:
    """(id, root, depth) of nodes that all lead into a cycle."""
    own = _cut(own)
    # as many hops as rows end on a cycle, and on each of its nodes if begun there
    ends, step, most = own.select("id", "at"), 1, own.count()
    while step < most:
        hop = ends.select(F.col("id").alias("h"), F.col("at").alias("to"))
        ends, step = _cut(ends.join(hop, F.col("at") == F.col("h")).select("id", F.col("to").alias("at"))), 2 * step
    ring = _cut(ends.select(F.col("at").alias("c")).distinct())
    turn = own.join(ring, F.col("id") == F.col("c")).select("id", F.col("at").alias("p"))
    least, step, most = turn.select("id", F.col("p").alias("at"), F.least("id", "p").alias("least")), 1, ring.count()
    while step < most:
        hop = least.select(F.col("id").alias("h"), F.col("at").alias("to"), F.col("least").alias("other"))
        least, step = _cut(least.join(hop, F.col("at") == F.col("h")).select("id", F.col("to").alias("at"), F.least("least", "other").alias("least"))), 2 * step
    length = least.groupBy("least").agg(F.count(F.lit(1)).alias("n"))
    last = least.join(length, "least").join(turn.select(F.col("id").alias("before"), F.col("p").alias("e")), F.col("id") == F.col("e")).select("e", "before", "n")
    # up to the first node on a cycle, then once around it
    opened = own.join(ring, F.col("id") == F.col("c"), "left").select("id", F.when(F.col("c").isNull(), F.col("at")).otherwise(F.col("id")).alias("at"), F.when(F.col("c").isNull(), F.col("depth")).otherwise(0).alias("depth"))
    ends, _ = _contracted(_cut(opened))
    return ends.join(last, F.col("at") == F.col("e")).select("id", F.col("before").alias("root"), (F.col("depth") + F.col("n") - 1).cast("int").alias("depth"))


def current(events: DataFrame, id_col: str = "id", event_col: str = "event", order: str = "seq") -> DataFrame:
    """The live entries of a register/remove/rollback log: each id's last event, unless it removes."""
    rest = [c for c in events.columns if c not in (id_col, order)]
    last = events.groupBy(id_col).agg(F.max_by(F.struct(order, *rest), order).alias("r")).select(id_col, "r.*")
    return last.where(F.col(event_col) != "remove")


def mismatch(log: DataFrame, index: DataFrame, id_col: str = "id") -> DataFrame:
    """Ids that only the log or only the index has."""
    both = log.select(id_col, F.lit(True).alias("in_log")).join(index.select(id_col, F.lit(True).alias("in_index")), id_col, "full_outer")
    return both.where("in_log is null or in_index is null").na.fill(False, ["in_log", "in_index"])


def insert_absent(entries: DataFrame, table: DataFrame, id_col: str) -> DataFrame:
    """The table with entries whose id it lacks."""
    return table.unionByName(entries.join(table.select(id_col), id_col, "left_anti").dropDuplicates([id_col]), allowMissingColumns=True)


def verified(entries: DataFrame, files: DataFrame) -> DataFrame:
    """entries (id, path, digest) against files (path, content): ok and a message."""
    actual = files.select("path", F.sha2("content", 256).alias("actual"))
    rows = entries.join(actual, "path", "left")
    message = F.when(F.col("actual").isNull(), "MISSING").when(F.col("actual") == F.col("digest"), "OK").otherwise("DRIFT")
    return rows.select("id", (message == "OK").alias("ok"), message.alias("message"))
