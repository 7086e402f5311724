"""Fixed-capacity shards by best-fit-decreasing bin packing of indivisible groups.

Method. Groups (equal texts) enter shards by decreasing size, each the tightest remaining capacity
that holds it, found in a balanced tree; ``pack`` opens as few shards of a given capacity as that
needs, ``level`` finds by bisection the least capacity for which a given number of shards suffices,
so that their sizes come out near equal. A group above the level gets a shard of its own.

Scale. Groups of one size are interchangeable, so the tree walks a histogram of group sizes, not the
groups: a shard takes as many of a size as fit at once. Distinct sizes are at most about the square
root of twice the total size; the plan has a few runs a size. Rows then look their shard up by their
group's size and rank in it; ranks and slots are numbered through salted counts, so neither a
frequent size nor a large shard meets in one task.

Defined results: a null text has no bytes and equals other null texts only; empty texts are one group
too; repeated rows belong to their text's group and get a slot each; ties in size are settled by the
text's hash; a very long text is one group of its size, above the level a shard of its own; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.llm.common import checkpointed, numbered, salts_for

SHARDS, OVERHEAD = 40, 16


class _Tree:
    """A treap of (remaining capacity, shard): balanced by random priorities."""

    def __init__(self, seed: int = 1):
        self.root, self.state = None, seed

    def _priority(self) -> int:
        self.state = (self.state * 6364136223846793005 + 1442695040888963407) & ((1 << 64) - 1)
        return self.state >> 33

    @staticmethod
    def _split(node, key):
        """Nodes below key, nodes from key on. A node is [key, priority, left, right]."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], right = _Tree._split(node[3], key)
            return node, right
        left, node[2] = _Tree._split(node[2], key)
        return left, node

    @staticmethod
    def _merge(a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = _Tree._merge(a[3], b)
            return a
        b[2] = _Tree._merge(a, b[2])
        return b

    def add(self, remaining: int, shard: int) -> None:
        left, right = self._split(self.root, (remaining, shard))
        self.root = self._merge(self._merge(left, [(remaining, shard), self._priority(), None, None]), right)

    def tightest(self, size: int) -> tuple[int, int] | None:
        """Take out the least remaining capacity that holds ``size``."""
        left, right = self._split(self.root, (size, -1))
        if right is None:
            self.root = left
            return None
        path, node = None, right
        while node[2] is not None:
            path, node = node, node[2]
        if path is None:
            right = node[3]
        else:
            path[2] = node[3]
        self.root = self._merge(left, right)
        return node[0]


Run = tuple[int, int, int, int]  # size, first rank, how many, shard


def pack(histogram: dict[int, int], capacity: int, most: int | None = None) -> tuple[list[Run], int] | None:
    """Best fit, decreasing sizes, into shards of ``capacity``: runs of equal groups, and the shards used.

    None if more than ``most`` shards would be needed, or a group exceeds the capacity.
    """
    tree, shards, runs = _Tree(), 0, []
    for size in sorted(histogram, reverse=True):
        if size > capacity:
            return None
        left, rank = histogram[size], 0
        while left:
            if (found := tree.tightest(size)) is None:
                if shards == most:
                    return None
                found, shards = (capacity, shards), shards + 1
            remaining, shard = found
            n = min(left, remaining // size if size else left)
            runs.append((size, rank, n, shard))
            tree.add(remaining - n * size, shard)
            left, rank = left - n, rank + n
    return runs, shards


def level(histogram: dict[int, int], shards: int) -> list[Run]:
    """Runs for exactly numbered shards of near-equal sizes: the least capacity that needs no more."""
    rest, own = dict(histogram), []
    total = sum(s * n for s, n in rest.items())
    while len(own) < shards - 1 and rest and max(rest) * (shards - len(own)) > total:
        size = max(rest)
        own.append((size, histogram[size] - rest[size], 1, len(own)))
        total -= size
        rest[size] -= 1
        if not rest[size]:
            del rest[size]
    if not rest:
        return own
    free = shards - len(own)
    low, high = max(max(rest), -(-total // free)), 2 * max(max(rest), -(-total // free))
    while (best := pack(rest, high, free)) is None:
        high *= 2
    while low < high:
        mid = (low + high) // 2
        if found := pack(rest, mid, free):
            best, high = found, mid
        else:
            low = mid + 1
    return own + [(size, rank + histogram[size] - rest[size], n, shard + len(own)) for size, rank, n, shard in best[0]]


def _placed(groups: DataFrame, runs: list[Run]) -> DataFrame:
    """Adds shard to groups (size, _rank, ...) by binary search in the runs."""
    names = groups.columns
    runs = sorted(runs)
    size, rank, shard = (np.array([r[k] for r in runs], np.int64) for k in (0, 1, 3))

    def run(batches):
        first = np.flatnonzero(np.concatenate([[True], size[1:] != size[:-1]])) if len(size) else np.zeros(0, np.int64)
        sizes, longest = size[first], int(rank.max()) + 1 if len(rank) else 1
        keys = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(size)))) * np.int64(longest) + rank
        for b in batches:
            s, r = b.column("size").to_numpy(), b.column("_rank").to_numpy()
            at = np.searchsorted(keys, np.searchsorted(sizes, s) * np.int64(longest) + np.minimum(r, longest - 1), "right") - 1
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(shard[at], pa.int32())], names=[*names, "shard"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in groups.schema.fields)
    return groups.mapInArrow(run, f"{kinds}, shard int")


def shard(df: DataFrame, shards: int | None = SHARDS, capacity: int | None = None, id_col: str = "doc_id", text_col: str = "text", overhead: int = OVERHEAD) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every row.

    Give ``capacity`` for as few shards of that size as best fit needs, else ``shards`` for near-equal ones.
    """
    text: Column = F.col(text_col)
    rows = df.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.when(text.isNull(), F.lit("-")).otherwise(F.sha2(text, 256)).alias("_key"),
    )
    rows = checkpointed(rows)
    groups = rows.groupBy("_key").agg(F.sum("size").alias("size"))
    histogram = {r["size"]: r["n"] for r in groups.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    if capacity is not None:
        found = pack(histogram, capacity)
        if found is None:
            raise ValueError("a group exceeds the capacity")
        runs = found[0]
    else:
        runs = level(histogram, shards)
    salts = salts_for(max(histogram.values(), default=0))
    placed = _placed(numbered(groups.select("_key", "size"), ["size"], ["_key"], "_rank", salts), runs).select(F.col("_key").alias("_k"), "shard")
    joined = rows.join(placed, F.col("_key") == F.col("_k")).select("doc_id", "size", "text_crc32", "_key", "shard")
    return numbered(joined, ["shard"], ["doc_id", "_key"], "slot", salts_for(rows.count(), 256)).select("doc_id", "size", "text_crc32", "shard", "slot")
