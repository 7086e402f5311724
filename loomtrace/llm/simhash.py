"""SimHash near-duplicates: 64-bit fingerprints of 3-word shingles, joined by a binary trie.

Fingerprints. Words of the ASCII-lower-cased text, 3-word shingles with repeats, XXH64 with seed 42;
a bit is set if over half of the shingles set it.

Join. Distinct fingerprints form a binary trie; pairs of nodes are traversed together, differing bits
accumulate, and a pair of nodes is left as soon as they exceed ``ERRORS``. To deal the trie out, three
rotations of the bits are used: of at most two errors, one of three blocks of bits has none, so every
link lies below one node of a rotation's trie at that block's depth, and that node is the unit of
work (for another budget, of ``errors`` + 1 blocks). A node with more than ``HOT`` fingerprints is first opened by ``STEP`` more bits into pairs of
children within the error budget, again and again, so no task gets a large node whole. Rows carry
fingerprints only; equal ones are one row. A fingerprint has at most 2080 neighbours within two bits,
and each unit returns a spanning forest of its links, not all of them; forests keep every connection.

Defined results: null texts count as empty; texts without words have fingerprint 0 and link like any
other; fewer than three words are one shingle; very long texts cost time and memory in proportion to
their length; repeated rows repeat; a null id never names a component unless no other id is there; an
empty table gives an empty table; further columns are ignored (``components``) or kept (``keep_one``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.llm.common import checkpointed, map_slices
from loomtrace.llm.components import first_of_each, stars

ERRORS, BITS = 2, 64
WORDS = 3
HOT, STEP = 4096, 4
#: Rows that a worker joins at once, and the size of a node pair that is compared directly.
CHUNK, DIRECT = 100_000, 64


def blocks(errors: int) -> list[tuple[int, int]]:
    """(rotation, depth) of the tries: of at most ``errors`` differing bits, one of these blocks has none."""
    cuts = [BITS * k // (errors + 1) for k in range(errors + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def shingle_hashes(text: str | None) -> list[int]:
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()  # bytes: A-Z only, and ASCII white space
    if not words:
        return []
    data = b" ".join(words)
    if len(words) < WORDS:
        return [xxh64_intdigest(data, 42)]
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-WORDS]])
    return [xxh64_intdigest(data[a:b], 42) for a, b in zip(starts.tolist(), (ends[WORDS - 1 :] - 1).tolist())]


def fingerprint_all(texts: list[str | None]) -> np.ndarray:
    """Unsigned fingerprints."""
    out = np.zeros(len(texts), np.uint64)
    for k, t in enumerate(texts):
        h = shingle_hashes(t)
        if h:
            out[k] = majority(np.array(h, "<u8"))
    return out


def majority(h: np.ndarray) -> np.uint64:
    """The bits that over half of the hashes set."""
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > len(h), bitorder="little").view("<u8")[0]


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def task():
        return lambda p: pa.RecordBatch.from_arrays([p.column("doc_id"), pa.array(fingerprint_all(p.column("text").to_pylist()).view(np.int64), pa.int64())], names=["doc_id", "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return map_slices(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), task, f"doc_id {kind}, fp long")


# ---- the trie inside a worker -----------------------------------------------------------------


def _middle(values: np.ndarray, low: np.ndarray, high: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """First place in [low, high) whose bit is set; values are sorted there and equal above the bit."""
    low, high = low.copy(), high.copy()
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        mid = (low[open_] + high[open_]) >> 1
        one = (values[mid] >> shift[open_]) & np.uint64(1) == 1
        high[open_[one]] = mid[one]
        low[open_[~one]] = mid[~one] + 1


def trie_pairs(values: np.ndarray, nodes: np.ndarray, errors: int = ERRORS) -> np.ndarray:
    """Places (i, j) of values within ``errors`` bits below the given node pairs.

    nodes: rows (a_low, a_high, b_low, b_high, depth, errors so far); a node paired with itself has
    equal ranges. Values are unsigned and sorted within each range.
    """
    found = []
    while len(nodes):
        a0, a1, b0, b1, depth, used = nodes.T
        self_ = a0 == b0
        work = (a1 - a0) * (b1 - b0)
        leaf = (work <= DIRECT) | (depth >= BITS)
        if leaf.any():
            x0, x1, y0, y1 = (c[leaf] for c in (a0, a1, b0, b1))
            n = (x1 - x0) * (y1 - y0)
            which = np.repeat(np.arange(len(n)), n)
            k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            wide = (y1 - y0)[which]
            i, j = x0[which] + k // np.maximum(wide, 1), y0[which] + k % np.maximum(wide, 1)
            near = np.bitwise_count(values[i] ^ values[j]) <= errors
            near &= (i < j) | ~self_[leaf][which]
            found.append(np.stack([i[near], j[near]], axis=1))
        a0, a1, b0, b1, depth, used, self_ = (c[~leaf] for c in (a0, a1, b0, b1, depth, used, self_))
        shift = (BITS - 1 - depth).astype(np.uint64)
        am, bm = _middle(values, a0, a1, shift), _middle(values, b0, b1, shift)
        children = [(a0, am, b0, bm, 0, True), (am, a1, bm, b1, 0, True), (a0, am, bm, b1, 1, True), (am, a1, b0, bm, 1, ~self_)]
        parts = []
        for c0, c1, d0, d1, differ, ok in children:
            good = (c1 > c0) & (d1 > d0) & (used + differ <= errors) & ok
            good &= ~((c0 == d0) & (c1 - c0 < 2))
            parts.append(np.stack([c0, c1, d0, d1, depth + 1, used + differ], axis=1)[good])
        nodes = np.concatenate(parts) if parts else np.zeros((0, 6), np.int64)
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def forest(pairs: np.ndarray) -> list[tuple[int, int]]:
    """(place, smallest place linked to it) for places that have links to smaller ones."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := root.get(x, x)) != x:
            root[x] = root.get(y, y)
            x = y
        return x

    for i, j in pairs.tolist():
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            root.setdefault(min(a, b), min(a, b))
    return [(x, find(x)) for x in list(root) if find(x) != x]


def _join_units(unit: np.ndarray, side: np.ndarray, depth: np.ndarray, used: np.ndarray, values: np.ndarray, errors: int = ERRORS) -> np.ndarray:
    """Forest edges (place, place) of whole units given in the order of unit, side, value."""
    first = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
    last = np.concatenate([first[1:], [len(unit)]])
    split = np.array([a + int(np.searchsorted(side[a:b], 1)) for a, b in zip(first.tolist(), last.tolist())]) if side.any() else last
    one = split == last  # a node with itself; a pair's first side may be missing
    cross = ~one & (split > first)
    own = one & (last - first > 1) & (side[first] == 0)
    nodes = np.concatenate([np.stack([first[own], last[own], first[own], last[own], depth[first[own]], used[first[own]]], axis=1), np.stack([first[cross], split[cross], split[cross], last[cross], depth[first[cross]], used[first[cross]]], axis=1)])
    return np.array(forest(trie_pairs(values, nodes, errors)), np.int64).reshape(-1, 2)


def _edges(units: DataFrame, errors: int) -> DataFrame:
    """(a, b) forest edges from rows (rotation, depth, na, nb, self, used, side, v) of units."""

    def run(batches):
        def joined(t: pa.Table) -> pa.RecordBatch:
            col = lambda c: t.column(c).to_numpy()
            rotation, na, nb, self_ = col("rotation"), col("na"), col("nb"), col("own")
            depth, side, used = col("depth").astype(np.int64), col("side").astype(np.int64), col("used").astype(np.int64)
            new = np.concatenate([[True], (rotation[1:] != rotation[:-1]) | (depth[1:] != depth[:-1]) | (na[1:] != na[:-1]) | (nb[1:] != nb[:-1])])
            unit = np.cumsum(new)
            values = col("v").view(np.uint64)
            # a unit that pairs a node with itself has one side only; of two different nodes with a side missing nothing is linked
            lone = ~self_
            keep = np.ones(len(unit), bool)
            if lone.any():
                n = np.bincount(unit)
                n1 = np.bincount(unit, side)
                keep = self_ | ((n1 > 0) & (n1 < n))[unit]
            unit, side, depth, used, values, rotation = (x[keep] for x in (unit, side, depth, used, values, rotation))
            if not len(unit):
                return None
            pairs = _join_units(unit, side, depth, used, values, errors)
            turn = rotation.astype(np.uint64)[pairs[:, 0]]
            back = [((values[pairs[:, k]] >> turn) | (values[pairs[:, k]] << ((np.uint64(64) - turn) & np.uint64(63)))).view(np.int64) for k in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in back], names=["a", "b"])

        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= CHUNK:
                t = pa.Table.from_batches(held).combine_chunks()
                keys = [t.column(c).to_numpy() for c in ("rotation", "depth", "na", "nb")]
                differ = np.zeros(t.num_rows - 1, bool)
                for k in keys:
                    differ |= k[1:] != k[:-1]
                at = int(np.flatnonzero(differ)[-1]) + 1 if differ.any() else 0  # the last unit may go on
                if at and (out := joined(t.slice(0, at))):
                    yield out
                rest = t.slice(at)
                held, rows = rest.to_batches(), rest.num_rows
        if held and (out := joined(pa.Table.from_batches(held).combine_chunks())):
            yield out

    keys = ["rotation", "depth", "na", "nb"]
    return units.repartition(*keys).sortWithinPartitions(*keys, "side", _unsigned("v")).mapInArrow(run, "a long, b long")


def _unsigned(c: str):
    """An order of longs as unsigned."""
    return F.col(c).bitwiseXOR(F.lit(-(2**63)))


def _open(hot: DataFrame, errors: int) -> DataFrame:
    """Rows of hot units dealt to the pairs of children, STEP bits deeper, within the error budget."""
    n = 1 << STEP
    child = F.expr(f"cast(shiftrightunsigned(v, {BITS - STEP} - depth) & {n - 1} as bigint)")
    opened = hot.withColumn("c", child).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("o", F.col("o").cast("long"))
    opened = opened.withColumn("more", F.bit_count(F.col("c").bitwiseXOR(F.col("o")))).where(F.col("used") + F.col("more") <= errors)
    own, first = F.col("own"), F.col("side") == 0
    low, high = F.least("c", "o"), F.greatest("c", "o")
    return opened.select(
        "rotation",
        (F.col("depth") + STEP).alias("depth"),
        (F.col("na") * n + F.when(own, low).when(first, F.col("c")).otherwise(F.col("o"))).alias("na"),
        (F.col("nb") * n + F.when(own, high).when(first, F.col("o")).otherwise(F.col("c"))).alias("nb"),
        (own & (F.col("c") == F.col("o"))).alias("own"),
        (F.col("used") + F.col("more")).cast("int").alias("used"),
        F.when(own, (F.col("c") > F.col("o")).cast("int")).otherwise(F.col("side")).alias("side"),
        "v",
    )


def links(distinct_fps: DataFrame, hot: int = HOT, errors: int = ERRORS) -> DataFrame:
    """Forest edges (a, b) between the distinct fingerprints of column fp that differ in at most ``errors`` bits."""
    turned = [F.struct(F.lit(r).alias("rotation"), F.lit(d).alias("depth"), (F.shiftleft("fp", r).bitwiseOR(F.shiftrightunsigned("fp", 64 - r)) if r else F.col("fp")).alias("v")) for r, d in blocks(errors)]
    rows = distinct_fps.select(F.explode(F.array(*turned)).alias("x")).select("x.*")
    node = F.expr("shiftrightunsigned(v, 64 - depth)")
    rows = rows.select("rotation", "depth", node.alias("na"), node.alias("nb"), F.lit(True).alias("own"), F.lit(0).alias("used"), F.lit(0).alias("side"), "v")
    keys, done = ["rotation", "depth", "na", "nb"], []
    while True:
        sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        large = checkpointed(sizes.where((F.col("n") > hot) & (F.col("depth") + STEP <= 60)).select(*keys))
        if large.isEmpty():
            break
        done.append(rows.join(large, keys, "left_anti"))
        rows = checkpointed(_open(rows.join(large, keys, "left_semi"), errors))
    for part in done:
        rows = rows.unionByName(part)
    return _edges(rows, errors)


def components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest id reachable."""
    fps = checkpointed(fingerprints(df, id_col, text_col))
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = stars(links(classes.select("fp"), hot)).select(F.col("a").alias("k"), F.col("b").alias("root"))
    rooted = classes.join(roots, F.col("fp") == F.col("k"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = checkpointed(rooted)
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = rooted.join(named, "root").select(F.col("fp").alias("k"), "component_id")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return fps.join(of_fp, F.col("fp") == F.col("k")).select("doc_id", hexed.alias("fingerprint"), "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """The row of least id, and of its texts of least hash, of every component of rows with an id; rows without one stay."""
    return first_of_each(df, lambda own: components(own, hot=hot), id_col, text_col)
