"""Near copies by similarity: components of texts whose five-word shingles have a Jaccard of at least 0.8.

Words are those of operator 7 (white-space runs of the ASCII-lower-cased text); fewer than five words
are one shingle, so short texts link only to equal ones. Texts are nodes by a 64-bit hash, so exact
copies are one node. Links are found three times, and each is verified on the words themselves:

1. Operator 7's trie self-join of SimHash fingerprints, here over the five-word shingles and with up to
   ``ERRORS`` differing bits, links the closest copies.
2. Min-hash bands link every text to the first of its bucket and to the one before it, in an order of the
   bucket's own. That is linear in the texts and joins the members of large groups. Copies at a Jaccard of
   0.8 differ in some ten of 64 bits, beyond any budget that a trie can traverse, so both miss pairs.
   Sizes and bitmaps, of which no more bits differ than shingles, reject pairs before texts move; of the
   rest each text's likeliest partner comes first, and then only pairs that are not yet in one component.
3. A prefix filter finds every pair that is left. In one global order of the shingles, two sets of
   Jaccard t share one of the first n - ceil(t n) + 1 of each, so a join of those prefixes misses none;
   sizes, places in the prefix and bitmaps reject most pairs, and those already in one component are left out.

The order puts shingles of many texts last, by a table of the counts of all texts' shingles, hashed to
``COUNTERS`` places; any order is complete, so what the table mixes up costs time and never a pair. Copies
that a task meets again are passed over, as their node is there already.

Defined results: null texts count as empty; texts without words are copies of each other; very long texts
cost time and memory in proportion to their length; repeated rows and rows of one id with equal texts are
one (``keep_one``), rows of one id with other texts are not; rows without an id stay and link nothing
(``keep_one``); an empty table gives an empty table; further columns are ignored or kept as said.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtrace.llm.common import checkpointed, map_slices, released, removed, scratch, slices
from loomtrace.llm.components import first_of_each, stars
from loomtrace.llm.simhash import links, majority

WORDS, TABLE, ERRORS = 5, 300_000, 3
BANDS, ROWS, BITS = 16, 3, 512
#: Places of the counts, places of a block of them, and texts by which a task knows copies before it begins anew.
COUNTERS, BLOCK, KNOWN = 1 << 24, 1 << 16, 100_000
#: Nodes of pairs up to which they are broadcast to the texts.
BROADCAST = 2_000_000
_RNG = np.random.default_rng(5)
_PLACE = _RNG.integers(1, 1 << 63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _RNG.integers(1, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


class Hashes(dict):
    """word -> 64 bits."""

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        h = xxh64_intdigest(word, 42)
        if len(self) < TABLE:
            self[word] = h
        return h


def _scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def shingle_hashes(text: str | None, hashes: Hashes) -> np.ndarray:
    """Distinct hashes of the shingles, ascending; never none."""
    w = words(text)
    h = np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w))
    n = max(1, len(w) - WORDS + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(WORDS, len(w))):
        out += h[k : k + n] * _PLACE[k]
    return np.unique(_scramble(out))


@lru_cache(maxsize=16)
def shingles(text: str | None) -> set[tuple[bytes, ...]]:
    w = words(text)
    return set(zip(*(w[k:] for k in range(WORDS)))) if len(w) >= WORDS else {tuple(w)}


def near(a: str | None, b: str | None) -> bool:
    """Jaccard >= 0.8, in integers."""
    s, t = shingles(a), shingles(b)
    both = len(s & t)
    return 5 * both >= 4 * (len(s) + len(t) - both)


def bands(h: np.ndarray) -> np.ndarray:
    least = np.array([_scramble(h * m).min() for m in _MIX]).reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = _scramble(key * np.uint64(31) + least[:, k])
    return key


def bitmap(h: np.ndarray) -> np.ndarray:
    """Whether an odd number of shingles falls on each of ``BITS`` places, as longs."""
    odd = np.bincount((h & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def prefix(h: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The shingles of which a text of Jaccard >= 0.8 must share one, rare ones first."""
    n = len(h)
    order = np.lexsort((h, weight[(h & np.uint64(COUNTERS - 1)).astype(np.int64)]))
    return h[order[: n + (-4 * n) // 5 + 1]]


def fresh(p: pa.RecordBatch, known: set[int]) -> pa.RecordBatch:
    """The rows whose node is not in ``known``, which takes it in; so a large group of copies is a row a task."""
    if len(known) > KNOWN:
        known.clear()
    keep = []
    for node in p.column("node").to_pylist():
        keep.append(node not in known)
        known.add(node)
    return p.filter(pa.array(keep, pa.bool_()))


def counts(nodes: DataFrame) -> np.ndarray:
    """Four times the binary logarithm of the count at each place.

    Each task sends the places it met, a block at a time, as packed distances and counts; blocks are added
    up where they meet. The driver receives one byte a place, whatever the input's size.
    """

    def partial(batches):
        held, hashes, known = np.zeros(COUNTERS, np.uint32), Hashes(), set()
        for p in slices(batches, "text"):
            for t in fresh(p, known).column("text").to_pylist():
                held[(shingle_hashes(t, hashes) & np.uint64(COUNTERS - 1)).astype(np.int64)] += 1
        for k in range(COUNTERS // BLOCK):
            own = held[k * BLOCK : (k + 1) * BLOCK]
            at = np.flatnonzero(own)
            if len(at):
                data = zlib.compress(np.diff(at, prepend=0).astype("<u2").tobytes() + own[at].astype("<u4").tobytes(), 1)
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([data], pa.binary())], names=["block", "data"])

    def added(batches):
        held: dict[int, np.ndarray] = {}
        for p in batches:
            for k, data in zip(p.column("block").to_pylist(), p.column("data").to_pylist(), strict=True):
                data = zlib.decompress(data)
                n = len(data) // 6
                total = held.setdefault(k, np.zeros(BLOCK, np.int64))
                total[np.cumsum(np.frombuffer(data, "<u2", n), dtype=np.int64)] += np.frombuffer(data, "<u4", n, 2 * n)
        for k, total in held.items():
            data = zlib.compress(np.rint(4 * np.log2(1 + total)).astype(np.uint8).tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([data], pa.binary())], names=["block", "data"])

    schema = "block int, data binary"
    weight = np.zeros(COUNTERS, np.uint8)
    for r in nodes.mapInArrow(partial, schema).repartition("block").mapInArrow(added, schema).collect():  # a row a block
        weight[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(zlib.decompress(bytes(r["data"])), np.uint8)
    return weight


def _banded(nodes: DataFrame) -> DataFrame:
    """key, node: a row a band, the text's bitmap, fingerprint and number of shingles in the first."""

    def task():
        hashes, known = Hashes(), set()

        def each(p: pa.RecordBatch) -> pa.RecordBatch:
            p = fresh(p, known)
            keys, bits, fps, sizes = [np.zeros(0, np.uint64)], [], [], []
            for t in p.column("text").to_pylist():
                h = shingle_hashes(t, hashes)
                keys.append(bands(h))
                bits += [bitmap(h), *[None] * (BANDS - 1)]
                fps += [int(majority(h).view(np.int64)), *[None] * (BANDS - 1)]
                sizes += [len(h), *[None] * (BANDS - 1)]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64), pa.int64()), pa.array(np.repeat(p.column("node").to_numpy(), BANDS), pa.int64()), pa.array(bits, pa.list_(pa.int64())), pa.array(fps, pa.int64()), pa.array(sizes, pa.int32())], names=["key", "node", "bits", "fp", "n"])

        return each

    return map_slices(nodes, task, "key long, node long, bits array<bigint>, fp long, n int")


def _prefixes(nodes: DataFrame) -> DataFrame:
    """gram, node, the number of the text's shingles and the gram's place among them."""
    shared = nodes.sparkSession.sparkContext.broadcast(counts(nodes))

    def task():
        weight, hashes, known = shared.value, Hashes(), set()

        def each(p: pa.RecordBatch) -> pa.RecordBatch:
            p = fresh(p, known)
            grams, n, size = [np.zeros(0, np.uint64)], [], []
            for t in p.column("text").to_pylist():
                h = shingle_hashes(t, hashes)
                grams.append(prefix(h, weight))
                n.append(len(h))
                size.append(len(grams[-1]))
            place = np.concatenate([np.zeros(0, np.int64), *(np.arange(k) for k in size)])
            node, n = np.repeat(p.column("node").to_numpy(), size), np.repeat(np.array(n, np.int64), size)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams).view(np.int64), pa.int64()), pa.array(node, pa.int64()), pa.array(n, pa.int32()), pa.array(place, pa.int32())], names=["gram", "node", "n", "place"])

        return each

    return map_slices(nodes, task, "gram long, node long, n int, place int")


def plausible(pairs: DataFrame, banded: DataFrame) -> DataFrame:
    """The pairs (a, b), with all their columns, that sizes and bitmaps don't rule out."""
    pairs = checkpointed(pairs)
    one = _of_pairs(pairs, banded.where("bits is not null").select("node", "n", "bits"))
    side = lambda c: one.select(*[F.col(x).alias(f"{x}_{c}") for x in ("node", "n", "bits")])
    differ = " + ".join(f"bit_count(bits_a[{k}] ^ bits_b[{k}])" for k in range(BITS // 64))
    joined = pairs.join(side("a"), F.col("a") == F.col("node_a")).join(side("b"), F.col("b") == F.col("node_b"))
    return joined.where(f"5 * least(n_a, n_b) >= 4 * greatest(n_a, n_b) and 9 * ({differ}) <= n_a + n_b").select(*pairs.columns)


def _of_pairs(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of the nodes of the pairs (a, b), once each; other rows move only where those nodes are too many to broadcast."""
    wanted = checkpointed(pairs.select(F.col("a").alias("k")).unionByName(pairs.select(F.col("b").alias("k"))).distinct())
    if wanted.count() <= BROADCAST:
        wanted = F.broadcast(wanted)
    return rows.join(wanted, F.col("node") == F.col("k"), "left_semi").dropDuplicates(["node"])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are near copies."""
    sides = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text")), "b")

    def task():
        def each(p: pa.RecordBatch) -> pa.RecordBatch:
            p = p.filter(pa.array([near(x, y) for x, y in zip(p.column("x").to_pylist(), p.column("text").to_pylist(), strict=True)], pa.bool_()))
            return p.select(["a", "b"])

        return each

    return checkpointed(map_slices(sides.select("a", "b", "x", "text"), task, "a long, b long"))


def trie_pairs(banded: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes: those of one fingerprint with its first, and the firsts of linked fingerprints."""
    own = banded.where("fp is not null").select("fp", "node")
    firsts = checkpointed(own.groupBy("fp").agg(F.min("node").alias("first")))
    equal = own.join(firsts, "fp").select(F.col("node").alias("a"), F.col("first").alias("b"))
    side = lambda c: firsts.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_first"))
    linked = links(firsts.select("fp"), errors=ERRORS).join(side("a"), "a").join(side("b"), "b").select(F.col("a_first").alias("a"), F.col("b_first").alias("b"))
    return equal.unionByName(linked).where("a <> b")


def banded_links(nodes: DataFrame, banded: DataFrame) -> DataFrame:
    by = W.partitionBy("key").orderBy(F.xxhash64("key", "node"), "node")
    rows = banded.select("node", F.array(F.first("node").over(by), F.lag("node").over(by)).alias("other"))
    pairs = rows.select(F.col("node").alias("a"), F.explode("other").alias("b"), F.lit(1).alias("k")).where("a <> b").unionByName(trie_pairs(banded).withColumn("k", F.lit(BANDS)))
    pairs = pairs.groupBy(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).agg(F.sum("k").alias("k"))
    pairs = checkpointed(plausible(pairs, banded))
    released(nodes.sparkSession)
    texts, folder = scratch(_of_pairs(pairs, nodes), "texts")
    likeliest = pairs.groupBy("a").agg(F.max_by("b", F.struct("k", "b")).alias("b"))
    found = verified(likeliest, texts)
    found = found.unionByName(verified(apart(pairs.join(likeliest, ["a", "b"], "left_anti").select("a", "b"), stars(found)), texts))
    removed(nodes.sparkSession, folder)
    return found


def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs (a, b) that ``roots`` (a, b) does not hold in one component."""
    root = lambda c: roots.select(F.col("a").alias(f"node_{c}"), F.col("b").alias(f"root_{c}"))
    joined = pairs.join(root("a"), F.col("a") == F.col("node_a"), "left").join(root("b"), F.col("b") == F.col("node_b"), "left")
    return joined.where("coalesce(root_a, a) <> coalesce(root_b, b)").select("a", "b")


def other_links(nodes: DataFrame, banded: DataFrame, roots: DataFrame) -> DataFrame:
    """Links of every pair that ``roots`` (a, b) does not hold in one component."""
    by = W.partitionBy("gram")
    rows = _prefixes(nodes).withColumn("low", F.min("node").over(by)).withColumn("high", F.max("node").over(by)).where("low <> high")
    rows = rows.drop("low", "high").dropDuplicates(["gram", "node"])
    rows = rows.join(roots.select(F.col("a").alias("k"), F.col("b").alias("root")), F.col("node") == F.col("k"), "left").select("gram", "node", "n", "place", F.coalesce("root", "node").alias("root"))
    among = W.partitionBy("gram")
    rows, folder = scratch(rows.withColumn("low", F.min("root").over(among)).withColumn("high", F.max("root").over(among)).where("low <> high").drop("low", "high"), "grams")
    released(nodes.sparkSession)
    a, b = (rows.select("gram", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "place", "root")]) for s in "ab")
    left = "least(n_a - place_a, n_b - place_b)"  # the most that sets can share from this gram on
    pairs = a.join(b, "gram").where(f"node_a < node_b and root_a <> root_b and 5 * least(n_a, n_b) >= 4 * greatest(n_a, n_b) and 9 * ({left}) >= 4 * (n_a + n_b)")
    pairs = checkpointed(plausible(pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct(), banded))
    texts, text_folder = scratch(_of_pairs(pairs, nodes), "texts")
    found = verified(pairs, texts)
    for path in (folder, text_folder):
        removed(nodes.sparkSession, path)
    return found


def components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and component_id, the smallest id among the near copies reachable."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    nodes = df.select(F.xxhash64(text).alias("node"), text.alias("text"))
    banded, folder = scratch(_banded(nodes), "bands")
    roots = stars(banded_links(nodes, banded))
    released(df.sparkSession)
    roots = stars(roots.unionByName(other_links(nodes, banded, roots)))
    removed(df.sparkSession, folder)
    ids = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("node"))
    classes = ids.groupBy("node").agg(F.min("doc_id").alias("least"))
    released(df.sparkSession)
    rooted = checkpointed(classes.join(roots.select(F.col("a").alias("k"), F.col("b").alias("root")), F.col("node") == F.col("k"), "left").select("node", "least", F.coalesce("root", "node").alias("root")))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of_node = rooted.join(named, "root").select(F.col("node").alias("k"), "component_id")
    return ids.join(of_node, F.col("node") == F.col("k")).select("doc_id", "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row of least id, and of its texts of least hash, of every component of rows with an id; rows without one stay."""
    return first_of_each(df, components, id_col, text_col)
