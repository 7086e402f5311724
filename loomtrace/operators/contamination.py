"""Overlap between training and evaluation texts: an exact similarity join on shared n-grams.

A positive Jaccard needs a common n-gram, so an equi-join on hashed grams reaches every pair that can
count; gram sets are only counted, never gathered. The evaluation side is broadcast if its grams are
few (a checked size), else the join shuffles; frequent grams split by AQE's skew join. Word sequences
of few evaluation texts need no join at all (``word_overlaps``).
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loomtrace.functions import text as T
from loomtrace.shared import checkpointed

#: Characters of evaluation texts up to which their grams (fewer than characters, 24 bytes each) are broadcast.
BROADCAST_CHARS = 2_000_000
#: Words of a run by which texts without a common sequence are told.
SEED = 3
#: Letters, numbers and underscores of any script, as ``T.WORD``.
WORDS = re.compile(r"\w+")


def _grams(df: DataFrame, id_col: str, out: str, gram) -> DataFrame:
    """A row a distinct gram: id, row, the number of the text's grams, two hashes. The set is bound once by a lambda."""
    hashed = lambda s: F.transform(s, lambda g: F.struct(F.size(s).alias("n"), F.xxhash64(g).alias("h"), F.crc32(g.cast("binary")).alias("c")))
    numbered = df.select(F.col(id_col).alias(out), F.monotonically_increasing_id().alias(f"{out}_row"), gram.alias("gram"))  # before the explosion, so that it numbers texts
    rows = numbered.select(out, f"{out}_row", F.explode(F.element_at(F.transform(F.array("gram"), hashed), 1)).alias("x"))
    return rows.select(out, f"{out}_row", F.col("x.n").alias(f"{out}_n"), F.col("x.h").alias("_h"), F.col("x.c").alias("_c"))


def overlaps(train: DataFrame, items: DataFrame, train_id: str, item_id: str, gram_of, text_col: str = "text") -> DataFrame:
    """(train, item, jaccard) for every pair of texts with a common gram, once.

    Rows are compared, not ids: a repeated id gives a row for each of its texts.
    """
    gram = gram_of(F.col(text_col))
    a, b = _grams(train, train_id, "train", gram), _grams(items, item_id, "item", gram)
    if (items.agg(F.sum(F.length(text_col))).first()[0] or 0) <= BROADCAST_CHARS:
        b = F.broadcast(b)
    shared = a.join(b, ["_h", "_c"]).groupBy("train_row", "item_row", "train", "item", "train_n", "item_n").agg(F.count(F.lit(1)).alias("shared"))
    return shared.select("train", "item", (F.col("shared") / (F.col("train_n") + F.col("item_n") - F.col("shared"))).alias("jaccard")).distinct()


def word_overlaps(train: DataFrame, items: DataFrame, train_id: str, item_id: str, n: int = 8, text_col: str = "text", normalize: bool = False) -> DataFrame:
    """(train, item, jaccard) of n-word sequences, as ``overlaps`` gives them.

    With few evaluation texts (a checked size) their sequences go to every task as a table, and each
    training text is looked through where it lies: nothing is exploded, joined or shuffled. Every sequence of n
    words holds a run of ``SEED`` words at one of every n - SEED + 1 places, so a text in which no run at
    those places is an evaluation text's goes no further. With more, the join of ``overlaps`` is taken.
    """
    items = items.dropDuplicates([item_id, text_col])
    if (items.agg(F.sum(F.length(text_col))).first()[0] or 0) > BROADCAST_CHARS:
        if normalize:
            train, items = (d.select(i, T.normalize(F.col(text_col)).alias(text_col)) for d, i in ((train, train_id), (items, item_id)))
        return overlaps(train, items, train_id, item_id, lambda t: T.word_ngrams(t, n), text_col)
    word: dict[str, int] = {}
    grams: dict[tuple[int, ...], list[int]] = {}
    ids, sizes, seeds, seed = [], [], set(), min(n, SEED)
    low = F.col(text_col) if normalize else F.lower(text_col)
    clean = (lambda t: (T.normalized(t) or "").lower()) if normalize else (lambda t: t or "")
    for r in items.select(F.col(item_id).alias("i"), low.alias("t")).collect():
        found = WORDS.findall(clean(r["t"]))
        seeds.update(zip(*(found[k:] for k in range(seed))))
        w = [word.setdefault(x, len(word)) for x in found]
        own = set(zip(*(w[k:] for k in range(n))))
        for g in own:
            grams.setdefault(g, []).append(len(ids))
        ids.append(r["i"])
        sizes.append(len(own))
    item_type = to_arrow_type(items.schema[item_id].dataType)
    kind, item_kind = train.schema[train_id].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    shared = train.sparkSession.sparkContext.broadcast((word, grams, ids, sizes, seeds))

    def run(batches):
        word, grams, ids, sizes, seeds = shared.value
        for b in batches:
            rows, found, scores = [], [], []
            for k, text in enumerate(t.as_py() for t in b.column("t")):
                words = WORDS.findall(clean(text))
                if seeds.isdisjoint(zip(*(words[j :: n - seed + 1] for j in range(seed)))):
                    continue
                w = [word.get(x, -1) for x in words]
                met = {g for g in zip(*(w[j:] for j in range(n))) if g in grams}
                if met:
                    total = len(set(zip(*(words[j:] for j in range(n)))))
                    for item, both in Counter(i for g in met for i in grams[g]).items():
                        rows.append(k)
                        found.append(ids[item])
                        scores.append(both / (total + sizes[item] - both))
            names = pa.array(found, item_type)
            yield pa.RecordBatch.from_arrays([b.column("train").take(pa.array(rows, pa.int64())), names, pa.array(scores, pa.float64())], names=["train", "item", "jaccard"])

    return train.select(F.col(train_id).alias("train"), low.alias("t")).mapInArrow(run, f"train {kind}, item {item_kind}, jaccard double").distinct()


def check(train: DataFrame, items: DataFrame, train_id: str, item_id: str, threshold: float = 0.2, n: int = 8, char_threshold: float = 0.7, char_sizes: tuple[int, ...] = (5, 6, 7, 8, 9, 10), normalize: bool = True) -> DataFrame:
    """Flagged training texts: id, best word-gram and character-gram Jaccard, where either reaches its threshold."""
    words = word_overlaps(train, items, train_id, item_id, n, normalize=normalize).groupBy("train").agg(F.max("jaccard").alias("jaccard"))
    best = char_pairs(train, items, train_id, item_id, char_sizes, char_threshold, normalize).groupBy("train").agg(F.max("jaccard").alias("char_jaccard"))
    joined = words.join(best, "train", "full_outer").na.fill(0.0, ["jaccard", "char_jaccard"])
    return joined.where((F.col("jaccard") >= threshold) | (F.col("char_jaccard") >= char_threshold))


#: Counters of the evaluation side's grams; they order grams, and those that count 0 are on that side in no text.
SKETCH = 1 << 20
#: Rows up to which candidate pairs are broadcast to the texts that verify them.
BROADCAST_PAIRS = 500_000
#: Evaluation texts whose hashes a task keeps while it verifies pairs.
HELD = 1000
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def char_grams(text: str | None, sizes: tuple[int, ...], most: dict[int, int] | None = None, known: np.ndarray | None = None, threshold: float = 0.0) -> dict[int, np.ndarray]:
    """Sorted hashes of the distinct substrings of each size of the lower-cased text; a size's hash is the next smaller one's and one more character.

    A size of which the text has more than ``most`` is left out, if its beginning alone tells so, and one of which too
    few substrings are ``known`` to make up the threshold's share, if their number before equals are dropped tells so.
    A text has at most one substring of k characters more than of k + 1, as all others go on by a character.
    """
    text, out = text or "", {}
    if most is not None:
        head = max(most.values(), default=0) * 3 // 2 + 64 + max(sizes)
        if len(text) > head and "\u03a3" not in text[:head]:  # the lower case of that letter depends on what follows
            least = min(sizes)
            if len(_distinct(_rolled(text[:head], (least,))[least])) > max(most.values(), default=0) + max(sizes) - least:
                return {}
    at_least, last = 0, 0
    for k, h in _rolled(text, sizes).items():
        at_least = max(0, at_least - (k - last))
        if known is not None and np.count_nonzero(known[_cell(h, len(known))]) < at_least * threshold - 1e-6:
            last = k
            continue
        bound = len(h) if most is None else most[k] + most[k] // 2 + 64
        if len(h) > bound and len(_distinct(h[:bound])) > most[k]:
            at_least = most[k]
        else:
            out[k] = _distinct(h)
            at_least = len(out[k])
        last = k
    return out


def _rolled(text: str, sizes: tuple[int, ...]) -> dict[int, np.ndarray]:
    """The hashes of all substrings of each size, smaller sizes first."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    rolled, power, out = np.zeros(len(codes), np.uint64), np.uint64(1), {}
    for k in range(1, max(sizes) + 1):
        if len(codes) < k:
            break
        rolled = rolled[: len(codes) - k + 1] + codes[k - 1 :] * power
        power = np.uint64(int(power) * int(_STEP) % (1 << 64))
        if k in sizes:
            h = rolled + np.uint64(k)
            for m in _MIX:
                h ^= h >> np.uint64(31)
                h *= m
            out[k] = h
    return out


def _distinct(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h


def _cell(grams: np.ndarray, counters: int) -> np.ndarray:
    """The counters of hashes, of a power of two."""
    return (grams & np.uint64(counters - 1)).astype(np.int64)


def _same(text: str | None) -> str | None:
    return text


def sketch(items: DataFrame, sizes: tuple[int, ...], text_col: str = "text", clean=_same) -> tuple[np.ndarray, dict[int, int]]:
    """Texts of the evaluation side by each counter of their grams, and the most grams of a text of each size."""

    def run(batches):
        total, most = np.zeros(SKETCH, np.int64), dict.fromkeys(sizes, 0)
        for b in batches:
            for t in b.column(0):
                for k, grams in char_grams(clean(t.as_py()), sizes).items():
                    np.add.at(total, _cell(grams, len(total)), 1)
                    most[k] = max(most[k], len(grams))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([-k for k in sizes] + at.tolist(), pa.int64()), pa.array([most[k] for k in sizes] + total[at].tolist(), pa.int64())], names=["at", "n"])

    found = items.select(text_col).mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"), F.max("n").alias("most")).toArrow()
    counts, most = np.zeros(SKETCH, np.int32), dict.fromkeys(sizes, 0)
    for at, n, top in zip(found["at"].to_pylist(), found["n"].to_pylist(), found["most"].to_pylist(), strict=True):
        if at < 0:
            most[-at] = top
        else:
            counts[at] = min(n, (1 << 31) - 1)
    return counts, most


def _prefixes(df: DataFrame, id_col: str, out: str, sizes: tuple[int, ...], threshold: float, counts, most: dict[int, int] | None, clean) -> DataFrame:
    """A row a gram of a text's prefix that the evaluation side may have: rare grams first, with its place and the text's number of grams.

    With ``most``, texts with too many grams of a size to come near any of the other side give none.
    """
    kind = df.schema[id_col].dataType.simpleString()

    limit = None if most is None else {k: math.floor(m / threshold + 1e-6) for k, m in most.items()}

    def run(batches):
        known = counts.value
        for b in batches:
            rows, parts = [], []
            for i, t in enumerate(b.column("text")):
                for k, grams in char_grams(clean(t.as_py()), sizes, limit, known, threshold).items():
                    n = len(grams)
                    if limit is not None and n > limit[k]:
                        continue
                    keep = n - math.ceil(n * threshold - 1e-9) + 1
                    often = known[_cell(grams, len(known))]
                    if np.count_nonzero(often == 0) >= keep:
                        continue
                    order = np.argsort(often, kind="stable")[:keep]
                    at = np.flatnonzero(often[order])
                    rows += [i] * len(at)
                    parts.append((np.full(len(at), k), np.full(len(at), n), at, grams[order[at]].view(np.int64)))
            columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 4
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(rows, pa.int64())), *[pa.array(c, pa.int64()) for c in columns]], names=[out, "k", f"{out}_n", f"{out}_at", "h"])

    return df.select(F.col(id_col).alias("id"), "text").mapInArrow(run, f"{out} {kind}, k long, {out}_n long, {out}_at long, h long")


def char_pairs(train: DataFrame, items: DataFrame, train_id: str, item_id: str, sizes: tuple[int, ...] = (5, 6, 7, 8, 9, 10), threshold: float = 0.7, normalize: bool = False) -> DataFrame:
    """(train, item, k, jaccard): pairs of texts whose sets of k characters reach the threshold, for each size.

    One pass over each side hashes the grams of all sizes. A Jaccard of t needs a common gram among the first
    n - ceil(t n) + 1 of both sets in one order of all grams: rare ones of the evaluation side first, those
    that it lacks before all. Most training texts have a prefix of such grams alone and go no further; of the
    rest, sizes and places bound what a pair can have in common, and what is left is verified on its texts.
    """
    spark, clean = train.sparkSession, T.normalized if normalize else _same
    counts, most = sketch(items, sizes, clean=clean)
    shared = spark.sparkContext.broadcast(counts)
    a = _prefixes(train, train_id, "train", sizes, threshold, shared, most, clean)
    b = _prefixes(items, item_id, "item", sizes, threshold, shared, None, clean)
    n, m = F.col("train_n"), F.col("item_n")
    reach = 1 + F.least(n - F.col("train_at"), m - F.col("item_at")) - 1 >= (n + m) * (threshold / (1 + threshold)) - 1e-6
    near = a.join(b, ["k", "h"]).where((n >= m * threshold - 1e-6) & (m >= n * threshold - 1e-6) & reach)
    pairs = checkpointed(near.select("train", "item", "k").distinct())
    few = F.broadcast if pairs.count() <= BROADCAST_PAIRS else (lambda df: df)
    kinds = [d.schema[c].dataType.simpleString() for d, c in ((train, train_id), (items, item_id))]

    def exact(batches):
        text, own, others = None, {}, {}
        for batch in batches:
            found = []
            for k, x, y in zip(batch.column("k").to_pylist(), batch.column("a"), batch.column("b"), strict=True):
                x, y = x.as_py(), y.as_py()
                if x != text:  # a text's pairs follow each other
                    text, own = x, char_grams(clean(x), sizes)
                if y not in others:
                    if len(others) >= HELD:
                        others.clear()
                    others[y] = char_grams(clean(y), sizes)
                # by hashes first; so few of a text are equal by chance that the margin holds them
                if _jaccard(own.get(k), others[y].get(k)) < threshold - 0.01:
                    found.append(0.0)
                    continue
                s, t = (_char_set(clean(v), k) for v in (x, y))
                found.append(len(s & t) / len(s | t) if s and t else 0.0)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("train", "item", "k")], pa.array(found, pa.float64())], names=["train", "item", "k", "jaccard"])

    texts = train.select(F.col(train_id).alias("train"), F.col("text").alias("a")).join(few(pairs), "train").join(items.select(F.col(item_id).alias("item"), F.col("text").alias("b")), "item")
    rows = texts.select("train", "item", "k", "a", "b").mapInArrow(exact, f"train {kinds[0]}, item {kinds[1]}, k long, jaccard double")
    return rows.where(F.col("jaccard") >= threshold).distinct()


def _jaccard(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """Of sorted distinct hashes."""
    if a is None or b is None or not len(a) or not len(b):
        return 0.0
    both = np.count_nonzero(a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b)
    return both / (len(a) + len(b) - both)


def _char_set(text: str, k: int) -> set[str]:
    low = text.lower()
    return {low[i : i + k] for i in range(len(low) - k + 1)}
