"""Filter interaction audit: what each filter of a chain removes, in every order the chain could have.

Method. One scan of the Arrow buffers, in windows of bounded size: a table of byte classes marks word
bytes, capitals, symbols and continuation bytes; prefix sums read at the texts' offsets count them. Prefix
sums of a polynomial over the bytes hash all words at once; each document's hashes are sorted, neighbours
with equal hashes are verified byte by byte, and a document with a collision is counted word by word.
Failures become a bit mask, and rows of equal text, part, mask and labels become one row before they are
shuffled, so a text that a third of all documents share is no single task. What is left is at most
2 ** filters counts a part; a product with one constant matrix gives all orders and steps.

Defined results: a null text counts as empty; an empty text has no words and fails only what its counts
fail; a null part is the empty string, and both are one part; "identical to any smaller doc_id's text" needs
two ids that compare: repeated rows of one id don't make each other fail, and rows without an id neither fail
it nor cause it nor have labels. A document is good or toxic if any of its label rows says so. Very long texts cost time in
proportion to their length; tables without rows give no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtrace.llm.common import map_slices

COUNTS = ("n_words", "n_distinct", "n_capitals", "n_symbols", "n_chars")
#: Failure conditions over the counts; E, equal texts, is added by ``masks``.
FILTERS: dict[str, Column | str] = {
    "A": "n_words < 50",
    "B": "100 * n_distinct < 65 * n_words",
    "C": "100 * n_capitals > 5 * n_chars",
    "D": "n_symbols > 0",
}
COPIES = "E"
#: Bytes whose prefix sums are held at once; parts whose rows are made at once.
WINDOW, PARTS = 1 << 20, 64
_WORD, _CAPITAL, _SYMBOL, _FIRST = 1, 2, 4, 8
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def classes(symbols: bytes = b"#$%&*|") -> np.ndarray:
    """The class bits of each byte."""
    table = np.full(256, _WORD | _FIRST, np.uint8)
    table[list(b"\x20\t\n\x0b\x0c\r")] &= ~np.uint8(_WORD)
    table[65:91] |= _CAPITAL
    table[list(symbols)] |= _SYMBOL
    table[0x80:0xC0] &= ~np.uint8(_FIRST)
    return table


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    power = lambda b: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(WINDOW, b, np.uint64)]), dtype=np.uint64)
    return power(_BASE), power(_INVERSE)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in one array, and the offsets of the texts in it."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, ends, data = texts.buffers()
    offsets = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1] if ends else np.zeros(1, np.int64)
    held = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data and len(offsets) > 1 else np.zeros(0, np.uint8)
    return held, offsets - offsets[0]


def word_bounds(word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last byte of each word; a text's end ends its word."""
    if not len(word):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    change = np.empty(len(word) + 1, bool)
    change[0], change[-1] = word[0], word[-1]
    np.not_equal(word[1:], word[:-1], out=change[1:-1])
    at = np.flatnonzero(change)
    starts, ends = at[::2], at[1::2]
    inner = np.unique(offsets[1:-1])
    inner = inner[(inner > 0) & (inner < len(word))]
    inner = inner[word[inner] & word[inner - 1]]
    return np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of (byte + 1) * base ** place modulo 2 ** 64 of every word, from prefix sums of windows."""
    power, inverse = _powers()
    out = np.zeros(len(starts), np.uint64)
    for a in range(0, len(data), WINDOW):
        b = min(a + WINDOW, len(data))
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum((data[a:b].astype(np.uint64) + np.uint64(1)) * power[: b - a], out=sums[1:])
        first, last = np.searchsorted(ends, a, "right"), np.searchsorted(starts, b, "left")
        s, e = starts[first:last], np.minimum(ends[first:last], b) - a
        inside = np.maximum(s - a, 0)
        value = (sums[e] - sums[inside]) * inverse[inside]
        if len(s) and s[0] < a:  # the one word that began in a window before
            value[:1] *= np.uint64(pow(int(_BASE), int(a - s[0]), 1 << 64))
        out[first:last] += value
    return out


def equal_words(data: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Whether the words of these lengths at ``a`` and at ``b`` are the same bytes."""
    held = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", held, strides=(1,))
    keep = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    same = np.ones(len(a), bool)
    left, at = np.flatnonzero(lengths > 0), 0
    while len(left) and at < 64:
        differ = (eight[a[left] + at] ^ eight[b[left] + at]) & keep[np.minimum(lengths[left] - at, 8)]
        same[left[differ != 0]] = False
        at += 8
        left = left[(differ == 0) & (lengths[left] > at)]
    for k in left:  # the few longer ones
        same[k] = data[a[k] + at : a[k] + lengths[k]].tobytes() == data[b[k] + at : b[k] + lengths[k]].tobytes()
    return same


def distinct_words(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Distinct words of each text, by its sorted and verified hashes."""
    n, bounds = len(offsets) - 1, np.searchsorted(starts, offsets)
    doc = np.repeat(np.arange(n), np.diff(bounds))
    hashes = word_hashes(data, starts, ends)
    order = np.lexsort((hashes, doc))
    sorted_doc, sorted_hash = doc[order], hashes[order]
    repeated = (sorted_doc[1:] == sorted_doc[:-1]) & (sorted_hash[1:] == sorted_hash[:-1])
    out = np.diff(bounds) - np.bincount(sorted_doc[1:][repeated], minlength=n)
    a, b = order[:-1][repeated], order[1:][repeated]
    lengths = ends - starts
    verified = lengths[a] == lengths[b]
    verified[verified] = equal_words(data, starts[a[verified]], starts[b[verified]], lengths[a[verified]])
    for k in np.unique(doc[a[~verified]]):
        out[k] = len(set(data[offsets[k] : offsets[k + 1]].tobytes().split()))
    return out


def scan(texts: pa.Array, table: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each text."""
    data, offsets = buffers(texts)
    bits = table[data]
    sums = {k: np.zeros(len(offsets) - 1, np.int64) for k in (_CAPITAL, _SYMBOL, _FIRST)}
    for a in range(0, len(data), WINDOW):
        piece = bits[a : a + WINDOW]
        cut = np.clip(offsets - a, 0, len(piece))
        for k, out in sums.items():
            before = np.zeros(len(piece) + 1, np.int64)
            np.cumsum((piece & k) != 0, out=before[1:])
            out += np.diff(before[cut])
    starts, ends = word_bounds((bits & _WORD) != 0, offsets)
    return {
        "n_words": np.diff(np.searchsorted(starts, offsets)),
        "n_distinct": distinct_words(data, offsets, starts, ends),
        "n_capitals": sums[_CAPITAL],
        "n_symbols": sums[_SYMBOL],
        "n_chars": sums[_FIRST],
    }


def measures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", symbols: bytes = b"#$%&*|") -> DataFrame:
    """doc_id, part, the digest of the text, and the counts of every document."""

    def task():
        table = classes(symbols)

        def each(piece: pa.RecordBatch) -> pa.RecordBatch:
            texts = piece.column("text")
            data, offsets = buffers(texts)
            view = memoryview(data)
            found = scan(texts, table)
            digests = [hashlib.sha256(view[a:b]).digest() for a, b in zip(offsets, offsets[1:])]
            return pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("part"), pa.array(digests, pa.binary()), *[pa.array(found[c], pa.int64()) for c in COUNTS]], names=["doc_id", "part", "digest", *COUNTS])

        return each

    kind = df.schema[id_col].dataType.simpleString()
    part = F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part")
    return map_slices(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), part), task, f"doc_id {kind}, part string, digest binary, {', '.join(f'{c} long' for c in COUNTS)}")


def masks(measured: DataFrame, labels: DataFrame, filters: dict[str, Column | str] = FILTERS, id_col: str = "doc_id") -> DataFrame:
    """part, mask, n, good, toxic: documents of each part by the set of filters they fail, bit 0 the first; the last bit is ``COPIES``.

    No row of a text meets another of it before both were counted: first rows of one document, then
    the documents of a text with the same part and labels, then the texts' smallest ids.
    """
    expr = lambda c: F.expr(c) if isinstance(c, str) else c
    mask = sum((F.when(expr(c), 1 << k).otherwise(0) for k, c in enumerate(filters.values())), F.lit(0))
    own = measured.select("doc_id", "part", "digest", mask.alias("mask")).groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))
    said = labels.groupBy(F.col(id_col).alias("_id")).agg(*[F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(o) for c, o in (("quality", "good"), ("toxic", "toxic"))])
    flagged = own.join(said, F.col("doc_id") == F.col("_id"), "left").fillna(0, ["good", "toxic"])
    alike = flagged.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("least"), F.min_by("n", "doc_id").alias("n_least"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_null")
    )
    known = F.col("least") == F.min("least").over(W.partitionBy("digest"))
    copies = F.col("n") - F.col("n_null") - F.when(known, F.col("n_least")).otherwise(0)
    bit = 1 << len(filters)
    split = F.array(F.struct(F.col("mask"), (F.col("n") - F.col("copies")).alias("n")), F.struct((F.col("mask") + bit).alias("mask"), F.col("copies").alias("n")))
    rows = alike.withColumn("copies", F.when(F.col("least").isNull(), 0).otherwise(copies)).select("part", "good", "toxic", F.explode(split).alias("x"))
    total = lambda c: F.sum(F.col("x.n") * F.col(c)).alias(c)
    return rows.groupBy("part", F.col("x.mask").alias("mask")).agg(F.sum("x.n").alias("n"), total("good"), total("toxic"))


@lru_cache(maxsize=4)
def combinations(letters: str) -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """Every order and step, and for each the weight of a document with each mask in every count."""
    rows, mask = [], np.arange(1 << len(letters))
    bit = {c: 1 << k for k, c in enumerate(letters)}
    out: dict[str, list[np.ndarray]] = {k: [] for k in ("kept", "removed", "redundant", "unique_fails")}
    for order in permutations(letters):
        earlier = 0
        for step, c in enumerate(order, 1):
            fails, before = (mask & bit[c]) != 0, (mask & earlier) != 0
            earlier |= bit[c]
            rows.append(("".join(order), step))
            for k, x in (("kept", (mask & earlier) == 0), ("removed", fails & ~before), ("redundant", fails & before), ("unique_fails", mask == bit[c])):
                out[k].append(x)
    weights = {k: np.array(v, np.int64) for k, v in out.items()}
    by_letter = {c: sum(w for (order, step), w in zip(rows, weights["removed"], strict=True) if order[step - 1] == c) for c in letters}
    return rows, weights | {"shapley": np.array([by_letter[order[step - 1]] for order, step in rows], np.int64)}


OUT = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def interactions(counted: DataFrame, letters: str) -> DataFrame:
    """A row per part, order and step from the counts of ``masks``."""

    def run(batches):
        rows, weights = combinations(letters)
        orders, steps = (np.array(x) for x in zip(*rows, strict=True))
        for batch in batches:
            for at in range(0, batch.num_rows, PARTS):
                piece = batch.slice(at, PARTS).to_pylist()
                n = np.zeros((3, 1 << len(letters), len(piece)), np.int64)
                for p, row in enumerate(piece):
                    for x in row["x"]:
                        n[:, x["mask"], p] = x["n"], x["good"], x["toxic"]
                found = {k: w @ n[0] for k, w in weights.items()} | {"good_lost": weights["removed"] @ n[1], "toxic_lost": weights["removed"] @ n[2]}
                parts = np.repeat(np.array([r["part"] for r in piece], object), len(rows))
                columns = [pa.array(parts, pa.string()), pa.array(np.tile(orders, len(piece)), pa.string()), pa.array(np.tile(steps, len(piece)), pa.int32()), *[pa.array(found[k].T.ravel(), pa.int64()) for k in OUT]]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "filter_order", "step", *OUT])

    # at most 2 ** filters entries a part
    parts = counted.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("x"))
    return parts.mapInArrow(run, f"part string, filter_order string, step int, {', '.join(f'{k} long' for k in OUT)}")


def audit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", filters: dict[str, Column | str] = FILTERS) -> DataFrame:
    """part, filter_order, step and the counts of that step, for every part and every order of ``filters`` and ``COPIES``."""
    return interactions(masks(measures(df, id_col, text_col, part_col), labels, filters, id_col), "".join(filters) + COPIES)


def oracle_sql() -> str:
    return r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM d),
f AS (
  SELECT doc_id, part,
    (len(words) < 50)::INT + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), FALSE)::INT AS mask
  FROM w),
l AS (SELECT doc_id, max(coalesce(quality = 1, FALSE)::INT) AS good, max(coalesce(toxic = 1, FALSE)::INT) AS toxic FROM labels GROUP BY doc_id),
cells AS (
  SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask),
o(s, earlier, bit) AS (
  SELECT '', 0, 0 UNION ALL
  SELECT s || chr(65 + k), earlier + bit, 1 << k FROM o, (SELECT unnest(range(5))::INT AS k) WHERE NOT contains(s, chr(65 + k))),
steps AS (SELECT a.s AS filter_order, length(b.s)::INT AS step, b.earlier, b.bit FROM o a JOIN o b ON length(a.s) = 5 AND length(b.s) > 0 AND starts_with(a.s, b.s)),
rows_of AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (earlier | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN mask & bit > 0 AND mask & earlier > 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN mask & bit > 0 AND mask & earlier = 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM cells CROSS JOIN steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM rows_of"""
