"""Importance resampling towards a target corpus, by hashed n-grams.

Method. A ring keeps the running zlib states of the last n starts: each word extends every state by a space
and itself and starts one more, so one scan of a document gives the CRC of all its runs of 1 to n words,
and no run is ever built as a string. The buckets are written once as a narrow table, from which both passes
read: one adds up a histogram in each task, the other looks the buckets' gains up and takes their mean. A
draw without replacement is a top list by weight plus Gumbel noise from the id's hash. Its ranks come from
counts of equal scores (scores are whole numbers in a range that the logarithms bound, some 200,000 values
at most) and a numbering within a score of the rows above the cut alone.

Defined results: a null text has no words; a document without features has weight 0; a null id hashes as
an empty one and comes first among ties; rows with equal ids and scores are drawn one by one, in any order,
as they are equal in all that is returned or else ordered by it; very long texts cost time and memory in
proportion to their length; an empty table gives an empty table and an empty target counts 0 in every
bucket; further columns are ignored.
"""

from __future__ import annotations

import math
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtrace.llm.common import map_slices, slices, written

BUCKETS, LONGEST_RUN, LEAST_WORDS, SHARE, SEED = 10_000, 1, 20, 10, 2024


def _letters() -> bytes:
    """A-Z to lower case; every other ASCII character that is no letter or digit to a space."""
    keep = set(b"abcdefghijklmnopqrstuvwxyz0123456789") | set(range(128, 256))
    return bytes(c + 32 if 65 <= c <= 90 else c if c in keep else 32 for c in range(256))


LETTERS = _letters()


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LETTERS).split()


def ring(found: list[bytes], longest: int) -> list[int]:
    """CRC-32 of every run of 1 to ``longest`` consecutive words, joined by spaces."""
    states: list[int] = []
    out: list[int] = []
    for word in found:
        states = [crc32(word, crc32(b" ", s)) for s in states[1 - longest :]] if longest > 1 else []
        states.append(crc32(word))
        out += states
    return out


def hashed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST_RUN, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words and the bucket of every feature, repeats included."""

    def task():
        def each(piece: pa.RecordBatch) -> pa.RecordBatch:
            found = [words(t) for t in piece.column("text").to_pylist()]
            crcs = [np.array(ring(x, longest), np.uint32) for x in found]
            ends = np.cumsum([0, *map(len, crcs)])
            values = (np.concatenate(crcs) % buckets).astype(np.int32) if crcs else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))
            return pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(map(len, found), pa.int64()), lists], names=["doc_id", "n_words", "buckets"])

        return each

    kind = df.schema[id_col].dataType.simpleString()
    return map_slices(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), task, f"doc_id {kind}, n_words long, buckets array<int>")


def histogram(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of each bucket over all rows: a row a bucket from each task, ``buckets`` numbers in the driver."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for piece in slices(batches, "buckets"):
            total += np.bincount(piece.column("buckets").flatten().to_numpy(zero_copy_only=False), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in rows.select("buckets").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(all_rows: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the target's and all rows' smoothed shares of each bucket, rounded down."""
    size = len(all_rows)
    s, t = float(all_rows.sum() + size), float(target.sum() + size)
    return np.array([math.floor(1000 * math.log((float(b + 1) * s) / (float(a + 1) * t))) for a, b in zip(all_rows.tolist(), target.tolist(), strict=True)], np.int64)


def weighted(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight: the mean gain of a document's features, rounded down."""

    def run(batches):
        for piece in slices(batches, "buckets"):
            lists = piece.column("buckets")
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            sums = np.concatenate([[0], np.cumsum(gain[lists.flatten().to_numpy(zero_copy_only=False)])])
            n = np.diff(ends)
            weight = (sums[ends[1:]] - sums[ends[:-1]]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("n_words"), pa.array(n, pa.int64()), pa.array(weight, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def drawn(scored: DataFrame, share: int = SHARE, least: int = LEAST_WORDS) -> DataFrame:
    """``scored`` with rank: 1, 2, 3 ... for the ``share`` per cent of documents of ``least`` words with the highest scores."""
    fits = F.col("n_words") >= least
    counts = scored.where(fits).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    higher = W.orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, -1)  # one row a score: bounded by their range
    total = F.sum("n").over(W.orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    above = counts.select(F.col("score").alias("_score"), F.coalesce(F.sum("n").over(higher), F.lit(0)).alias("_above"), F.expr("n").alias("_n"), total.alias("_all"))
    draw = F.floor(F.col("_all") * share / 100) if share % 1 else F.expr(f"_all * {share}L div 100")
    cut = above.select("_score", "_above", draw.alias("_draw")).where("_above < _draw")
    placed = scored.join(F.broadcast(cut), fits & (F.col("score") == F.col("_score")), "left")
    columns = scored.columns
    # equal rows count together, so that no id that fills the table is one task
    near = placed.where("_above is not null").groupBy(*columns, "_above", "_draw").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(W.partitionBy("score").orderBy("doc_id", "n_features", "n_words", "weight")) + F.col("_above")
    ranked = near.withColumn("_upto", upto).select(*columns, "_draw", F.explode(F.sequence(F.col("_upto") - F.col("_n") + 1, F.col("_upto"))).alias("rank"))
    near = ranked.select(*columns, F.when(F.col("rank") <= F.col("_draw"), F.col("rank")).alias("rank"))
    return near.unionByName(placed.where("_above is null").select(*columns, F.lit(None).cast("long").alias("rank")))


def resample(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", longest: int = LONGEST_RUN, buckets: int = BUCKETS, share: int = SHARE, least: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; rank is null where it is not drawn."""
    rows = written(hashed(df, id_col, text_col, longest, buckets), "buckets")
    wanted = hashed(target.select(F.lit(0).alias("doc_id"), F.col(target_text).alias("text")), longest=longest, buckets=buckets)
    gain = gains(histogram(rows, buckets), histogram(wanted, buckets))
    start = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8)
    noise = F.floor(-1000 * F.log(-F.log((F.conv(start, 16, 10).cast("long") + 0.5) / 4294967296.0)))
    scored = written(weighted(rows, gain).withColumn("score", F.col("weight") + noise), "scores")
    return drawn(scored, share, least).select("doc_id", "n_features", "weight", "score", "rank")


def oracle_sql() -> str:
    """Runs of one word: CRC-32 by its table of 256, itself made by the polynomial's rule."""
    return r"""
WITH crc AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
texts AS (SELECT row_number() OVER () AS id, doc_id, text, FALSE AS target FROM documents UNION ALL SELECT -row_number() OVER (), NULL, text, TRUE FROM benchmark),
words AS (
  SELECT id, target, unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS word
  FROM texts),
each AS (SELECT DISTINCT word, hex(encode(word)) AS h FROM words),
bytes AS (
  SELECT word, list_transform(range(0, length(h) // 2), lambda i: (strpos('0123456789ABCDEF', substr(h, (2 * i + 1)::INT, 1)) - 1) * 16 + strpos('0123456789ABCDEF', substr(h, (2 * i + 2)::INT, 1)) - 1) AS b
  FROM each),
buckets AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[(1 + (xor(c, x) & 255))::INT])), 4294967295) % 10000 AS bucket
  FROM bytes, crc),
features AS (SELECT id, target, bucket FROM words JOIN buckets USING (word)),
counts AS (
  SELECT b AS bucket, count(*) FILTER (WHERE NOT target) AS s, count(*) FILTER (WHERE target) AS t
  FROM range(10000) r(b) LEFT JOIN features ON bucket = b GROUP BY b),
gain AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS g
  FROM counts),
sums AS (SELECT id, count(*) AS n, sum(g) AS g FROM features JOIN gain USING (bucket) WHERE NOT target GROUP BY id),
weights AS (
  SELECT doc_id, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN ((g - ((g % n) + n) % n) // n)::BIGINT ELSE 0 END AS weight,
    substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8) AS h
  FROM texts LEFT JOIN sums USING (id) WHERE NOT target),
noise AS (
  SELECT *, list_reduce(list_prepend(0, list_transform(range(1, 9), lambda i: strpos('0123456789abcdef', substr(h, i::INT, 1)) - 1)), lambda c, x: c * 16 + x) AS k
  FROM weights),
scores AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((k + 0.5) / 4294967296)))::BIGINT AS score FROM noise),
ranks AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS place, count(*) FILTER (WHERE n_features >= 20) OVER () AS n
  FROM scores)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM ranks"""
