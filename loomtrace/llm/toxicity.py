"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

Model. A word is the bag of its hashed character n-grams (3 to 5, with word-boundary marks) and the
word itself; a window of ``WINDOW`` words is the average of its words' averaged vectors; a linear
two-class softmax scores it. A text's logit is its largest window's, so a long text does not dilute a
few words, and a misspelt or inflected word shares its n-grams' vectors. Within a word too there are
windows: stretches of ``PIECE`` characters, half of them new, of the word with its marks. A word no longer
than one is its only stretch; any other (text without spaces, chained words) enters whole, by its stretches,
which hold all its n-grams, and by the words that it chains. Vectors and softmax are fitted
together by Adagrad on whole batches; in fitting, windows are pooled by a soft maximum that sharpens,
as a label says that some window is toxic, not which.

Because averaging and the linear layer commute, the executors need one number a bucket (vector times
weight difference): scoring is a look-up per distinct word and a running mean.

Sample. Of the labelled rows that ``train`` lets through, at most ``SAMPLE`` a class, those of least hash of
their id, as far as their texts together have up to ``SAMPLE_CHARS`` characters: the driver fits, so rows and
bytes are bounded, and long texts teach as others do at the price of rows. One that is longer than all may be
takes no place. Only fitting is bounded: every whole text is scored. ids, sources, languages and labels never enter a score.
``WINDOW`` and ``ROUNDS`` are those of the least cross-validated log loss (three folds) among the rows
that may be learnt from; the held-out rows had no part in it.

Defined results: null and empty texts have no window and score 0; with labels of one class only, or
none, every score is 0; equal texts, and so all ties, score equally; a very long text or word costs time
and memory in proportion to its length; repeated label rows of one id count once (the largest label),
and so do repeated documents of one id (the least text), in fitting; an empty table gives an empty
table; further columns are ignored or kept as said.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtrace.llm.common import checkpointed, map_slices

BUCKETS, WIDTH, WINDOW = 1 << 18, 16, 2
SAMPLE, SAMPLE_CHARS = 2000, 8_000_000
ROUNDS, RATE = 80, 0.5
THRESHOLD = 0.7
#: n-grams that fitting looks at at once.
BLOCK = 1 << 20
TABLE = 300_000
#: Characters of a word's stretches, and from one to the next.
PIECE, STEP = 16, 8
_WORD = re.compile(r"[^\W_]+(?:[*@$!'.-]+[^\W_]+)*")
_JOINED = re.compile(r"[*@$!'.-]+")


def words(text: str | None) -> list[str]:
    found = _WORD.findall((text or "").lower())
    if max(map(len, found), default=0) <= PIECE - 2:
        return found
    return [x for w in found for x in stretches(w)]


def stretches(word: str) -> list[str]:
    """The word, and if it is longer than a stretch, its stretches (with a sign before them) and the words that it chains."""
    marked = f"<{word}>"
    if len(marked) <= PIECE:
        return [word]
    cut = [f"\0{marked[i : i + PIECE]}" for i in range(0, len(marked) - PIECE + STEP, STEP)]
    return [word, *cut, *[w for w in _JOINED.split(word) if w != word]]


def grams(word: str) -> list[int]:
    """Buckets of the n-grams of a word or stretch, and of itself."""
    marked = word[1:] if word.startswith("\0") else f"<{word}>"
    parts = {marked} | {marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1)}
    return sorted(zlib.crc32(p.encode()) % BUCKETS for p in parts)


class Model:
    """Embeddings (BUCKETS x WIDTH) and the softmax's weights (2 x WIDTH) and biases (2)."""

    def __init__(self, vectors: np.ndarray | None = None, weights: np.ndarray | None = None, biases: np.ndarray | None = None):
        self.fitted = vectors is not None
        if self.fitted:
            self.vectors, self.weights, self.biases = vectors, weights, biases
            self.bucket = (vectors @ (weights[1] - weights[0])).astype(np.float32)
            self.bias = float(biases[1] - biases[0])

    def scorer(self):
        return Scorer(self.bucket, self.bias) if self.fitted else None


class Scorer:
    """What an executor needs: one number a bucket and the bias."""

    def __init__(self, bucket: np.ndarray, bias: float):
        self.bucket, self.bias, self.table = bucket, bias, {}

    def logits(self, texts: list[str | None]) -> list[float | None]:
        """The largest window's logit of each text; None without words."""
        cut = [words(t) for t in texts]
        unseen = set().union(*cut).difference(self.table)
        bucket = self.bucket
        fresh = {w: float(bucket[grams(w)].mean()) for w in unseen}
        if len(self.table) + len(fresh) <= TABLE:
            self.table.update(fresh)
            look = self.table
        else:
            look = self.table | fresh
        out = []
        for x in cut:
            if not x:
                out.append(None)
                continue
            sums = np.concatenate([[0.0], np.cumsum(np.fromiter(map(look.__getitem__, x), np.float64, len(x)))])
            n = min(WINDOW, len(x))
            out.append(float((sums[n:] - sums[:-n]).max()) / n + self.bias)
        return out


def fit(texts: list[str | None], labels: list[int], seed: int = 7) -> Model:
    """Fit on labelled texts; an unfitted model if a class is missing."""
    index: dict[str, int] = {}
    kept, parts = [], []
    for t, label in zip(texts, labels, strict=True):
        if x := words(t):
            kept.append(int(label))
            parts.append(np.fromiter((index.setdefault(w, len(index)) for w in x), np.int32, len(x)))
    y = np.array(kept, np.float64)
    if not len(y) or y.min() == y.max():
        return Model()
    tokens, sizes = np.concatenate(parts), np.array([len(x) for x in parts])
    del parts
    flat_list, n_list = array("i"), array("i")
    for w in index:
        bag = grams(w)
        flat_list.extend(bag)
        n_list.append(len(bag))
    n_grams, flat = np.frombuffer(n_list, np.int32), np.frombuffer(flat_list, np.int32)
    n_words = len(n_grams)
    starts = np.cumsum(n_grams) - n_grams
    used = np.flatnonzero(np.bincount(flat, minlength=BUCKETS))
    place = np.zeros(BUCKETS, np.int32)
    place[used] = np.arange(len(used))
    flat = place[flat]
    del flat_list, index
    # n-grams are looked at in blocks of words, so that what a step makes of them stays small
    cuts = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(flat), BLOCK)), n_words))
    blocks = [(slice(a, b), slice(int(starts[a]), int(starts[b - 1] + n_grams[b - 1]))) for a, b in zip(cuts[:-1], cuts[1:])]
    # one window begins at each word of a text that has WINDOW words after it, at least one a text; texts too in blocks
    width = np.minimum(WINDOW, sizes)
    n_windows, offset = sizes - width + 1, np.cumsum(sizes) - sizes
    cuts = np.unique(np.append(np.searchsorted(offset, np.arange(0, len(tokens), BLOCK // 4)), len(y)))
    parts_of = [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:])]
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1, 1, (len(used), WIDTH)) / WIDTH
    weights, biases = rng.uniform(-1, 1, (2, WIDTH)), np.zeros(2)
    seen_v, seen_w, seen_b = np.full(len(used), 1e-8), np.full(2, 1e-8), 1e-8
    for step in range(ROUNDS):
        sharp = 1.0 + 9.0 * min(1.0, step / (0.6 * ROUNDS))
        d = weights[1] - weights[0]
        value, score = vectors @ d, np.empty(n_words)
        for w, g in blocks:
            score[w] = np.add.reduceat(value[flat[g]], starts[w] - starts[w][0]) / n_grams[w]
        at_word, slope_b = np.zeros(n_words), 0.0
        for t in parts_of:
            own, first = tokens[offset[t][0] : offset[t][-1] + sizes[t][-1]], np.cumsum(n_windows[t]) - n_windows[t]
            of_text = np.repeat(np.arange(len(first), dtype=np.int32), n_windows[t])
            begin = np.arange(len(of_text)) + (offset[t] - offset[t][0] - first)[of_text]
            wide = width[t][of_text]
            end = begin + wide
            sums = np.concatenate([[0.0], np.cumsum(score[own])])
            logit = (sums[end] - sums[begin]) / wide + biases[1] - biases[0]
            most = np.maximum.reduceat(logit, first)
            soft = np.exp(sharp * (logit - most[of_text]))
            # a soft maximum between the mean (at first) and the largest window
            share = soft / np.add.reduceat(soft, first)[of_text]
            z = np.add.reduceat(share * logit, first)
            r = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[t]) / len(y)
            at_window = share * r[of_text] / wide
            steps = np.bincount(begin, at_window, len(own) + 1) - np.bincount(end, at_window, len(own) + 1)
            at_word += np.bincount(own, np.cumsum(steps)[:-1], n_words)
            slope_b += r.sum()
        at_gram = np.zeros(len(used))
        for w, g in blocks:
            at_gram += np.bincount(flat[g], np.repeat(at_word[w] / n_grams[w], n_grams[w]), len(used))
        slope = at_gram @ vectors
        seen_v += at_gram**2 * (d @ d) / WIDTH
        vectors -= RATE * (at_gram / np.sqrt(seen_v))[:, None] * d
        g = np.stack([-slope, slope])
        seen_w += (g**2).mean(axis=1)
        weights -= RATE * 0.2 * g / np.sqrt(seen_w)[:, None]
        seen_b += slope_b**2
        biases += RATE * np.array([1, -1]) * slope_b / np.sqrt(seen_b)
    full = np.zeros((BUCKETS, WIDTH), np.float32)
    full[used] = vectors
    return Model(full, weights, biases)


def sampled(docs: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS) -> tuple[list[str], list[int]]:
    """The bounded training rows, in the order of their ids. ``train`` is a condition on the column ``id``."""
    own = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1))
    own = own.where(train).groupBy("id").agg(F.max("y").alias("y"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where(F.length("t") <= sample_chars)
    sizes = texts.select("id", F.length("t").alias("n")).join(own.select(F.col("id").alias("k")), F.col("id") == F.col("k"), "left_semi").groupBy("id").agg(F.max("n").cast("long").alias("size"))
    known = own.join(sizes, "id").withColumn("h", F.xxhash64("id"))
    least = lambda y: known.where(F.col("y") == y).orderBy("h", "id").limit(sample)
    upto = F.sum("size").over(W.partitionBy("y").orderBy("h", "id").rowsBetween(W.unboundedPreceding, 0))
    chosen = checkpointed(least(0).unionByName(least(1)).withColumn("upto", upto).where(F.col("upto") <= sample_chars).select("id", "y"))  # 2 * sample rows at most
    rows = texts.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("t").alias("t")).collect()
    rows = sorted((r["id"], r["t"], r["y"]) for r in rows)
    return [r[1] for r in rows], [r[2] for r in rows]


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every text."""
    scorer = df.sparkSession.sparkContext.broadcast(model.scorer())

    def task():
        own = scorer.value

        def each(p: pa.RecordBatch) -> pa.RecordBatch:
            texts = p.column("text").to_pylist()
            z = own.logits(texts) if own else [None] * len(texts)
            s = [0.0 if v is None else 1 / (1 + np.exp(-max(-60.0, min(60.0, v)))) for v in z]
            return pa.RecordBatch.from_arrays([p.column("doc_id"), pa.array(s, pa.float64())], names=["doc_id", "score"])

        return each

    kind = df.schema[id_col].dataType.simpleString()
    return map_slices(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), task, f"doc_id {kind}, score double")


def keep(df: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df``, with all their columns, that score below ``threshold``."""
    scorer = df.sparkSession.sparkContext.broadcast(model.scorer())

    def task():
        own = scorer.value
        limit = float(np.log(threshold / (1 - threshold)))

        def each(p: pa.RecordBatch) -> pa.RecordBatch:
            z = own.logits(p.column(text_col).to_pylist()) if own else [None] * p.num_rows
            return p.filter(pa.array([v is None or v < limit for v in z], pa.bool_()))

        return each

    return map_slices(df, task, df.schema, text_col)


def held_out(id_: Column) -> Column:
    """Rows that no label is learnt from."""
    return F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(3)) == 1
