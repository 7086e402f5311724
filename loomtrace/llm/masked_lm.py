"""Masked pseudo-likelihood: a bidirectional window network scores every token from both sides.

Model. Tokens are lower-case words: the ``WORDS`` most frequent ones of the whole corpus, and hash
buckets for the rest. The ``SIDE`` words on each side of a position are embedded by place, pass one
hidden layer, and a two-level softmax (class of the token, token within the class) gives the masked
token's probability. A document's score is the sum of its tokens' conditional log-probabilities; a
word of a hash bucket adds the logarithm of its share of the bucket, by the counts of the whole corpus.
The counts of the ``KNOWN`` most frequent words go to the executors, those of all others are joined.
One count of each bucket is left to words that the corpus lacks; they share it by their spelling, a
byte or the end being one of 257 equally likely symbols, so each is less likely than a word seen once.

Training covers every document: word counts come from all texts, and each round every partition starts
from the shared parameters, masks one of ``ROUNDS`` disjoint sets of the positions of each of its
documents, takes Adagrad steps on them, so that every position is a target once, and sends its parameters back, weighted by its positions; blocks of the parameters are
averaged in two levels of shuffles, streaming, so no task or driver holds more than a few copies. What
is gathered grows with the partitions, that is with the input. Biases start at the corpus
frequencies, so an untrained network is the unigram model.

Defined results: null texts count as empty; texts without words have no tokens and scores 0, the greatest
possible log_prob: a filter by score has to look at ``n_tokens`` too; a very long text is scored whole, its
words are held at once; repeated
rows count as often as they occur; ties in frequency at the edge of a vocabulary go by a hash of the word; an empty table gives an empty
table; further columns are ignored. Scores are float32 sums: equal texts agree to about six digits.
"""

from __future__ import annotations

import zlib
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.llm.common import SLICE_BYTES, checkpointed, map_slices, slices

CLASSES = 48
TOKENS = CLASSES * CLASSES
BUCKETS = 256
WORDS = TOKENS - BUCKETS
SIDE, WIDTH, HIDDEN = 2, 16, 32
ROUNDS, BATCH, RATE = 2, 1024, 0.08
#: Bytes of words that a task counts before it sends them on; floats of a parameter block; salts of the first averaging.
COUNTED, BLOCK, SALTS = 1 << 25, 1 << 14, 32
PAD = TOKENS
#: Bytes of a word that is hashed beside others, and the remainders of the CRC by byte.
SHORT, CRC = 32, np.array([zlib.crc32(bytes([k])) ^ zlib.crc32(b"\0") for k in range(256)], np.uint32)
LOG_BUCKETS, LOG_BYTES = float(np.log(BUCKETS)), float(np.log(257))
#: Words whose counts every executor holds.
KNOWN = 100_000
#: Logits of at most this size either way need no shift before their exponentials are summed in float32.
FLAT = 60


def words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def split(texts: list[str | None]) -> tuple[pa.Array, np.ndarray]:
    """``words`` of all texts, one after another, and the words of each text; Arrow's white space is Python's."""
    cut = pc.utf8_split_whitespace(pa.array([(t or "").lower().strip() or None for t in texts], pa.string()))
    return cut.flatten(), pc.fill_null(pc.list_value_length(cut), 0).to_numpy().astype(np.int64)


def encoded(texts: list[str | None]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of all texts, which of them each word is, and the words of each text."""
    found, n = split(texts)
    found = found.dictionary_encode()
    return found.dictionary, found.indices.to_numpy(), n


def frequencies(df: DataFrame, text_col: str = "text") -> DataFrame:
    """word, n over all texts; each task sends partial counts of words of near COUNTED bytes at a time."""

    def run(batches):
        held: list[pa.Array] = []

        def sent() -> pa.RecordBatch:
            found = pa.chunked_array(held, pa.string()).dictionary_encode().combine_chunks()
            found = found.chunk(0) if isinstance(found, pa.ChunkedArray) else found
            held.clear()
            return pa.RecordBatch.from_arrays([found.dictionary, pa.array(np.bincount(found.indices.to_numpy(), minlength=len(found.dictionary)))], names=["word", "n"])

        for p in slices(batches, "text"):
            held.append(split(p.column("text").to_pylist())[0])
            if sum(x.nbytes for x in held) > COUNTED:
                yield sent()
        if held:
            yield sent()

    partial = df.select(F.col(text_col).alias("text")).mapInArrow(run, "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary(dict):
    """word -> token; words outside it fall into hash buckets.

    ``held`` has the log counts of the most frequent words outside it, ``rest`` (word, n) all others,
    and ``totals`` the log of each bucket's count; without ``rest`` a word counts as its bucket.
    Nothing is added once its tokens have been asked for.
    """

    held: dict[str, float] = {}
    totals: np.ndarray | None = None
    rest: DataFrame | None = None

    def __missing__(self, word: str) -> int:
        return WORDS + zlib.crc32(word.encode()) % BUCKETS

    @cached_property
    def listed(self) -> tuple[pa.Array, np.ndarray]:
        """Its words and their tokens."""
        return pa.array(list(self), pa.string()), np.fromiter(self.values(), np.int32, len(self))

    @cached_property
    def counted(self) -> tuple[pa.Array, np.ndarray]:
        """The words of ``held`` and their log counts."""
        return pa.array(list(self.held), pa.string()), np.fromiter(self.held.values(), np.float64, len(self.held))

    def tokens(self, found: pa.Array | list[str]) -> np.ndarray:
        """The tokens of many words, without a call of Python for any that it has."""
        found = found if isinstance(found, pa.Array) else pa.array(found, pa.string())
        own, token = self.listed
        at = _places(found, own)
        out, other = np.empty(len(found), np.int32), np.flatnonzero(at < 0)
        out[at >= 0] = token[at[at >= 0]]
        out[other] = WORDS + _buckets(found.take(pa.array(other)))
        return out

    def __getstate__(self) -> dict:
        return {"held": self.held, "totals": self.totals}  # the table stays with the driver


def _places(found: pa.Array, among: pa.Array) -> np.ndarray:
    """The place of each word among others, or -1."""
    return pc.fill_null(pc.index_in(found, value_set=among), -1).to_numpy()


def _buckets(found: pa.Array) -> np.ndarray:
    """The hash bucket of each word; words of up to SHORT bytes byte by byte together, longest first."""
    if not len(found):
        return np.zeros(0, np.int32)
    _, offsets, data = found.buffers()
    ends = np.frombuffer(offsets, np.int32)[found.offset : found.offset + len(found) + 1].astype(np.int64)
    raw = np.frombuffer(data or b"", np.uint8)
    order = np.argsort(ends[:-1] - ends[1:], kind="stable")
    first, size = ends[:-1][order], np.diff(ends)[order]
    crc = np.full(len(found), 0xFFFFFFFF, np.uint32)
    more = np.searchsorted(-size, -np.arange(SHORT + 1))  # so many words have more than 0, 1, ... bytes
    long = more[SHORT]
    for k, m in enumerate(more[:SHORT].tolist()):
        crc[long:m] = CRC[(crc[long:m] ^ raw[first[long:m] + k]) & 255] ^ (crc[long:m] >> 8)
    out = np.empty(len(found), np.int32)
    out[order] = ~crc % BUCKETS
    out[order[:long]] = [zlib.crc32(raw[a : a + n]) % BUCKETS for a, n in zip(first[:long].tolist(), size[:long].tolist(), strict=True)]
    return out


def spelt(size):
    """log p(word | bucket, the corpus lacks it), up to the bucket's count, of words of so many bytes."""
    return LOG_BUCKETS - (size + 1) * LOG_BYTES


def most_frequent(counted: DataFrame, most: int) -> tuple[list, DataFrame]:
    """The ``most`` rows (word, n) of greatest n, in order, and a table of all others.

    A histogram of n, and of a hash within the least n that is taken, tell where to cut; no task or
    driver sorts more than the rows taken and those of one value of the hash.
    """
    place = F.pmod(F.xxhash64("word"), F.lit(1 << 16))

    def cut(rows: DataFrame, by, left: int, down: bool) -> tuple[int | None, int]:
        """The value of ``by`` at which ``left`` rows are reached, and the rows still wanted there."""
        for r in sorted(rows.groupBy(by.alias("v")).agg(F.count(F.lit(1)).alias("m")).collect(), key=lambda r: r["v"], reverse=down):
            if r["m"] > left:
                return r["v"], left
            left -= r["m"]
        return None, left

    at, left = cut(counted, F.col("n"), most, True)
    if at is None:
        taken, last = F.lit(True), F.lit(False)
    else:
        level, left = cut(counted.where(F.col("n") == at), place, left, False)
        taken, last = (F.col("n") > at) | ((F.col("n") == at) & (place < level)), (F.col("n") == at) & (place == level)
    extra = sorted(counted.where(last).collect(), key=lambda r: r["word"])[:left] if at is not None else []
    first = sorted([*counted.where(taken).collect(), *extra], key=lambda r: (-r["n"], r["word"]))
    return first, counted.where(~taken & ~(last & F.col("word").isin([r["word"] for r in extra])))


def vocabulary(df: DataFrame, text_col: str = "text") -> tuple[Vocabulary, np.ndarray]:
    """The tokens of the most frequent words, and every token's share of the corpus."""
    counted = checkpointed(frequencies(df, text_col))  # read twice below
    bucket = F.pmod(F.crc32(F.col("word").cast("binary")), F.lit(BUCKETS))
    first, rest = most_frequent(counted, KNOWN)
    n = np.ones(TOKENS)
    vocab = Vocabulary({r["word"]: k for k, r in enumerate(first[:WORDS])})
    for r in first:
        n[vocab[r["word"]]] += r["n"]
    for r in rest.groupBy(bucket.alias("b")).agg(F.sum("n").alias("n")).collect():
        n[WORDS + r["b"]] += r["n"]
    vocab.held = {r["word"]: float(np.log(r["n"])) for r in first[WORDS:]}
    vocab.totals, vocab.rest = np.log(n[WORDS:]), rest
    return vocab, n / n.sum()


SHAPES = {
    "embed": (TOKENS + 1, WIDTH),
    "w1": (2 * SIDE * WIDTH, HIDDEN),
    "b1": (HIDDEN,),
    "wc": (HIDDEN + 1, CLASSES),  # the last row is the bias, as below
    "wt": (CLASSES, HIDDEN + 1, CLASSES),
}


class Network:
    """The parameters; ``flat`` is all of them in one array, the others are views of it."""

    def __init__(self, flat: np.ndarray):
        self.flat, at = flat, 0
        for name, shape in SHAPES.items():
            size = int(np.prod(shape))
            setattr(self, name, flat[at : at + size].reshape(shape))
            at += size
        self.bc, self.bt = self.wc[HIDDEN], self.wt[:, HIDDEN]
        self.held: dict[str, np.ndarray] = {}

    @staticmethod
    def size() -> int:
        return sum(int(np.prod(s)) for s in SHAPES.values())

    @classmethod
    def initial(cls, share: np.ndarray, seed: int = 3) -> Network:
        rng = np.random.default_rng(seed)
        net = cls(np.zeros(cls.size(), np.float32))
        net.embed[:] = rng.normal(0, 0.3, net.embed.shape)
        net.embed[PAD] = 0
        net.w1[:] = rng.normal(0, (2 * SIDE * WIDTH) ** -0.5, net.w1.shape)
        net.wc[:HIDDEN] = rng.normal(0, 0.05, (HIDDEN, CLASSES))
        net.wt[:, :HIDDEN] = rng.normal(0, 0.05, (CLASSES, HIDDEN, CLASSES))
        by_class = share.reshape(CLASSES, CLASSES)
        net.bc[:] = np.log(by_class.sum(axis=1))
        net.bt[:] = np.log(by_class / by_class.sum(axis=1, keepdims=True))
        return net

    def _room(self, name: str, *shape: int) -> np.ndarray:
        """Memory kept from one batch to the next, as fresh pages cost more than the sums in them."""
        size = int(np.prod(shape))
        if len(self.held.get(name, ())) < size:
            self.held[name] = np.empty(size, self.flat.dtype)
        return self.held[name][:size].reshape(shape)

    def _hidden(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The embedded sides (position x side) and the hidden layer (position x unit), with a column of ones."""
        n = len(context)
        x = self._room("x", n * 2 * SIDE, WIDTH)
        np.take(self.embed, context.ravel(), axis=0, out=x, mode="clip")
        x, h = x.reshape(n, -1), self._room("h", n, HIDDEN + 1)
        own = np.matmul(x, self.w1, out=self._room("own", n, HIDDEN))
        own += self.b1
        np.tanh(own, out=h[:, :HIDDEN])
        h[:, HIDDEN] = 1
        return x, h

    def _classes(self, h: np.ndarray) -> np.ndarray:
        """Logits (position x class)."""
        return np.matmul(h, self.wc, out=self._room("logits", len(h), CLASSES))

    def _tokens(self, h: np.ndarray, runs: list[tuple[int, int, int]]) -> np.ndarray:
        """Logits (position x token in its class) of positions in the order of their classes."""
        out = self._room("logits", len(h), CLASSES)
        for c, a, b in runs:
            np.matmul(h[a:b], self.wt[c], out=out[a:b])
        return out

    def _flat(self) -> bool:
        """Whether no logit can be beyond FLAT, as the hidden units are within -1 and 1."""
        return max(np.abs(w).sum(axis=-2).max() for w in (self.wc, self.wt)) <= FLAT

    def log_probs(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """log p(target | both sides) of every position."""
        order, runs = _by_class(target)
        target = target[order]
        _, h = self._hidden(context[order])
        out, flat = np.empty(len(target), h.dtype), self._flat()
        out[order] = _picked(self._classes(h), target // CLASSES, flat)
        out[order] += _picked(self._tokens(h, runs), target % CLASSES, flat)
        return out

    def gradient(self, context: np.ndarray, target: np.ndarray, into: Network) -> None:
        """Adds the slope of the mean loss to ``into``."""
        n = len(target)
        order, runs = _by_class(target)
        context, target = context[order], target[order]
        (x, h), flat = self._hidden(context), self._flat()
        d = _slope(self._classes(h), target // CLASSES, n, flat)
        into.wc += h.T @ d
        back = np.matmul(d, self.wc[:HIDDEN].T, out=self._room("back", n, HIDDEN))
        d = _slope(self._tokens(h, runs), target % CLASSES, n, flat)
        slope, own = self._room("slope", *self.wt.shape), self._room("own", n, HIDDEN)
        for c, a, b in runs:
            np.matmul(h[a:b].T, d[a:b], out=slope[c])
            np.matmul(d[a:b], self.wt[c, :HIDDEN].T, out=own[a:b])
        met = [c for c, _, _ in runs]
        into.wt[met] += slope[met]
        back += own
        np.square(h[:, :HIDDEN], out=own)
        back *= np.subtract(1, own, out=own)
        into.w1 += x.T @ back
        into.b1 += back.sum(axis=0)
        side = context.ravel().astype(np.int16)
        order = np.argsort(side, kind="stable")
        side = side[order]
        first = np.flatnonzero(np.concatenate([[True], side[1:] != side[:-1]]))
        at_x = np.matmul(back, self.w1.T, out=self._room("at_x", n, 2 * SIDE * WIDTH)).reshape(-1, WIDTH)
        into.embed[side[first]] += np.add.reduceat(np.take(at_x, order, axis=0, out=x.reshape(-1, WIDTH), mode="clip"), first, axis=0)
        into.embed[PAD] = 0


def _picked(logits: np.ndarray, which: np.ndarray, flat: bool) -> np.ndarray:
    if not flat:
        logits -= logits.max(axis=1)[:, None]
    own = logits[np.arange(len(which)), which]
    return own - np.log(np.exp(logits, out=logits) @ np.ones(CLASSES, logits.dtype))


def _slope(logits: np.ndarray, which: np.ndarray, n: int, flat: bool) -> np.ndarray:
    if not flat:
        logits -= logits.max(axis=1)[:, None]
    p = np.exp(logits, out=logits)
    p *= (1 / (n * (p @ np.ones(CLASSES, p.dtype))))[:, None]
    p[np.arange(len(which)), which] -= 1 / n
    return p


def _by_class(target: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order of the positions by class, and each class's run (class, first, last) in it."""
    cls = (target // CLASSES).astype(np.int16)
    order = np.argsort(cls, kind="stable")
    cuts = np.searchsorted(cls[order], np.arange(CLASSES + 1)).tolist()
    return order, [(c, a, b) for c, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if a < b]


def placed(tokens: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all texts with SIDE pads around each, and the places of real tokens."""
    out = np.full(len(tokens) + SIDE * (len(n) + 1), PAD, np.int32)
    at = np.arange(len(tokens)) + SIDE * (1 + np.repeat(np.arange(len(n)), n))
    out[at] = tokens
    return out, at


def positions(texts: list[str | None], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all texts with SIDE pads around each, the places of real tokens, and tokens by text."""
    found, which, n = encoded(texts)
    return *placed(vocab.tokens(found)[which], n), n


def contexts(tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
    offsets = np.array([k for k in range(-SIDE, SIDE + 1) if k])
    return tokens[at[:, None] + offsets]


def targets(at: np.ndarray, n: np.ndarray, parts: int, which: int) -> np.ndarray:
    """Of the places of real tokens, every ``parts``-th of each text from ``which`` on; the sets of all ``which`` are disjoint and cover all."""
    own = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    return at[(own + np.repeat(n, n)) % parts == which % parts]


def train(df: DataFrame, vocab: Vocabulary, net: Network, text_col: str = "text", masked: float = 1 / ROUNDS, seed: int = 0) -> Network:
    """One round over every document: local steps in each partition, then the weighted mean of the parameters.

    ``seed`` names one of the 1 / ``masked`` sets of positions.
    """
    context = df.sparkSession.sparkContext
    shared = context.broadcast((vocab, net.flat))

    def local(batches):
        vocab, flat = shared.value
        own, room = Network(flat.copy()), np.empty_like(flat)
        seen, slope = np.full_like(flat, 1e-4), Network(np.zeros_like(flat))
        steps, row = 0, 0
        for p in slices(batches, "text"):
            tokens, at, n = positions(p.column("text").to_pylist(), vocab)
            rng = np.random.default_rng([seed, row, len(at)])
            row += p.num_rows
            at = rng.permutation(targets(at, n, max(1, round(1 / masked)), seed))
            size = max(BATCH, min(4 * BATCH, len(at) // 16))
            for a in range(0, len(at), size):
                part = at[a : a + size]
                slope.flat[:] = 0
                own.gradient(contexts(tokens, part), tokens[part], slope)
                seen += np.square(slope.flat, out=room)
                slope.flat *= RATE
                slope.flat /= np.sqrt(seen, out=room)
                own.flat -= slope.flat
                steps += len(part)
        if steps:
            salt = steps % SALTS
            n = range(0, len(flat), BLOCK)
            data = [(own.flat[a : a + BLOCK].astype(np.float64) * steps).tobytes() for a in n]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(n)), pa.int32()), pa.array([salt] * len(n), pa.int32()), pa.array([float(steps)] * len(n), pa.float64()), pa.array(data, pa.binary())], names=["block", "salt", "weight", "data"])

    def added(batches):
        held: dict[int, list] = {}
        for b in batches:
            for block, weight, data in zip(*(b.column(c).to_pylist() for c in ("block", "weight", "data")), strict=True):
                x = held.setdefault(block, [0.0, 0.0])
                x[0] += weight
                x[1] = x[1] + np.frombuffer(data)
        keys = sorted(held)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([0] * len(keys), pa.int32()), pa.array([held[k][0] for k in keys], pa.float64()), pa.array([held[k][1].tobytes() for k in keys], pa.binary())], names=["block", "salt", "weight", "data"])

    schema = "block int, salt int, weight double, data binary"
    parts = df.select(F.col(text_col).alias("text")).mapInArrow(local, schema)
    # a partition's sums of several salts are added in any case; the salt only spreads them over tasks
    sums = parts.repartition("block", "salt").mapInArrow(added, schema).repartition("block").mapInArrow(added, schema).collect()
    out, total, weight = net.flat.copy(), np.zeros(len(net.flat)), np.zeros(len(net.flat))
    for r in sums:  # a row a block, or a few if the exchange was split
        part = slice(r["block"] * BLOCK, (r["block"] + 1) * BLOCK)
        total[part] += np.frombuffer(bytes(r["data"]))
        weight[part] += r["weight"]
    seen = weight > 0
    out[seen] = total[seen] / weight[seen]
    return Network(out)


def fit(df: DataFrame, text_col: str = "text", rounds: int = ROUNDS) -> tuple[Vocabulary, Network]:
    vocab, share = vocabulary(df, text_col)
    net = Network.initial(share)
    for k in range(rounds):
        net = train(df, vocab, net, text_col, 1 / rounds, k)
    return vocab, net


def _summed(tokens: np.ndarray, n: np.ndarray, net: Network) -> np.ndarray:
    """Summed conditional log-probabilities of the texts whose words' tokens are given."""
    tokens, at = placed(tokens, n)
    logs = np.zeros(len(at) + 1)
    for a in range(0, len(at), 8 * BATCH):
        part = at[a : a + 8 * BATCH]
        logs[a : a + len(part)] = net.log_probs(contexts(tokens, part), tokens[part])
    sums = np.concatenate([[0.0], np.cumsum(logs[:-1])])
    ends = np.cumsum(n)
    return sums[ends] - sums[ends - n]


def _outside(found: pa.Array, token: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """What words add to the log-probability of their tokens, and which words' counts are to be joined."""
    more, left = np.zeros(len(found)), np.zeros(len(found), bool)
    other = np.flatnonzero(token >= WORDS)
    if vocab.totals is not None:
        counted, log = vocab.counted
        at = _places(found.take(pa.array(other)), counted)
        left[other] = at < 0
        more[other] = np.append(log, 0)[at] - vocab.totals[token[other] - WORDS]
    return more, left


def score_texts(texts: list[str | None], vocab: Vocabulary, net: Network) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and summed conditional log-probabilities of each text; a word outside the vocabulary counts as its bucket."""
    found, which, n = encoded(texts)
    return n, _summed(vocab.tokens(found)[which], n, net)


def score(df: DataFrame, vocab: Vocabulary, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, log_prob (sum) and mean_log_prob of every text."""
    shared = df.sparkSession.sparkContext.broadcast((vocab, net.flat))
    kind = df.schema[id_col].dataType.simpleString()

    def task():
        vocab, flat = shared.value
        net = Network(flat)

        def each(p: pa.RecordBatch) -> pa.RecordBatch:
            """A row a text, under a word that no text can have, and a row a word to be joined."""
            row = p.column("row").to_pylist()
            found, which, n = encoded(p.column("text").to_pylist())
            token = vocab.tokens(found)
            more, left = _outside(found, token, vocab)
            of_text, left = np.repeat(np.arange(len(n)), n), left[which]
            total = _summed(token[which], n, net)
            total += np.bincount(of_text, more[which], len(n))
            met, times = np.unique(of_text[left] * np.int64(len(found)) + which[left], return_counts=True)
            text, word = np.divmod(met, max(len(found), 1))
            key = found.take(pa.array(word))
            unseen = spelt(pc.binary_length(key).to_numpy())
            none = lambda column: pa.concat_arrays([column, pa.nulls(len(key), column.type)])
            both = lambda a, b: pa.array(np.concatenate([a, b]))
            columns = [both(p.column("row").to_numpy(), p.column("row").to_numpy()[text]), none(p.column("doc_id")), none(pa.array(n, pa.int64())), none(pa.array(total, pa.float64()))]
            columns += [pa.concat_arrays([pa.array([f" {r}" for r in row], pa.string()), key]), both(np.zeros(len(row), np.int64), times), both(np.zeros(len(row)), unseen)]
            return pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "n_tokens", "log_prob", "word", "times", "unseen"])

        return each

    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    parts = map_slices(rows, task, f"row long, doc_id {kind}, n_tokens long, log_prob double, word string, times long, unseen double", limit=4 * SLICE_BYTES)
    if vocab.rest is not None:
        parts = parts.join(vocab.rest.select("word", F.log("n").alias("seen")), "word", "left")
        more = F.sum(F.col("times") * F.coalesce("seen", "unseen"))
        parts = parts.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), (F.max("log_prob") + more).alias("log_prob"))
    return parts.select("doc_id", "n_tokens", "log_prob", (F.col("log_prob") / F.greatest("n_tokens", F.lit(1))).alias("mean_log_prob"))
