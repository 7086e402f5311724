import random
import sys
import zlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from loomtrace.llm import masked_lm as lm

TEXTS = ["A b A\tb\n\x1cA", None, "", " 　 ", "İx ΟΔΟΣ b", "\x85z" + "long" * 40 + " b" * 9]


def test_words_are_those_of_python():
    every = [f"A{chr(c)}b " for c in range(sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF]
    for texts in (TEXTS, ["".join(every[a : a + 5000]) for a in range(0, len(every), 5000)]):
        found, n = lm.split(texts)
        assert found.to_pylist() == [w for t in texts for w in lm.words(t)] and n.tolist() == [len(lm.words(t)) for t in texts]


def test_each_distinct_word_of_a_slice_is_looked_up_once(monkeypatch):
    vocab, asked, looked = lm.Vocabulary({"b": 1, "a": 0}), [], lm.Vocabulary.tokens
    want = [vocab[w] for t in TEXTS for w in lm.words(t)]
    monkeypatch.setattr(lm.Vocabulary, "tokens", lambda self, found: asked.extend(pa.array(found).to_pylist() if isinstance(found, list) else found.to_pylist()) or looked(self, found))
    tokens, at, _ = lm.positions(TEXTS, vocab)
    assert tokens[at].tolist() == want and len(asked) == len(set(asked))


def test_buckets_are_those_of_zlib():
    rng = random.Random(1)
    found = ["".join(rng.choice("abcé日x") for _ in range(rng.choice([0, 1, 5, lm.SHORT - 1, lm.SHORT, lm.SHORT + 1, 70]))) for _ in range(500)]
    for array, words in ((pa.array(found), found), (pa.array(found).slice(7, 90), found[7:97]), (pa.array([], pa.string()), [])):
        assert lm._buckets(array).tolist() == [zlib.crc32(w.encode()) % lm.BUCKETS for w in words]


def test_counts_are_sent_in_pieces_and_add_up(monkeypatch):
    """A few long words, as of texts without spaces, go on as soon as many short ones do."""
    monkeypatch.setattr(lm, "COUNTED", 150)
    monkeypatch.setattr(lm, "F", SimpleNamespace(col=lambda _: SimpleNamespace(alias=lambda _: None), sum=lambda _: SimpleNamespace(alias=lambda _: None)))
    sent = []
    own = SimpleNamespace(groupBy=lambda _: SimpleNamespace(agg=lambda _: None))
    df = SimpleNamespace(select=lambda _: SimpleNamespace(mapInArrow=lambda run, _: sent.extend(run(pa.record_batch({"text": pa.array([t], pa.string())}) for t in TEXTS * 3)) or own))
    lm.frequencies(df)
    total = Counter()
    for b in sent:
        total.update(dict(zip(b.column("word").to_pylist(), b.column("n").to_pylist(), strict=True)))
    assert len(sent) == 3 and total == Counter(w for t in TEXTS * 3 for w in lm.words(t))


@pytest.mark.parametrize("by", [1, 400])
def test_steep_networks_neither_overflow_nor_vanish(by):
    """Beyond FLAT the logits are shifted; both ways agree with float64."""
    net = lm.Network.initial(np.full(lm.TOKENS, 1 / lm.TOKENS))
    net.wc *= by
    net.wt *= by
    assert net._flat() == (by == 1)
    rng = np.random.default_rng(0)
    context, target = rng.integers(0, 60, (200, 4)), rng.integers(0, lm.TOKENS, 200)
    exact = lm.Network(net.flat.astype(np.float64))
    assert np.allclose(net.log_probs(context, target), exact.log_probs(context, target), rtol=1e-3, atol=1e-3)
    slopes = [lm.Network(np.zeros_like(x.flat)) for x in (net, exact)]
    for x, slope in zip((net, exact), slopes, strict=True):
        x.gradient(context, target, slope)
    assert np.isfinite(slopes[0].flat).all() and np.abs(slopes[0].flat - slopes[1].flat).max() < 1e-2 * max(1, np.abs(slopes[1].flat).max())
