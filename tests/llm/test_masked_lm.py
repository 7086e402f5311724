import random

import numpy as np
import pytest

from loomtrace.llm import masked_lm as lm


def corpus(n, seed):
    """Sentences where a word tells its neighbours."""
    rng = random.Random(seed)
    pairs = [(f"a{k}", f"b{k}", f"c{k}") for k in range(40)]
    return [" ".join(w for _ in range(rng.randint(20, 60)) for w in rng.choice(pairs)) for _ in range(n)]


def small():
    vocab = lm.Vocabulary({f"w{k}": k for k in range(100)})
    share = np.full(lm.TOKENS, 1 / lm.TOKENS)
    return vocab, lm.Network.initial(share)


def test_probabilities_sum_to_one():
    _, net = small()
    context = np.repeat(np.array([[3, 5, lm.PAD, 7]]), lm.TOKENS, axis=0)
    assert np.exp(net.log_probs(context, np.arange(lm.TOKENS))).sum() == pytest.approx(1, abs=1e-3)


def test_gradient_equals_differences():
    _, net = small()
    net = lm.Network(net.flat.astype(np.float64))
    rng = np.random.default_rng(0)
    context, target = rng.integers(0, 60, (40, 4)), rng.integers(0, 120, 40)
    slope = lm.Network(np.zeros_like(net.flat))
    net.gradient(context, target, slope)
    for k in np.flatnonzero(np.abs(slope.flat) > 1e-4)[:: 900]:
        net.flat[k] += 1e-5
        up = net.log_probs(context, target).mean()
        net.flat[k] -= 2e-5
        down = net.log_probs(context, target).mean()
        net.flat[k] += 1e-5
        assert -(up - down) / 2e-5 == pytest.approx(slope.flat[k], abs=1e-5)


def test_scores_equal_one_by_one():
    vocab, net = small()
    texts = ["w1 w2 w3", "", None, "w5", "other W1 w2 " * 50, "w1 w2 w3"]
    n, total = lm.score_texts(texts, vocab, net)
    for t, k, s in zip(texts, n, total):
        ids = [vocab[w] for w in (t or "").lower().split()]
        own = 0.0
        for i in range(len(ids)):
            c = [ids[j] if 0 <= j < len(ids) else lm.PAD for j in (i - 2, i - 1, i + 1, i + 2)]
            own += float(net.log_probs(np.array([c]), np.array([ids[i]]))[0])
        assert k == len(ids) and s == pytest.approx(own, rel=1e-4, abs=1e-6)


def test_learns_from_all_partitions(spark):
    texts = corpus(300, 1)
    df = spark.createDataFrame([(i, t, 1.0) for i, t in enumerate(texts)], "doc_id long, text string, log_prob double").repartition(3)
    vocab, share = lm.vocabulary(df)
    assert len(vocab) == 120 and share.sum() == pytest.approx(1)
    start = lm.Network.initial(share)
    net = start
    for k in range(3):
        net = lm.train(df, vocab, net, masked=0.5, seed=k)
    held = corpus(30, 2)
    before, after = (lm.score_texts(held, vocab, x)[1].sum() for x in (start, net))
    assert after > 0.7 * before  # less negative
    shuffled = [" ".join(random.Random(3).sample(t.split(), len(t.split()))) for t in held]
    assert lm.score_texts(shuffled, vocab, net)[1].sum() < after
    got = {r.doc_id: r for r in lm.score(df, vocab, net).collect()}
    assert len(got) == 300 and got[0].n_tokens == len(texts[0].split()) and got[0].mean_log_prob == pytest.approx(got[0].log_prob / got[0].n_tokens)


def test_degenerate_tables(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (None, "a"), (3, "a"), (3, "a")], "doc_id long, text string")
    vocab, net = lm.fit(df, rounds=1)
    got = sorted((r.doc_id or 0, r.n_tokens) for r in lm.score(df, vocab, net).collect())
    assert got == [(0, 1), (1, 0), (2, 0), (3, 1), (3, 1)]
    none = df.limit(0)
    assert lm.score(none, *lm.fit(none, rounds=1)).count() == 0


def test_a_round_equals_a_plain_loop(spark):
    """Partitions walk their batches position by position; their parameters are averaged by positions."""
    texts = [corpus(3, 5), corpus(5, 6)]
    vocab = lm.Vocabulary({w: k for k, w in enumerate(sorted({w for part in texts for t in part for w in t.split()})[:90])})
    net = lm.Network.initial(np.full(lm.TOKENS, 1 / lm.TOKENS))
    total, weight = np.zeros(len(net.flat)), 0
    for part in texts:
        own, seen = lm.Network(net.flat.copy()), np.full(len(net.flat), 1e-4)
        ids = [[vocab[w] for w in t.lower().split()] for t in part]
        at = [(k, i) for k, x in enumerate(ids) for i in range(len(x)) if (i + len(x)) % 2 == 1]
        order = np.random.default_rng([1, 0, len(at)]).permutation(len(at))
        size = max(lm.BATCH, len(at) // 16)
        for a in range(0, len(order), size):
            chosen = [at[j] for j in order[a : a + size]]
            mean = np.zeros(len(net.flat))
            for k, i in chosen:
                one = lm.Network(np.zeros(len(net.flat), np.float32))
                side = [ids[k][j] if 0 <= j < len(ids[k]) else lm.PAD for j in (i - 2, i - 1, i + 1, i + 2)]
                own.gradient(np.array([side]), np.array([ids[k][i]]), one)
                mean += one.flat / len(chosen)
            seen += mean**2
            own.flat -= (lm.RATE * mean / np.sqrt(seen)).astype(np.float32)
        total += own.flat.astype(np.float64) * len(at)
        weight += len(at)
    rows = [(t,) for part in texts for t in part]
    parts = spark.sparkContext.parallelize([rows[:3], rows[3:]], 2).flatMap(lambda x: x).toDF("text string")
    got = lm.train(parts, vocab, net, masked=0.5, seed=1)
    assert np.abs(got.flat - total / weight).max() < 2e-3 and np.abs(got.flat - net.flat).max() > 0.05
