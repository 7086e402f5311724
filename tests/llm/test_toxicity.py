import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from loomtrace.llm import toxicity

PLAIN = ["the", "thon", "ering", "nation", "blend", "and", "reor", "house", "river", "is"]
BAD = ["idiot", "moron", "scumbag"]


def corpus(n, seed=1):
    rng = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        x = [rng.choice(PLAIN) + rng.choice(["", "s", "ing"]) for _ in range(rng.randint(5, 200))]
        y = i % 3 == 0
        for _ in range(2 * y):
            x.insert(rng.randrange(len(x)), rng.choice(BAD))
        texts.append(" ".join(x))
        labels.append(int(y))
    return texts, labels


def test_learns_and_shares_subwords():
    model = toxicity.fit(*corpus(300))
    texts, labels = corpus(200, 2)
    z = np.array(model.scorer().logits(texts))
    assert ((z > 0) == (np.array(labels) == 1)).mean() > 0.97
    misspelt, plain = model.scorer().logits(["the idiiot and", "the rivver and"])
    assert misspelt > plain + 2
    assert model.scorer().logits(["the " * 5000 + "idiot"])[0] > 0


def test_scores_equal_the_embedding_form():
    model = toxicity.fit(*corpus(60))
    text = "idiot of the river"
    vectors = [model.vectors[toxicity.grams(w)].mean(axis=0) for w in toxicity.words(text)]
    best = max(float((model.weights @ np.mean(vectors[i : i + toxicity.WINDOW], axis=0) + model.biases) @ [-1, 1]) for i in range(len(vectors) - toxicity.WINDOW + 1))
    assert abs(best - model.scorer().logits([text])[0]) < 1e-4


def test_spark_rows(spark):
    texts, labels = corpus(200)
    rows = [(i, t, "en", 0.5) for i, t in enumerate(texts)] + [(900, None, None, None), (901, "", "en", 0.1), (902, texts[0], "en", 0.1), (902, texts[0], "en", 0.1), (None, "x", "en", 0.2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    own = spark.createDataFrame([(i, y, 1) for i, y in enumerate(labels)] + [(5, None, 1), (None, 1, 1), (0, 1, 1)], "doc_id long, toxic int, text int")
    sample, y = toxicity.sampled(docs, own, ~toxicity.held_out(F.col("id")))
    assert len(sample) == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(200))
    model = toxicity.fit(sample, y)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.score for r in got}
    assert by[900] == by[901] == 0.0 and by[902] == by[0] and all(0 <= s <= 1 for s in by.values())
    kept = toxicity.keep(docs, model)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(r.doc_id or -1 for r in got if r.score < toxicity.THRESHOLD)


def test_no_labels_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "idiot")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(*toxicity.sampled(docs, none, F.lit(True)))
    assert [r.score for r in toxicity.score(docs, model).collect()] == [0.0]
    assert toxicity.keep(docs, model).count() == 1
    assert toxicity.score(docs.limit(0), model).count() == 0


def plain_fit(texts, labels, rounds):
    """The fitting word by word and window by window; (vectors by bucket, weights, biases)."""
    kept = [(toxicity.words(t), y) for t, y in zip(texts, labels) if toxicity.words(t)]
    bags = {w: toxicity.grams(w) for x, _ in kept for w in x}
    used = sorted({b for bag in bags.values() for b in bag})
    rng = np.random.default_rng(7)
    v = dict(zip(used, rng.uniform(-1, 1, (len(used), toxicity.WIDTH)) / toxicity.WIDTH))
    weights, biases = rng.uniform(-1, 1, (2, toxicity.WIDTH)), np.zeros(2)
    seen_v, seen_w, seen_b = dict.fromkeys(used, 1e-8), np.full(2, 1e-8), 1e-8
    for step in range(rounds):
        sharp = 1 + 9 * min(1.0, step / (0.6 * toxicity.ROUNDS))
        d = weights[1] - weights[0]
        score = {w: np.mean([v[b] @ d for b in bag]) for w, bag in bags.items()}
        slope_word, slope_b = dict.fromkeys(bags, 0.0), 0.0
        for x, y in kept:
            n = min(toxicity.WINDOW, len(x))
            spans = [x[i : i + n] for i in range(len(x) - n + 1)]
            logit = np.array([np.mean([score[w] for w in s]) for s in spans]) + biases[1] - biases[0]
            share = np.exp(sharp * (logit - logit.max()))
            share /= share.sum()
            r = (1 / (1 + np.exp(-share @ logit)) - y) / len(kept)
            slope_b += r
            for s, p in zip(spans, share):
                for w in s:
                    slope_word[w] += p * r / n
        slope_gram = dict.fromkeys(used, 0.0)
        for w, bag in bags.items():
            for b in bag:
                slope_gram[b] += slope_word[w] / len(bag)
        slope = sum(g * v[b] for b, g in slope_gram.items())
        for b, g in slope_gram.items():
            seen_v[b] += g**2 * (d @ d) / toxicity.WIDTH
            v[b] = v[b] - toxicity.RATE * g / np.sqrt(seen_v[b]) * d
        g = np.stack([-slope, slope])
        seen_w += (g**2).mean(axis=1)
        weights = weights - toxicity.RATE * 0.2 * g / np.sqrt(seen_w)[:, None]
        seen_b += slope_b**2
        biases = biases + toxicity.RATE * np.array([1, -1]) * slope_b / np.sqrt(seen_b)
    return v, weights, biases


def test_fitting_equals_a_plain_loop(monkeypatch):
    texts = ["the house idiot", "river and the", "moron", "", "an unbroken-andverylong-word is idiot here", "the the the river", None, "blend is"]
    labels = [1, 0, 1, 0, 1, 0, 1, 0]
    rounds = 6
    monkeypatch.setattr(toxicity, "ROUNDS", rounds)
    model = toxicity.fit(texts, labels)
    v, weights, biases = plain_fit(texts, labels, rounds)
    assert np.allclose(model.weights, weights, atol=1e-5) and np.allclose(model.biases, biases, atol=1e-6)
    assert all(np.allclose(model.vectors[b], x, atol=1e-5) for b, x in v.items())
    assert np.count_nonzero(model.vectors.any(axis=1)) == len(v)
