import random

import corpus_pipeline
from loomtrace.llm import neardup


def texts(seed=4):
    """Near copies of several degrees, a chain, a common passage, and short texts."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    out = ["", None, " \n", "a b", "A  b", "a b c d e"]
    passage = [word() for _ in range(40)]
    for _ in range(30):
        base = [word() for _ in range(rng.randint(40, 400))]
        out.append(" ".join(base))
        for share in (0.005, 0.01, 0.02, 0.03, 0.05):
            out.append(" ".join(word() if rng.random() < share else w for w in base))
    chain = [word() for _ in range(200)]
    for _ in range(25):
        chain[rng.randrange(200)] = word()
        chain[rng.randrange(200)] = word()
        out.append(" ".join(chain))
    out += [" ".join(passage + [word() for _ in range(rng.randint(5, 60))]) for _ in range(40)]
    rng.shuffle(out)
    return out


def brute(rows):
    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}

    sets, root = {i: grams(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in sets}


def test_components_equal_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    assert len(set(want.values())) < len(rows) - 40
    assert {r.doc_id: r.component_id for r in neardup.components(df).collect()} == want


def test_prefixes_alone_find_every_pair(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(texts(9))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(neardup, "banded_links", lambda *_: spark.createDataFrame([], "a long, b long"))
    assert {r.doc_id: r.component_id for r in neardup.components(df).collect()} == brute(rows)


def test_stage_removes_near_copies(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(3000)}" for _ in range(120)]
    other = list(base)
    other[30], other[90] = "changed", "too"
    docs = spark.createDataFrame([(2, " ".join(other), "en"), (1, " ".join(base), "en"), (3, "unlike any other text", "en"), (None, " ".join(base), "en")], "doc_id long, text string, lang string")
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3]
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


def test_counts_cover_all_texts_over_any_partitions(spark):
    import numpy as np

    rows = [(i, t or "") for i, t in enumerate(texts(3))]
    hashes = neardup.Hashes()
    want = np.zeros(neardup.COUNTERS, np.int64)
    for t in {t for _, t in rows}:
        want[(neardup.shingle_hashes(t, hashes) & np.uint64(neardup.COUNTERS - 1)).astype(np.int64)] += 1
    want = np.rint(4 * np.log2(1 + want)).astype(np.uint8)
    nodes = spark.createDataFrame([r for r in rows for _ in range(3)], "node long, text string")
    nodes = nodes.selectExpr("xxhash64(text) as node", "text")
    for n in (1, 7):  # copies of a text lie in one partition
        assert (neardup.counts(nodes.repartition(n, "node")) == want).all()
    assert not neardup.counts(nodes.limit(0)).any()
