import random
import re

import numpy as np
import xxhash

from loomtrace.llm import simhash
from loomtrace.llm.components import stars

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fp(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps):
    root = {i: i for i in range(len(ids))}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2:
                root[find(i)] = find(j)
    least = {}
    for i in range(len(ids)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least[find(i)] for i in range(len(ids))]


def near(rng, base, n):
    out = []
    for _ in range(n):
        x = rng.choice(base)
        for _ in range(rng.randint(0, 3)):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return out


def test_trie_finds_all_pairs():
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(40)]
    v = np.unique(np.array(near(rng, base, 900), np.uint64))
    got = {tuple(sorted(p)) for p in simhash.trie_pairs(v, np.array([[0, len(v), 0, len(v), 0, 0]])).tolist()}
    want = {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if bin(int(v[i]) ^ int(v[j])).count("1") <= 2}
    assert got == want


def test_links_with_and_without_hot_nodes(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(12)] + [0, (1 << 64) - 1]
    fps = sorted(set(near(rng, base, 700) + [rng.getrandbits(64) for _ in range(100)]))
    ids = list(range(len(fps)))
    want = brute_components(ids, fps)
    signed = [x - (1 << 64) if x >= 1 << 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    for hot in (5000, 6):
        edges = simhash.links(df, hot).collect()
        at = {x: i for i, x in enumerate(signed)}
        root = list(ids)

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for r in edges:
            a, b = find(at[r.a]), find(at[r.b])
            root[max(a, b)] = min(a, b)
        assert [find(i) for i in ids] == want, hot


def test_stars_of_chains(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100 + 3 * i, 100) for i in range(20)] + [(7, 7)]
    got = {r.a: r.b for r in stars(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 51)} | {100 + 3 * i: 100 for i in range(1, 20)}


def test_documents(spark):
    rng = random.Random(3)
    words = ["the", "River", "naïve", "é", "ea", "ONE", "two", "three"]
    texts = ["", None, " \n", "a", "A", "a b", "a b c", "A  b\tc", "x\x1cy z w", "日本 語 の 文"] + [" ".join(rng.choice(words) for _ in range(rng.randint(3, 80))) for _ in range(80)]
    for t in list(texts[10:60]):
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        texts += [" ".join(w), t]
    long = ["w%d" % rng.randrange(3000) for _ in range(20_000)]
    texts += [" ".join(long), " ".join(long[:9_999] + ["odd"] + long[10_000:])]
    fps = [brute_fp(t) for t in texts]
    ids = [1000 - i for i in range(len(texts))]
    df = spark.createDataFrame([(i, t, "z", 5) for i, t in zip(ids, texts)], "doc_id long, text string, fp string, component_id int")
    got = {r.doc_id: r for r in simhash.components(df).collect()}
    want = brute_components(ids, fps)
    for i, f, c in zip(ids, fps, want):
        assert got[i].fingerprint == f"{f:016x}" and got[i].component_id == c
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_null_ids_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "a b c"), (None, "unlike any other text")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in simhash.components(df).collect())
    assert got == [(0, 0), (0, 4), (4, 4), (4, 4)]
    assert simhash.components(df.limit(0)).count() == 0
