import random
import zlib
from collections import Counter, defaultdict

import pytest

from loomtrace.llm import sharding


def plain_bfd(sizes, capacity):
    """Best fit, decreasing, group by group."""
    bins = []
    for s in sorted(sizes, reverse=True):
        fit = [(r, k) for k, r in enumerate(bins) if r >= s]
        if fit:
            r, k = min(fit)
            bins[k] -= s
        else:
            bins.append(capacity - s)
    return sorted(bins)


def test_runs_equal_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(60):
        sizes = [rng.choice([rng.randint(1, 100), 7, 33]) for _ in range(rng.randint(0, 200))]
        capacity = rng.randint(100, 400)
        runs, n = sharding.pack(Counter(sizes), capacity)
        left = [capacity] * n
        got = Counter()
        for size, _, k, s in runs:
            left[s] -= k * size
            got[size] += k
        assert got == Counter(sizes) and sorted(left) == plain_bfd(sizes, capacity)
    assert sharding.pack({50: 1}, 49) is None and sharding.pack({50: 3}, 100, 1) is None


def test_level_is_near_equal():
    rng = random.Random(2)
    h = Counter(rng.randint(16, 4000) for _ in range(4000))
    load = Counter()
    for size, _, n, s in sharding.level(h, 40):
        load[s] += size * n
    assert set(load) == set(range(40)) and max(load.values()) - min(load.values()) <= 0.002 * max(load.values()) * 40
    h[10_000_000] = 1  # a group above the level
    runs = sharding.level(h, 40)
    load = Counter()
    for size, _, n, s in runs:
        load[s] += size * n
    assert load[0] == 10_000_000 and len(load) == 40


def check(rows, texts, shards):
    groups, slots, load = defaultdict(set), defaultdict(list), Counter()
    for r in rows:
        t = texts[r.doc_id]
        assert r.size == len((t or "").encode()) + 16 and r.text_crc32 == zlib.crc32((t or "").encode())
        groups[t].add(r.shard)
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
        assert 0 <= r.shard < shards
    assert all(len(s) == 1 for s in groups.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return load


def test_spark(spark):
    rng = random.Random(3)
    texts = [None, None, "", "", "é" * 9] + ["x" * rng.randint(0, 400) for _ in range(300)] + ["copy of one text"] * 200 + ["w" * 3000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, size int")
    load = check(sharding.shard(df, shards=8).collect(), texts, 8)
    assert max(load.values()) - min(load.values()) <= 0.05 * max(load.values())
    rows = sharding.shard(df, capacity=8000).collect()
    load = check(rows, texts, 1000)
    assert max(load.values()) <= 8000 and len(load) <= -(-sum(load.values()) // 8000) + 1
    with pytest.raises(ValueError):
        sharding.shard(df, capacity=100)
    assert sharding.shard(df.limit(0)).count() == 0


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a"), (1, "b"), (1, "b"), (None, "a")], "doc_id long, text string")
    rows = sharding.shard(df, shards=2).collect()
    assert sorted((r.shard, r.slot) for r in rows) == [(0, 0), (0, 1), (1, 0), (1, 1)]
