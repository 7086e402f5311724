"""Buckets, gains, weights and the draw against plain loops."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from loomtrace.llm import resampling

HARD = ["", None, " \n", "A", "Ab-cd_ef'gh", "naïve CAFÉ İ ς", "日本語 テキスト x9", "a\0b", "1 2 3 " * 30, "z" * 50_000, "word " * 3000, "The the THE " * 10]


def plain(text: str | None, longest: int) -> list[bytes]:
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return [" ".join(found[i : i + n]).encode() for i in range(len(found)) for n in range(1, longest + 1) if i + n <= len(found)]


def brute(docs, target, longest=1, size=10_000, share=10, least=20, seed=2024):
    at = lambda f: zlib.crc32(f) % size
    s, t = np.zeros(size, int), np.zeros(size, int)
    for _, x in docs:
        for f in plain(x, longest):
            s[at(f)] += 1
    for x in target:
        for f in plain(x, longest):
            t[at(f)] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * float(s.sum() + size) / ((s[b] + 1) * float(t.sum() + size)))) for b in range(size)]
    out = []
    for d, x in docs:
        f = plain(x, longest)
        weight = sum(gain[at(y)] for y in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(plain(x, 1))])
    fits = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[1], r[5], r[2]))
    for k, r in enumerate(fits[: share * len(fits) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=repr)


def made(n: int) -> list[str]:
    rng = random.Random(n)
    vocabulary = ["".join(rng.choices("abcdeéX日9", k=rng.randint(1, 7))) for _ in range(400)]
    return [" ".join(rng.choices(vocabulary, k=rng.choice([3, 19, 20, 21, 90]))) for _ in range(n)]


def test_ring_equals_runs():
    for longest in (1, 2, 3, 7):
        for t in HARD + made(20):
            assert sorted(resampling.ring(resampling.words(t), longest)) == sorted(map(zlib.crc32, plain(t, longest)))


@pytest.mark.parametrize(("longest", "size", "share"), [(1, 10_000, 10), (2, 500, 35), (3, 97, 100), (1, 10, 0)])
def test_resample_equals_loop(spark, longest, size, share):
    texts = made(150)
    docs = list(enumerate(HARD + texts)) + [(3, texts[0]), (3, texts[1]), (3, texts[1]), (5, texts[1]), (None, texts[2]), (None, texts[2]), (-4, texts[3])] * 3
    target = [*made(9), None, ""]
    df = spark.createDataFrame([(d, t, "c", 1) for d, t in docs], "doc_id long, text string, buckets string, score int")
    goal = spark.createDataFrame([(t, 7) for t in target], "text string, doc_id int")
    got = resampling.resample(df, goal, longest=longest, buckets=size, share=share)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, target, longest, size, share)
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_features": "bigint", "weight": "bigint", "score": "bigint", "rank": "bigint"}


def test_empty_tables(spark):
    empty, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b " * 20), (2, None)], "doc_id long, text string")
    assert resampling.resample(empty, some).count() == 0
    assert sorted((tuple(r) for r in resampling.resample(some, empty).collect()), key=repr) == brute([(1, "a b " * 20), (2, None)], [])
