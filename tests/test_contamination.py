"""Overlaps of texts on both sides of the size limits, and the characters' stage against all pairs."""

import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtrace.functions import text as T
from loomtrace.operators import contamination


def test_repeated_ids_are_one_function_of_the_rows(spark, monkeypatch):
    text = " ".join(f"w{k}" for k in range(20))
    other = " ".join(f"w{k}" for k in range(8, 30))
    train = spark.createDataFrame([(1, text), (1, text), (1, other), (2, other), (3, None), (3, "")], "id long, text string")
    items = spark.createDataFrame([("a", text), ("a", text), ("a", other), ("b", None)], "item_id string, text string")
    found = []
    for limit in (1 << 30, 0):
        monkeypatch.setattr(contamination, "BROADCAST_CHARS", limit)
        found.append(sorted((r.train, r.item, round(r.jaccard, 9)) for r in contamination.word_overlaps(train, items, "id", "item_id").collect()))
    assert found[0] == found[1] and max(j for *_, j in found[0]) == 1.0
    assert {x[:2] for x in found[0]} == {(1, "a"), (2, "a")} and len(found[0]) == 4


def all_pairs(train, items, sizes, threshold):
    out = set()
    for i, a in train:
        for j, b in items:
            for k in sizes:
                s, t = ({x.lower()[n : n + k] for n in range(len(x.lower()) - k + 1)} for x in (a or "", b or ""))
                if s and t and len(s & t) / len(s | t) >= threshold:
                    out.add((i, j, k, len(s & t) / len(s | t)))
    return out


@pytest.mark.parametrize(("threshold", "limit"), [(0.7, 500_000), (0.4, 0), (1.0, 500_000)])
def test_characters_equal_all_pairs(spark, monkeypatch, threshold, limit):
    monkeypatch.setattr(contamination, "BROADCAST_PAIRS", limit)
    monkeypatch.setattr(contamination, "SKETCH", 1 << 9)  # collisions cost candidates, never pairs
    rng = random.Random(8)
    pool = ["".join(rng.choices("abcdeé日 ", k=60)) for _ in range(12)]

    def changed(t):
        at = rng.randrange(len(t))
        return t[:at] + rng.choice("xyZ") + t[at + rng.randrange(2) :]

    items = [(f"i{k}", t) for k, t in enumerate(pool)] + [("e", ""), ("n", None), ("s", "abcd"), ("five", "abcde"), ("i0", pool[3])]
    train = [(k, changed(changed(rng.choice(pool)))) for k in range(40)] + [(50, pool[0].upper()), (50, pool[1]), (50, pool[1]), (51, "abcde"), (52, None), (53, ""), (54, "ab" * 4000), (55, pool[2] * 9)]
    a, b = spark.createDataFrame(train, "id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    got = contamination.char_pairs(a, b, "id", "item_id", (3, 5, 6), threshold)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == all_pairs(train, items, (3, 5, 6), threshold)
    assert contamination.char_pairs(a.limit(0), b, "id", "item_id").count() == contamination.char_pairs(a, b.limit(0), "id", "item_id").count() == 0


def test_python_normalises_as_the_columns_do(spark):
    points = [c for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}{chr(c)}b {chr(c)}" for c in points if c < 0x3400 or 0xF900 <= c < 0x10000 or c % 97 == 0]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select("text", T.normalize(F.col("text")).alias("n")).collect()
    assert [(r.text, r.n) for r in got if r.n != T.normalized(r.text)] == []
    assert T.normalized(None) is None


def test_a_long_text_is_told_by_its_beginning(monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choices("abcdefghij klm", k=200_000))
    seen, rolled = [], contamination._rolled
    monkeypatch.setattr(contamination, "_rolled", lambda t, sizes: seen.append(len(t)) or rolled(t, sizes))
    assert contamination.char_grams(text, (5, 7, 10), {5: 500, 7: 510, 10: 510}) == {}
    assert sum(seen) < 2000


def test_texts_without_known_grams_are_not_sorted(monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choices("abcdefghij klm", k=900))
    known, sorts, distinct = np.zeros(contamination.SKETCH, np.int32), [], contamination._distinct
    monkeypatch.setattr(contamination, "_distinct", lambda h: sorts.append(1) or distinct(h))
    assert set(contamination.char_grams(text, (5, 8, 10), dict.fromkeys((5, 8, 10), 2000), known, 0.3)) == {5}
    assert len(sorts) == 1


@pytest.mark.parametrize("n", [2, 3, 8])
def test_word_runs_find_every_common_sequence(spark, n):
    rng = random.Random(n)
    items = [(k, " ".join(rng.choices("abcdefgh", k=rng.randrange(14)))) for k in range(12)]
    # each item's last n words at every place of a text
    train = [(100 * k + at, " ".join(["x"] * at + t.split()[-n:] + ["y"] * 9)) for k, t in items for at in range(9)]
    a, b = (spark.createDataFrame(x, "id long, text string") for x in (train, items))
    got = {(r.train, r.item) for r in contamination.word_overlaps(a, b.withColumnRenamed("id", "item"), "id", "item", n).collect()}
    grams = lambda t: set(zip(*(t.split()[k:] for k in range(n))))
    assert got == {(i, j) for i, s in train for j, t in items if grams(s) & grams(t)}
