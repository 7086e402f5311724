import random
import re
from collections import Counter

from loomtrace.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    lines, seen, dup = [x for x in text.split("\n") if WORD.search(x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


def texts():
    rng = random.Random(3)
    out = ["", None, " \n\t ", "a", "a b c", "a b c a b c", "x\x1cy\x85z\xa0w", "a\n\na\na \n a", "日本 é é é é", "word " * 20_000, "tie", "tie", "\r\n\x0b\x0c"]
    for _ in range(150):
        out.append("".join(rng.choice(["the ", "river ", "ea, ", "# ", "%%\n", "idle\n", "b"]) for _ in range(rng.randint(0, 120))))
    return out


def test_counts_equal_brute_force():
    for t in texts():
        c = quality.counts(t)
        assert tuple(c[k] for k in quality.COUNTS) == brute(t), t


def test_em_outvotes_a_bad_rule():
    rng = random.Random(5)
    patterns, truth = Counter(), {}
    for _ in range(4000):
        good = rng.random() < 0.8
        right = lambda p: (good if rng.random() < p else not good)
        p = "".join("+" if right(a) else "-" for a in (0.95, 0.95, 0.95, 0.95, 0.5)) + rng.choice("00+")
        patterns[p] += 1
        truth.setdefault(p, Counter())[good] += 1
    post = quality.estimate(patterns)
    right = sum(n for p, c in truth.items() for good, n in c.items() if (post[p] >= 0.5) == good)
    assert right > 0.97 * 4000
    assert quality.estimate({}) == {}


def test_spark(spark):
    rng = random.Random(4)
    clean = [" ".join(rng.choice(["the", "thon", "river", "nation", "and", "of"]) + rng.choice(["", "s", "ea", "ing", "er", "th"]) for _ in range(rng.randint(80, 300))) + "." for _ in range(150)]
    junk = [" ".join(w + "%%%" for w in t.split()) for t in clean[:20]]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts() + clean + junk)]
    df = spark.createDataFrame(rows, "doc_id long, text string, votes string, kept int")
    got = {r.doc_id: r for r in quality.rules(df).collect()}
    assert len(got) == len(rows)
    n = len(texts())
    for i, t, _, _ in rows:
        c = brute(t)
        assert tuple(got[i][k] for k in quality.COUNTS) == c
        assert got[i].base_failed == (c[0] < 50 or 100 * c[4] > 50 * c[0]) and not (got[i].base_failed and got[i].kept)
    assert sum(got[i].kept for i in range(n, n + 150)) >= 148 and not any(got[i].kept for i in range(n + 150, n + 170))
    kept = quality.keep(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in got.items() if r.kept)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert quality.rules(df).count() == 0 and quality.keep(df).count() == 0
