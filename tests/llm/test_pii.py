import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from loomtrace.llm import pii

BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def brute(text):
    out = []
    for k, (kind, p) in enumerate(BASE.items()):
        for m in p.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 16 <= len(digits) <= 19 and sum(int(d) if i % 2 == 0 else sum(map(int, str(2 * int(d)))) for i, d in enumerate(digits[::-1])) % 10 == 0, "phone": 8 <= len(digits) <= 15}[kind]
            if good:
                out.append((k, m.start(), m.end()))
    return out


def texts():
    rng = random.Random(1)
    out = ["", "é a@b.c_d@e.f.g @x.y a@@b.c", "1.2.3.4.5.6.7.8", "0001.2.3.4 256.1.1.1", "4532015112830366", "4532 0151-1283 0366", "+1 (988) 555-2485 4532015112830366", "+1+12345678+1", "+12345678(.", "a@b a@b. a@b..c a@b.c-", "naïve@ex.com", "4" * 3000, "1." * 3000, "a" * 3000 + "@", "日本 +49 30 1234 5678。"]
    for _ in range(400):
        out.append("".join(rng.choice(["@", ".", "+", "-", " ", "(", ")", "1", "23", "4532015112830366", "ab", "é", "_", "255"]) for _ in range(rng.randint(0, 30))))
    return out + [pii.generated(rng)[0] for _ in range(100)]


def test_base_spans_equal_the_patterns():
    for t in texts():
        assert pii.base_spans(t) == brute(t), t


def test_decoding_equals_enumeration():
    crf = pii.fitted()
    rng = random.Random(8)
    done = 0
    for _ in range(200):
        text = pii.generated(rng)[0]
        lattice = pii.Lattice(text)
        if not 0 < len(lattice.segments) <= 9:
            continue
        scores = lattice.x @ crf.weights.T
        best = -np.inf
        for r in range(len(lattice.segments) + 1):
            for chosen in itertools.combinations(range(len(lattice.segments)), r):
                spans = sorted((lattice.segments[k], k) for k in chosen)
                if any(a[0][1] > b[0][0] for a, b in zip(spans, spans[1:])):
                    continue
                for kinds in itertools.product(range(4), repeat=r) if r <= 3 else []:
                    value, prev, at = 0.0, 0, 0
                    for ((i, j), k), y in zip(spans, kinds):
                        for _ in range(at, i):
                            value, prev = value + crf.moves[prev, 0], 0
                        value, prev, at = value + crf.moves[prev, y + 1] + scores[k, y], y + 1, j
                    for _ in range(at, lattice.n):
                        value, prev = value + crf.moves[prev, 0], 0
                    best = max(best, value)
        value, prev, at = 0.0, 0, 0
        where = {c: k for k, c in enumerate(lattice.cuts)}
        index = {s: k for k, s in enumerate(lattice.segments)}
        for y, a, b in crf.decode_island(text):
            for _ in range(at, where[a]):
                value, prev = value + crf.moves[prev, 0], 0
            value, prev, at = value + crf.moves[prev, y + 1] + scores[index[where[a], where[b]], y], y + 1, where[b]
        for _ in range(at, lattice.n):
            value, prev = value + crf.moves[prev, 0], 0
        assert value == pytest.approx(best)
        done += 1
    assert done > 20


def test_gradient_equals_differences():
    rng = random.Random(2)
    crf = pii.SemiCRF(np.random.default_rng(0).normal(size=(4, pii.N_FEATURES)) * 0.1, np.random.default_rng(1).normal(size=(5, 5)) * 0.1)
    text, gold = "+1 (988) 555-2485 4532015112830366", [(3, 0, 17), (2, 18, 34)]
    lattice = pii.Lattice(text)
    _, g, m = crf.gradient(lattice, gold)
    for y, f in [(rng.randrange(4), rng.randrange(pii.N_FEATURES)) for _ in range(10)]:
        crf.weights[y, f] += 1e-5
        up = crf.gradient(lattice, gold)[0]
        crf.weights[y, f] -= 2e-5
        assert (up - crf.gradient(lattice, gold)[0]) / 2e-5 == pytest.approx(g[y, f], abs=1e-4)
        crf.weights[y, f] += 1e-5
    crf.moves[3, 0] += 1e-5
    up = crf.gradient(lattice, gold)[0]
    crf.moves[3, 0] -= 2e-5
    assert (up - crf.gradient(lattice, gold)[0]) / 2e-5 == pytest.approx(m[3, 0], abs=1e-4)


def test_held_out_islands():
    finder, rng = pii.Finder(pii.fitted()), random.Random(77)
    cases = [pii.generated(rng) for _ in range(300)]
    assert sum(list(finder.decoded(t)) == g for t, g in cases) >= 290


def test_spark(spark):
    own = texts() + ["call +1 (988) 555-2485 4532015112830366 now", "tie 1.2.3.4", "tie 1.2.3.4"]
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in enumerate(own)] + [(9999, None, None, None)], "doc_id long, text string, spans string, n_ip int")
    got = {r.doc_id: r for r in pii.spans(df).collect()}
    for i, t in enumerate(own):
        base = brute(t)
        said = ",".join(f"{pii.KINDS[y]}:{a}:{b}" for y, a, b in base)
        assert got[i].base_sha256 == hashlib.sha256(said.encode()).hexdigest() and set(filter(None, said.split(","))) <= set(got[i].spans.split(","))
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(s[0] == k for s in base) for k in range(4)]
    assert got[9999].spans == ""
    assert got[len(own) - 3].spans == "card:23:39,phone:5:22"
    clean = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert clean[9999] is None and clean[len(own) - 3] == "call [PHONE] [CARD] now" and clean[len(own) - 1] == "tie [IP]"
    assert pii.redact(df).columns == df.columns
    assert pii.spans(df.limit(0)).count() == 0
