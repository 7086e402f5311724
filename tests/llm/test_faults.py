"""Faults that were found, each on the smallest input that shows it."""

import random
import re
import time
from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from loomtrace.llm import neardup, pii, quality, secrets, simhash, toxicity


def test_long_runs_of_digits_are_no_ip_error():
    zeros = "0" * 100_000
    for text in ("0" * 5000 + "1.1.1.1", f"{zeros}1.{zeros}2.{zeros}3.{zeros}4", "1.1.1." + "9" * 100_000):
        found = pii.base_spans(text)
        assert found == ([] if text.endswith("9") else [(1, 0, len(text))])


def test_one_id_with_several_texts_loses_none(spark):
    a, b = (" ".join(random.Random(k).choices("abcdefghijkl", k=40)) for k in (1, 2))
    df = spark.createDataFrame([(3, a, 1), (7, a, 2), (7, b, 3), (7, b, 3), (None, a, 4)], "doc_id long, text string, k int")
    for keep in (simhash.keep_one, neardup.keep_one):
        assert sorted((r.k, r.doc_id or 0) for r in keep(df).collect()) == [(1, 3), (3, 7), (4, 0)]


def test_ledger_knows_rules_by_name(spark, tmp_path):
    assign, _, hexes = secrets.BASE
    text = "password=abcdefgh1 then " + "0123456789abcdef" * 2
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    ledger = secrets.Ledger(spark, str(tmp_path / "ledger"))
    secrets.scan(df, ledger, rules=(assign, hexes))
    said = lambda rules: secrets.findings(df, ledger, rules=rules).select(secrets.joined(F.col("found"), rules).alias("s")).first().s
    assert said((assign, hexes)) == said((hexes, assign)) == "assign:0:18,hex:24:56"
    added = (secrets.ADDED[0], hexes, assign)
    secrets.scan(df, ledger, rules=added)
    assert said(added) == "assign:0:18,hex:24:56" and ledger.read().count() == 2
    newer = (replace(assign, version=2, least=100), hexes)
    secrets.scan(df, ledger, rules=newer)
    assert said(newer) == "hex:24:56" and said((assign,)) == "assign:0:18"


def test_token_pattern_is_linear(spark):
    df = spark.createDataFrame([(1, "eyJ" * 200_000)], "doc_id long, text string")
    began = time.time()
    assert secrets.digests(df).first().spans == "" and time.time() - began < 60


def test_many_distinct_words():
    words = [b"%d" % k for k in range(2_200_000)]
    assert quality.repeat_words(words) == 0
    assert quality.repeat_words(words + words[:5]) == 10


def test_a_bad_corpus_is_judged_as_one():
    patterns = {"-" * len(quality.RULES): 990, "+" * len(quality.RULES): 10}
    post = quality.estimate(patterns)
    assert post["-" * len(quality.RULES)] < 0.01 and post["+" * len(quality.RULES)] > 0.9


def test_long_islands_equal_short_windows(monkeypatch):
    rng, crf = random.Random(3), pii.fitted()
    cases = ["".join(rng.choice(["@", ".", "+", "-", " ", "(", ")", "1", "4532015112830366", "ab", "255", "x@y.z"]) for _ in range(300)) for _ in range(20)]
    want = [crf.decode_island(t) for t in cases]
    monkeypatch.setattr(pii, "STARTS", 40)
    assert [crf.decode_island(t) for t in cases] == want


def test_features_equal_their_definitions():
    """Each column against its plain reading of the segment."""
    rng = random.Random(6)
    for _ in range(150):
        text = pii.generated(rng)[0]
        (_, at, w), *_ = pii.windows(text)
        x = w.features()
        for row, i, j in zip(x, w.i, w.j, strict=True):
            a, b = int(w.cuts[i]) + at, int(w.cuts[j]) + at
            s = text[a:b]
            digits = re.sub("[^0-9]", "", s)
            octets = re.fullmatch(r"([0-9]{1,3})[.]([0-9]{1,3})[.]([0-9]{1,3})[.]([0-9]{1,3})", s)
            assert row[1:8].tolist() == [low <= len(digits) <= high for low, high in ((0, 6), (7, 9), (10, 12), (13, 15), (16, 16), (17, 19), (20, 99))]
            assert row[8] == (16 <= len(digits) <= 19 and pii.luhn(digits))
            assert row[9] == bool(re.fullmatch(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+", s))
            assert row[10] == bool(octets and all(int(o) < 256 for o in octets.groups()))
            assert row[13] == bool(re.fullmatch("[0-9]{4}([ -][0-9]{4}){3}", s))
            assert row[14:22].tolist() == [s.count("@") == 1, s[0] == "+", s[0] == "(", any(map(str.isalpha, s)), " " in s, "-" in s, "." in s, len(s) == len(digits)]
            assert row[23] == text[a - 1 : a].isalnum() * (a > 0) and row[24] == text[b : b + 1].isalnum()


def test_long_texts_of_numbers_are_linear():
    finder, rng = pii.Finder(pii.fitted()), random.Random(1)
    line = " ".join(str(rng.randrange(10 ** rng.randint(1, 9))) for _ in range(40_000))
    mails = " ".join(f"u{k}@h{k % 97}.example.com" for k in range(100_000))
    began = time.process_time()
    finder.spans(line)
    assert len(finder.spans(mails)[0]) == 100_000
    assert time.process_time() - began < 60


def test_sample_is_bounded_in_rows_and_characters(spark):
    docs = spark.createDataFrame([(i, "x " * (30 if i % 2 else 3000)) for i in range(40)] + [(41, "a"), (41, "b")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 1)) for i in range(42)], "doc_id long, toxic int")
    texts, y = toxicity.sampled(docs, labels, F.lit(True), sample=8, sample_chars=100)
    assert sorted(y) == [0, 1] and max(map(len, texts)) <= 100  # longer ones than all may be take no place
    texts, y = toxicity.sampled(docs, labels, F.lit(True), sample=8, sample_chars=20_000)
    assert max(map(len, texts)) == 6000 and all(sum(len(t) for t, k in zip(texts, y) if k == c) <= 20_000 for c in (0, 1)) and len(y) > 4
    texts, y = toxicity.sampled(docs, labels, F.lit(True), sample=8)
    assert sorted(y) == [0] * 8 + [1] * 8
    texts, _ = toxicity.sampled(docs.where("doc_id = 41"), labels, F.lit(True))
    assert texts == ["a"]


def test_wider_budgets_link_all(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, 3, replace=False)) for b in base]
    values = [v - (1 << 64) if v >> 63 else v for v in [*map(int, base), *near]]
    edges = simhash.links(spark.createDataFrame([(v,) for v in values], "fp long"), 8, 3).collect()
    linked = {frozenset((e.a, e.b)) for e in edges}
    assert all(frozenset(p) in linked for p in zip(values[:60], values[60:]))
