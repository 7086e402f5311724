"""Boosted trees against a plain loop over rows, and exactly stratified folds."""

import math
import random

import numpy as np
import pytest

from loomtrace.operators import boosting
from loomtrace.operators.boosting import Settings


def made(n, seed=3):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        a, b = rng.random(), rng.randrange(4)
        label = "x" if a > 0.6 else "y" if b > 1 else "z"
        rows.append((f"t{k}", label if rng.random() > 0.1 else "z", a, float(b), None if k % 7 == 0 else float(k % 3)))
    return rows


SCHEMA = "task_id string, label string, a double, b double, c double"


def test_folds_of_a_label_differ_by_one_row(spark):
    rows = [(f"t{k}", "xyz"[k % 10 % 3], 0.0, 0.0, 0.0) for k in range(103)] + [("t1", "x", 1.0, 1.0, 1.0), (None, "x", 0.0, 0.0, 0.0)]
    got = boosting.dealt(spark.createDataFrame(rows, SCHEMA), "label", "task_id").collect()
    assert len(got) == len(rows)
    for label in "xyz":
        sizes = [sum(r.label == label and r.fold == k for r in got) for k in range(5)]
        assert max(sizes) - min(sizes) <= 1


def plain(rows, folds, cuts, s):
    """The same boosting row by row; rows: label index, fold, hash, bins."""
    classes, models = max(r[0] for r in rows) + 1, folds + 1
    margin = {(i, m, k): 0.0 for i in range(len(rows)) for m in range(models) for k in range(classes)}
    for turn in range(s.rounds):
        own = boosting.drawn(np.array([r[2] for r in rows]), turn, s)
        step = {}
        for m in range(models):
            use = [i for i, r in enumerate(rows) if own[i] and r[1] != m]
            for k in range(classes):
                g, h = {}, {}
                for i in range(len(rows)):
                    top = max(margin[i, m, c] for c in range(classes))
                    e = [math.exp(margin[i, m, c] - top) for c in range(classes)]
                    p = e[k] / sum(e)
                    g[i], h[i] = round(((rows[i][0] == k) - p) * boosting.POINT), round(p * (1 - p) * boosting.POINT)

                def grow(members, learning, depth):
                    if depth < s.depth:
                        best = (0.0, None)
                        total = sum(g[i] for i in learning)
                        for f in range(len(cuts)):
                            for b in range(boosting.BINS - 1):
                                left = [i for i in learning if rows[i][3][f] <= b]
                                if len(left) >= s.least and len(learning) - len(left) >= s.least:
                                    lg = sum(g[i] for i in left)
                                    gain = lg**2 / len(left) + (total - lg) ** 2 / (len(learning) - len(left)) - total**2 / len(learning)
                                    if gain > best[0] + 1e-3:
                                        best = (gain, (f, b))
                        if best[1]:
                            f, b = best[1]
                            for side in (lambda i: rows[i][3][f] <= b, lambda i: rows[i][3][f] > b):
                                grow([i for i in members if side(i)], [i for i in learning if side(i)], depth + 1)
                            return
                    gs, hs = sum(g[i] for i in learning), sum(h[i] for i in learning)
                    for i in members:
                        step[i, m, k] = (classes - 1) / classes * gs / hs if hs > 0 else 0.0

                grow(list(range(len(rows))), use, 0)
        for key, v in step.items():
            margin[key] += s.rate * v
    return margin


@pytest.mark.parametrize("kept", [16, 2])
def test_equals_a_loop(spark, monkeypatch, kept):
    monkeypatch.setattr(boosting, "KEPT", kept)
    s = Settings(rounds=3, depth=2, rate=0.3, share=0.8, least=3)
    df = boosting.dealt(spark.createDataFrame(made(90), SCHEMA), "label", "task_id", 2).repartition(3)
    model, table = boosting.fit(df, ["a", "b", "c"], folds=2, settings=s)
    rows = [(r.y, r.fold, r.h, list(r.x)) for r in table.collect()]
    want = plain(rows, 2, model.cuts, s)
    whole = boosting.Boosted(model.columns, model.cuts, model.labels, 2, s, model.trees, 0)
    for i, x in enumerate(rows):
        own = whole.margins(np.array([x[3]], np.uint8), np.zeros((1, 9)))[0]
        for m in range(3):
            for k in range(3):
                assert own[m, k] == pytest.approx(want[i, m, k], abs=1e-9)
    counts = boosting.confusion(model, table).collect()
    assert sum(r.n for r in counts if r.fold >= 0) == sum(r.n for r in counts if r.fold == -1) == 90


def test_it_learns(spark):
    found = boosting.cross_validated(spark.createDataFrame(made(400), SCHEMA), ["a", "b", "c"], folds=3, settings=Settings(rounds=8, depth=3, rate=0.3))
    assert found["accuracy"] > 0.8 and found["f1_macro"] > 0.75 and found["importances"]["a"] > found["importances"]["c"]
    assert boosting.scores([("a", "a", 8), ("a", "b", 2), ("b", "b", 5)]) == pytest.approx({"accuracy": 13 / 15, "f1_macro": (16 / 18 + 10 / 12) / 2, "f1_weighted": (16 / 18 * 10 + 10 / 12 * 5) / 15})


def test_levels_look_at_counts_of_kinds(spark):
    """A level's job reads a row a kind of samples; it used to read a row a sample."""
    rows = [(f"t{k}", "xy"[k % 2], float(k % 3), 0.0, 0.0) for k in range(3000)]
    model, table = boosting.fit(boosting.dealt(spark.createDataFrame(rows, SCHEMA), "label", "task_id", 2), ["a", "b", "c"], folds=2, settings=Settings(rounds=1, depth=1))
    kinds = boosting.counted(table, model, 2)
    assert table.count() == 3000 and kinds.count() <= 12
    drawn = [boosting.drawn(np.array([r.h for r in table.collect()]), 1 + k, model.settings).sum() for k in range(2)]
    assert kinds.selectExpr("sum(n0)", "sum(n1)").first() == tuple(drawn)
