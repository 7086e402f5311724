import random

import pytest

from loomtrace.operators import lineage


def walked(parents):
    """The reference's walk with a visited set."""
    out = set()
    for i in parents:
        seen, cur, last = set(), i, i
        while cur in parents and cur not in seen:
            seen.add(cur)
            last, cur = cur, parents[cur]
        out.add((i, last, len(seen) - 1))
    return out


def test_roots_of_long_chains(spark):
    parents = {i: i - 1 for i in range(1, 300)} | {1000: None, 1001: 5000}
    got = lineage.roots(spark.createDataFrame(list(parents.items()), "id long, p long"), "id", "p")
    assert {(r.id, r.root, r.depth) for r in got.collect()} == walked(parents)


def test_roots_with_cycles(spark):
    parents = {i: i - 1 for i in range(1, 90)} | {200: 203, 201: 200, 202: 201, 203: 202, 300: 202, 301: 300, 400: 401, 401: 400, 500: 500, 501: 500}
    got = lineage.roots(spark.createDataFrame(list(parents.items()), "id long, p long"), "id", "p")
    assert {(r.id, r.root, r.depth) for r in got.collect()} == walked(parents)


def test_repeated_ids_are_one_node(spark):
    rows = [(i, i - 1) for i in range(1, 33)] + [(5, 4), (5, 4), (9, None), (None, 3)]
    got = [(r.id, r.root, r.depth) for r in lineage.roots(spark.createDataFrame(rows, "id long, p long"), "id", "p").collect()]
    assert len(got) == 32 and set(got) == walked({i: i - 1 for i in range(1, 33)})
    assert spark.conf.get("spark.sql.constraintPropagation.enabled", "true") == "true"


@pytest.mark.parametrize("shape", ["chain", "forest", "rings"])
def test_contraction_equals_walks(spark, monkeypatch, shape):
    monkeypatch.setattr(lineage, "FEW", 40)
    rng = random.Random(4)
    ids = rng.sample(range(10_000), 200)
    if shape == "chain":
        parents = dict(zip(ids[1:], ids)) | {ids[0]: None}
    elif shape == "forest":
        parents = {i: rng.choice(ids[: max(1, k // 2)]) if k % 9 else None for k, i in enumerate(ids)}
    else:
        parents = {i: ids[k - 1] if k % 20 else ids[k + 19] for k, i in enumerate(ids)} | {ids[50]: ids[7], -1: ids[50]}
    rows = [tuple(r) for r in lineage.roots(spark.createDataFrame(list(parents.items()), "id long, p long"), "id", "p").collect()]
    assert len(rows) == len(parents) and set(rows) == walked(parents)


def test_rows_written_do_not_grow_with_the_chain(spark, monkeypatch):
    monkeypatch.setattr(lineage, "FEW", 200)
    cut, rows = lineage._cut, []

    def counted(df):
        out = cut(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(lineage, "_cut", counted)
    n = 2000
    got = lineage.roots(spark.range(n).selectExpr("id", "if(id > 0, id - 1, null) as p"), "id", "p")
    assert got.where("root = 0 and depth = id").count() == n
    assert sum(rows) < 8 * n  # eleven doublings wrote twelve times the rows
