import random

import __spark_entry__ as entry
import pytest

from loomtrace.functions import stats


@pytest.mark.parametrize("n", [1, 2, 3, 40, 64, 500])
@pytest.mark.parametrize("parts", [1, 7, 32])
def test_draws_are_those_of_randrange(n, parts, monkeypatch):
    monkeypatch.setattr(stats, "DRAWN", 2000)
    rng = random.Random(4)
    want = [[rng.randrange(n) for _ in range(n)] for _ in range(70)]
    assert [r for share in stats.shares(n, 70, 4, parts) for block in stats.draws(n, share) for r in block.tolist()] == want


def test_shares_of_a_comparison_give_one_interval(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(k, i, rng.random() < 0.6, None if i == 5 else rng.random() < 0.5) for k in ("a", None) for i in range(90)]
    df = spark.createDataFrame(rows, "k string, i int, a boolean, b boolean")
    own = {k: stats.bootstrap([r[2] for r in rows if r[0] == k], [bool(r[3]) for r in rows if r[0] == k], 3000, seed=7) for k in ("a", None)}
    for share in (90 * 3000 // 32, 1 << 26):
        got = {r.k: r for r in stats.paired_bootstrap(df, "k", "i", "a", "b", 3000, 7, share=share).collect()}
        assert len(got) == 2
        for k, want in own.items():
            assert got[k].n == 90 and {c: got[k][c] for c in want} == want
    rng = random.Random(7)
    a, b = ([int(bool(r[c])) for r in rows[:90]] for c in (2, 3))
    drawn = sorted(sum(a[i] for i in at) / 90 - sum(b[i] for i in at) / 90 for at in ([rng.randrange(90) for _ in range(90)] for _ in range(3000)))
    assert (own["a"]["ci_lo"], own["a"]["ci_hi"]) == (drawn[75], drawn[2925])
    assert stats.paired_bootstrap(df.limit(0), "k", "i", "a", "b").count() == 0


def test_labels_are_resampled_ten_thousand_times(spark, tmp_path):
    spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(700)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.block: r for r in entry.queries()["bootstrap_labels"](spark, str(tmp_path)).collect()}
    assert {b: r.n for b, r in got.items()} == {0: 500, 1: 200}
    assert all(r.p_two_sided == pytest.approx(2 / 10_001) for r in got.values())
