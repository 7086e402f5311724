"""Running sums that split hot keys, and admission whose refused records use nothing up."""

import random

import pytest
from pyspark.sql import functions as F

from loomtrace.functions.running import at_ranks, ranges, running
from loomtrace.operators import quota, routing


def by_hand(rows, per_day, storage):
    """rows: tenant, seq, day, size, in order."""
    state, out = {}, []
    for t, seq, day, size in rows:
        last, records, used = state.get(t, (None, 0, 0))
        records = records if last == day else 0
        breach = "records_per_day" if per_day is not None and records + 1 > per_day else "storage_bytes" if storage is not None and used + (size or 0) > storage else None
        if breach is None:
            records, used = records + 1, used + (size or 0)
        state[t] = (day, records, used)
        out.append((t, seq, records, used, breach))
    return sorted(out, key=repr)


def made(n, seed, sizes):
    rng = random.Random(seed)
    days = sorted(rng.choices(range(1, 6), k=n))
    return [(rng.choice(["a", "a", "a", "b", None]), k, f"2024-01-0{d}", rng.choice(sizes)) for k, d in enumerate(days)]


def found(spark, rows, per_day, storage, hot):
    df = spark.createDataFrame(rows, "tenant string, seq long, day string, size long")
    out = quota.within_quota(df, "tenant", F.col("day"), "seq", F.col("size"), per_day, storage, hot=hot)
    assert out.columns == ["tenant", "seq", "day", "size", "records_today", "storage_bytes", "breach"]
    return sorted(((r.tenant, r.seq, r.records_today, r.storage_bytes, r.breach) for r in out.collect()), key=repr)


def test_a_refused_record_uses_nothing_up(spark):
    rows = [("a", 1, "d", 10), ("a", 2, "d", 1000), ("a", 3, "d", 10)]
    assert [r[-1] for r in found(spark, rows, None, 100, 100)] == [None, "storage_bytes", None]
    assert found(spark, rows, 1, 100, 100) == by_hand(rows, 1, 100)


@pytest.mark.parametrize(("per_day", "storage", "sizes", "hot"), [(None, 600, [1, 5, 90, None], 40), (15, 500, [1, 30, 200], 40), (15, None, [3], 40), (7, 300, [64, 32, 16, 8, 4, 2, 1], 1000), (0, 5, [0, 9], 30), (None, None, [5], 30)])
def test_equals_a_loop(spark, per_day, storage, sizes, hot):
    rows = made(300, hot, sizes)
    assert found(spark, rows, per_day, storage, hot) == by_hand(rows, per_day, storage)


@pytest.mark.parametrize(("per_day", "storage", "hot"), [(3, 900, 30), (3, None, 30), (2, 300, 1000), (None, 700, 25), (20, 2000, 30)])
@pytest.mark.parametrize("length", [1, 7, 45])
def test_a_day_that_comes_back_is_counted_anew(spark, per_day, storage, hot, length):
    rng = random.Random(length)
    rows = [(rng.choice(["a", "a", "a", "b"]), k, f"2024-01-0{k // length % 3 + 1}", rng.choice([1, 5, 30])) for k in range(300)]
    assert found(spark, rows, per_day, storage, hot) == by_hand(rows, per_day, storage)


def test_empty_and_null_orders(spark):
    empty = spark.createDataFrame([], "tenant string, seq long, day string, size long")
    assert quota.within_quota(empty, "tenant", F.col("day"), "seq", F.col("size"), 1, 1).count() == 0
    rows = spark.createDataFrame([("a", 2, "d", 60), ("a", None, "d", 50)], "tenant string, seq long, day string, size long")
    got = quota.within_quota(rows, "tenant", F.col("day"), "seq", F.col("size"), None, 100).collect()
    assert {(r.seq, r.breach) for r in got} == {(None, None), (2, "storage_bytes")}


def test_stream_equals_batch(spark, tmp_path):
    rows = [(t or "n", *r) for t, *r in made(120, 3, [1, 30, 200])]
    for k in range(3):
        spark.createDataFrame(rows[40 * k : 40 * k + 40], "tenant string, seq long, day string, size long").coalesce(1).write.json(str(tmp_path / f"in/{k}"))
    asked = spark.readStream.schema("tenant string, seq long, day string, size long").option("maxFilesPerTrigger", 1).option("latestFirst", "false").json(str(tmp_path / "in/*"))
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = quota.stream(asked, 15, 500).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        assert q.awaitTermination(300)
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = sorted(((r.tenant, r.seq, r.records_today, r.storage_bytes, r.breach) for r in spark.read.parquet(str(tmp_path / "out")).collect()), key=repr)
    assert got == by_hand(rows, 15, 500)


@pytest.mark.parametrize(("kind", "make"), [("long", lambda k: k), ("double", lambda k: k / 7), ("string", lambda k: f"run-{k:05d}"), ("date", None), ("timestamp", None)])
def test_running_over_hot_keys(spark, kind, make):
    import datetime

    make = make or (lambda k: datetime.date(2024, 1, 1) + datetime.timedelta(days=k) if kind == "date" else datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=k))
    rng = random.Random(1)
    rows = [(rng.choice(["a"] * 6 + ["b", None]), make(rng.randrange(200)), k, k % 9) for k in range(600)] + [("a", None, 1000, 5), ("a", None, 1001, 7), ("a", make(40), 1002, None)]
    if kind in ("long", "double"):
        rows.append(("a", make(10**15), 1003, 1))  # an outlier leaves the other ranges as they are
    df = spark.createDataFrame(rows, f"key string, at {kind}, tie long, v long")
    cut = ranges(df, ["key"], "at", 50)
    sizes = [r["count"] for r in cut.where("key = 'a'").groupBy("_part").count().collect()]
    assert max(sizes) < 100 and cut.count() == len(rows) and cut.where("key = 'b' and _part is null").isEmpty()
    want, sums = [], {}
    for key, at, tie, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1] is not None, r[1] if r[1] is not None else 0, r[2])):
        sums[key] = sums.get(key, 0) + (v or 0)
        want.append((key, at, tie, v, sums[key]))
    for hot in (50, 100_000):
        got = running(df, ["key"], "at", {"s": F.col("v")}, ("tie",), hot)
        assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_ranks_of_hot_values(spark):
    rows = [("a", float(k % 97)) for k in range(500)] + [("b", 1.0), ("b", None)]
    df = spark.createDataFrame(rows, "key string, v double")
    for hot in (20, 10_000):
        got = {r.key: (r.n, r.mid) for r in at_ranks(df, ["key"], "v", {"mid": F.floor(F.col("n") / 2)}, hot).collect()}
        assert got == {"a": (500, sorted(float(k % 97) for k in range(500))[250]), "b": (1, 1.0)}


def test_retention_refuses_ages_that_cross(spark):
    days = spark.createDataFrame([("2024-01-01",)], "dt string")
    for hot, gone in ((-1, None), (10, 5)):
        with pytest.raises(ValueError):
            routing.retention(days, "dt", F.current_timestamp(), hot, gone)


def test_no_task_of_the_ranges_reads_a_whole_key(spark):
    import io
    from contextlib import redirect_stdout

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cut = ranges(spark.createDataFrame([("a", k) for k in range(300)], "key string, at long"), ["key"], "at", 50)
        plan = io.StringIO()
        with redirect_stdout(plan):
            cut.explain()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan.getvalue() and "SortMergeJoin" not in plan.getvalue()
