"""Stores whose keys may be anything, refreshed scores, and streams that are killed and begun again."""

import json
import random

import pytest
from pyspark.sql import functions as F

from loomtrace import cli
from loomtrace.functions.running import at_ranks
from loomtrace.operators import storage, store, trust
from loomtrace.plans import adapters
from loomtrace.streaming import latency, service

SF = "/root/testdata/sf0.001"
KEYS = ["user:1", "007", "7", "a/b", None, "", "x=y %20", "1e3", "ü"]


@pytest.mark.parametrize("codec", ["parquet", "json"])
def test_any_key_is_archived_once(spark, tmp_path, codec):
    rows = [(k, day, i) for i, (k, day) in enumerate((k, d) for k in KEYS for d in ("2024-01-01", "2024-03-01"))]
    df = spark.createDataFrame(rows, "subject_id string, day string, v int")
    hot, cold = (storage.TraceStore(spark, str(tmp_path / n), codec) for n in ("hot", "cold"))
    assert not hot.exists() and not hot.delete("a", "2024-01-01")
    for _ in range(2):  # the second replaces the first
        hot.write(df, F.col("day").cast("timestamp"), batch="000")
    assert sorted(r.v for r in hot.read().collect()) == list(range(18))
    assert [r.v for r in hot.query("007", time=F.col("day")).collect()] == [2, 3] and [r.v for r in hot.query("7", time=F.col("day")).collect()] == [4, 5]
    plan = hot.partitions().select("p_key", "dt", F.when(F.col("dt") < "2024-02-01", "migrate").otherwise("keep").alias("action"))
    kept = [tuple(r) for r in plan.collect()]
    plan = spark.createDataFrame(kept, plan.schema)
    assert len(kept) == 16  # null and empty keys are one
    both = lambda: sorted(r.v for r in storage.read_both(hot, cold).collect())
    cold._put(storage.archive(hot, cold, plan))  # a run that died before it removed anything
    assert both() == list(range(18))
    for _ in range(2):
        storage.apply(hot, cold, plan)
        assert sorted(r.v for r in cold.read().collect()) == list(range(0, 18, 2)) and sorted(r.v for r in hot.read().collect()) == list(range(1, 18, 2))
        assert both() == list(range(18))
    assert hot.delete("user:1", "2024-03-01") and 1 not in both()
    storage.apply(hot, cold, spark.createDataFrame([("user:1", "2024-01-01", "delete", "cold")], "p_key string, dt string, action string, tier string"))
    assert 0 not in both() and len(both()) == 16


def test_two_refreshes_equal_one(spark, tmp_path):
    rows = adapters.evidence(spark, SF)
    whole = store.TrustStore(spark, str(tmp_path / "whole"))
    want = {r.subject: r for r in whole.refresh(rows).drop("computed_at_ms").collect()}
    parts = store.TrustStore(spark, str(tmp_path / "parts"))
    parts.refresh(rows.where("seq % 3 = 0"), batch="01")
    parts.refresh(rows.where("seq % 3 = 1"), batch="1")
    for _ in range(2):  # a batch that runs again changes nothing
        got = {r.subject: r for r in parts.refresh(rows.where("seq % 3 = 2"), batch="2").drop("computed_at_ms").collect()}
    assert got.keys() == want.keys() and len(want) > 50
    for s, r in want.items():
        assert all(a == b or a == pytest.approx(b) for a, b in zip(got[s], r))
    direct = {r.subject_id: r.n_records for r in trust.by_subject(rows, "subject_id", "seq").collect()}
    some = next(iter(want))
    assert parts.get(some)["n_records"] == direct[int(some)] and parts.get("nobody") is None
    parts.compact()
    assert {r.subject: r.n_records for r in parts.all().collect()} == {s: r.n_records for s, r in want.items()}
    parts.backend.clear()
    assert parts.get(some)["n_records"] == direct[int(some)]


def test_sketches_of_batches_in_any_order(spark, tmp_path):
    rng = random.Random(6)
    values = [(k, rng.choice("ab"), rng.lognormvariate(3, 1)) for k in range(40_000)]
    df = spark.createDataFrame(values, "batch int, key string, ms double").withColumn("batch", F.col("batch") % 70).cache()
    held = latency.States(spark, str(tmp_path / "s"), ["key"], ("n_odd",))
    with pytest.raises(FileNotFoundError):
        held.read()
    order = list(range(70))
    for b in [*order[:20], *order[10:20], *order[20:], 69, 3]:  # some run again
        held.add(latency.state(df.where(F.col("batch") == b), ["key"], F.col("ms"), 20.0, {"n_odd": F.lit(1)}), b)
    assert len(held._numbers("upto")) == 1 and len(held._numbers("batch")) < latency.EVERY
    got = {r.key: r for r in latency.summary(held.read(), ["key"], ("n_odd",)).collect()}
    ranks = {r.key: r for r in at_ranks(df, ["key"], "ms", {"low": (F.col("n") * 0.985).cast("long"), "high": (F.col("n") * 0.995).cast("long")}).collect()}
    for key in "ab":
        own = [v for _, k, v in values if k == key]
        assert got[key].n == got[key].n_odd == len(own) and got[key].max_ms == max(own) and got[key].mean_ms == pytest.approx(sum(own) / len(own))
        assert got[key].within_sla == pytest.approx(sum(v <= 20 for v in own) / len(own))
        assert ranks[key].low <= got[key].p99_ms <= ranks[key].high
    assert held.read().agg(F.max(F.length("sketch"))).first()[0] < 60_000
    few = latency.summary(latency.state(spark.createDataFrame([(1.0,), (2.0,), (9.0,)], "ms double"), [], F.col("ms"), 5.0), [])
    assert few.first().p99_ms == 9.0


def records(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))


def good(run, subject="s", **more):
    return {"schema_version": "aep/v0.2", "run_id": run, "created_at_ms": float(run), "subject_id": subject, "repo_commit": "c", "model_id": "m"} | more


def test_ingestion_that_dies_gives_each_row_once(spark, tmp_path, monkeypatch):
    for k in range(3):
        records(tmp_path / "in", f"{k}.jsonl", [good(f"{10 * k + j}", f"u{j}") for j in range(5)] + [good(f"{10 * k + 9}", schema_version="aep/v9"), "{broken"])
    root, check = str(tmp_path / "out"), str(tmp_path / "check")
    run = lambda: service.ingest(service.source(spark, str(tmp_path / "in"), 1), root, check)
    real, calls = service.tenancy.events, []

    def dies(*args, **kw):
        calls.append(1)
        if len(calls) == 2:  # the second batch, two of its sinks written
            raise RuntimeError("killed")
        return real(*args, **kw)

    monkeypatch.setattr(service.tenancy, "events", dies)
    with pytest.raises(Exception, match="killed"):
        run().awaitTermination()
    assert run().awaitTermination(300) and run().awaitTermination(300)
    accepted, refused, audit = (spark.read.parquet(f"{root}/{n}") for n in ("accepted", "refused", "audit"))
    assert sorted(int(r.run_id) for r in accepted.collect()) == sorted(10 * k + j for k in range(3) for j in range(5))
    assert refused.count() == 6 and refused.where(F.array_contains("errors", "schema: unknown version aep/v9")).count() == 3
    assert audit.agg(F.sum(F.col("detail")["n"].cast("int"))).first()[0] == 21 and accepted.select("batch").distinct().count() == 3


def test_stream_eval_continues(spark, tmp_path, capsys):
    bad = {"objective_score": 7.0}
    records(tmp_path / "in", "a.jsonl", [good("1"), good("2", **bad), good("3", **bad)])
    flags = ["stream-eval", "--input", str(tmp_path / "in"), "--out", str(tmp_path / "o"), "--checkpoint", str(tmp_path / "c"), "--max-hard-per-subject", "2", "--most-files", "1"]

    def said(*more):
        capsys.readouterr()
        code = cli.main([*flags, *more])
        lines = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
        return code, {r["run_id"]: (r["verdict"], r["n_hard"], r.get("admission_category")) for r in lines[:-1]}, lines[-1]

    code, rows, total = said()
    assert code == 0 and rows["2"] == ("reject", 1, None) and rows["1"][2] == "train_router" and total["n"] == 3 and total["p99_ms"] > 0
    records(tmp_path / "in", "b.jsonl", [good("4", **bad), good("5"), good("6", "other")])
    code, rows, total = said("--fail-under", "0.9")
    assert code == 1 and {k: v[:2] for k, v in rows.items()} == {"1": ("pass", 0), "2": ("reject", 1), "3": ("reject", 2), "4": ("reject", 3), "5": ("quarantine", 3), "6": ("pass", 0)}
    assert (total["n"], total["n_pass"], total["n_quarantine"], total["n_reject"]) == (6, 2, 1, 3)
    code, again, total = said("--fail-under-sla", "1.1")
    assert code == 1 and again == rows and total["n"] == 6
    assert cli.main([*flags, "--require-signature"]) == 2


def refuses(key, signature, payload):
    return False


def test_stream_eval_checks_signatures(spark, tmp_path, capsys, monkeypatch):
    records(tmp_path / "in", "a.jsonl", [good("1")])
    assert cli.main(["stream-eval", "--input", str(tmp_path / "in"), "--require-signature", "--verifier", "tests.test_streams:refuses", "--no-admission"]) == 0
    row = next(json.loads(x) for x in capsys.readouterr().out.splitlines() if "verdict" in x)
    assert (row["verdict"], row["hard"]) == ("reject", "aep_signature") and "admission" not in row


def test_commands_with_their_flags(spark, tmp_path, capsys):
    records(tmp_path / "v", "rows.jsonl", [{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "the quick brown fox jumps over the lazy dog today"}]}, {"messages": []}])
    records(tmp_path / "v", "items.jsonl", [{"item_id": "i", "text": "the quick brown fox jumps over the lazy dog today"}])
    flags = ["validate", "--input", str(tmp_path / "v" / "rows.jsonl"), "--eval-items", str(tmp_path / "v" / "items.jsonl")]
    assert cli.main(flags) == 0 and cli.main([*flags, "--strict"]) == 1
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert any(r.get("jaccard") == 1.0 for r in lines)


def test_reasons_and_types(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "output_type string")
    from loomtrace.operators import quality

    assert {r.output_type: (r.n, r.share) for r in quality.output_types(rows).collect()} == {"a": (1, 0.25), "b": (2, 0.5), None: (1, 0.25)}
    scored = {r.run_id: r for r in trust.admission(adapters.evidence(spark, SF)).collect()}
    for r in scored.values():
        assert (trust.REASONS[3] in r.reasons) == (r.provenance == 0.5) and (trust.REASONS[2] in r.reasons) == (r.verifier_strength == 0.0)
