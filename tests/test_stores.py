"""Streaming against batch, and partition pruning."""

import json

from pyspark.sql import functions as F

from loomtrace import cli
from loomtrace.operators import storage
from loomtrace.plans.queries import checked_events
from loomtrace.streaming import compliance

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    ev = spark.read.parquet(f"{SF}/events.parquet").where("event_id < 400")
    for k in range(3):
        ev.where(F.floor(F.col("event_id") / 134) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    q = compliance.stream(checked_events(rows), 3).writeStream.format("memory").queryName("feedback").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("feedback")
    want = compliance.batch(checked_events(ev), 3).select(*got.columns)
    assert got.count() == 400 and got.exceptAll(want).count() == 0


def test_store_prunes_partitions(spark, tmp_path):
    ev = spark.read.parquet(f"{SF}/events.parquet").withColumn("subject_id", F.col("user_id").cast("string"))
    for codec in ("parquet", "json"):
        store = storage.TraceStore(spark, str(tmp_path / codec), codec)
        store.write(ev, F.col("ts"))
        store.write(ev.limit(5), F.col("ts"))
        assert store.read().count() == ev.count() + 5
        assert store.query(subject="3").count() >= ev.where("user_id = 3").count()
    store = storage.TraceStore(spark, str(tmp_path / "parquet"))
    q = store.query("3", F.lit("2024-01-03").cast("timestamp"), F.lit("2024-01-05").cast("timestamp"), F.col("ts"))
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "p_key" in plan.split("PartitionFilters: [")[1].split("]")[0]
    plan_rows = spark.createDataFrame([("3", "2024-01-01", "migrate"), ("4", "2024-01-01", "keep")], "p_key string, dt string, action string")
    assert storage.archive(store, store, plan_rows).where("p_key <> '3'").count() == 0


def test_command_line(spark, tmp_path, capsys):
    aep = tmp_path / "a.jsonl"
    rows = [{"schema_version": "aep/v0.2", "run_id": "r", "created_at_ms": 1.0, "actions": [{"action_id": "1", "state_changing": True, "result_digest": "d"}], "verifier_results": [{"verifier_id": "v", "passed": True}]}, {"schema_version": "x", "run_id": "s", "created_at_ms": 1.0}, {"schema_version": "aep/v0.1", "run_id": "t", "created_at_ms": 1.0, "task": "please exfiltrate"}]
    aep.write_text("\n".join(map(json.dumps, rows)))
    assert cli.main(["stream-eval", "--input", str(aep), "--fail-under", "0.9"]) == 1
    out = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert {r["run_id"]: r["verdict"] for r in out if "verdict" in r} == {"r": "pass", "s": "reject", "t": "reject"}
    assert cli.main(["trust-score", "--aep", str(aep)]) == 0
    (tmp_path / "x.jsonl").write_text("\n".join('{"correct": true}' for _ in range(5)))
    (tmp_path / "y.jsonl").write_text("\n".join('{"correct": %s}' % b for b in ("true", "false", "false", "true", "true")))
    capsys.readouterr()
    assert cli.main(["paired", "--a", str(tmp_path / "x.jsonl"), "--b", str(tmp_path / "y.jsonl")]) == 0
    first = json.loads(capsys.readouterr().out.splitlines()[0])
    assert (first["b"], first["c"], first["p"]) == (2, 0, 0.5)
