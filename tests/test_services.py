"""Ingestion, tenants, registry, runs, reports, synthesis, scrubbing and stores on small rows."""

import base64
import json

from pyspark.sql import functions as F

from loomtrace import schema_files, schemas
from loomtrace.functions import scrub, stats
from loomtrace.operators import boosting, ingestion, lint, registry, replay, reports, runs, storage, store, synthesis, tenancy
from loomtrace.sources import jsonl

AEP = schemas.AEP.replace("\n", " ")


def put(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    return str(path)


def test_ingestion_and_signatures(spark, tmp_path):
    key, prefix = b"k" * 32, "KEY_"
    keys = {"KEY_A_1": base64.b64encode(key).decode()}
    verify = lambda k, s, p: k == key and s == b"good"
    sign = lambda sig: {"alg": "ed25519", "key_id": "a-1", "sig": base64.urlsafe_b64encode(sig).decode().rstrip("=")}
    check = lambda r: ingestion.signature_errors(r, keys, verify, prefix)
    assert check({"signature": sign(b"good")}) == [] and "failed" in check({"signature": sign(b"bad!")})[0]
    assert [bool(check(r)) for r in ({}, {"signature": {"alg": "x"}}, {"signature": {"alg": "ed25519", "key_id": "z", "sig": "aa"}})] == [True] * 3
    rows = [{"schema_version": "aep/v0.2", "run_id": "r", "created_at_ms": 1.0, "user_id": "u", "actions": [{"action_id": "1", "state_changing": True, "result_digest": "d", "parent_action_id": "0"}], "signature": sign(b"good")}, {"schema_version": "x", "run_id": "s", "created_at_ms": 1.0}, {"schema_version": "aep/v0.1", "run_id": "t", "created_at_ms": 1.0}]
    p = put(tmp_path / "a.jsonl", rows)
    raw = jsonl.lines(spark, p)
    parsed = raw.select("value", F.from_json("value", AEP).alias("r")).select("value", "r.*")
    out = ingestion.ingest(parsed, value="value", signature=ingestion.signatures(F.col("value"), verify, keys, prefix))
    got = {r.run_id: r for r in out.collect()}
    assert {k: r.passed for k, r in got.items()} == {"r": True, "s": False, "t": False}
    assert got["r"].n_causal_fields == 1 and got["r"].n_run_fields == 1 and got["r"].evidence_completeness == 1.0 and got["s"].errors[0].startswith("schema")
    t = ingestion.totals(ingestion.ingested(out)).first()
    assert (t.total_records, t.valid_count, t.invalid_count) == (3, 1, 2)


def test_tenants(spark, tmp_path):
    cols = "tenant_id string, subject_id string, n_bytes long, day date"
    import datetime

    day = datetime.date(2024, 1, 1)
    batch = spark.createDataFrame([("a", "x", 5, day), ("a", "y", 5, day), ("b", "z", 5, day)], cols)
    held = spark.createDataFrame([("a", "x", 7, day)], cols)
    quotas = spark.createDataFrame([("a", 2, None, None), ("b", None, 100, 1)], "tenant_id string, max_records_per_day long, max_storage_bytes long, max_subjects long")
    log = tenancy.AuditLog(spark, str(tmp_path / "audit"))
    today = F.lit(day)
    assert [r.tenant_id for r in tenancy.ingest(batch, held, quotas, today, log).collect()] == ["b"]
    assert log.read("a").first().outcome == "blocked" and log.read(kind="ingest").count() == 1
    asked = spark.createDataFrame([("a", "p-1"), ("a", "q-1"), ("b", None)], "tenant_id string, subject_id string")
    log.append(tenancy.access(asked, {"a": ["p-"]}))
    assert log.read(kind="access_denied").count() == 1 and log.read(kind="query").count() == 2
    assert tenancy.usage(held, today=today).first().storage_bytes == 7


def test_registry_and_jobs(spark, tmp_path):
    reg = registry.Registry(spark, str(tmp_path / "reg"), ("model",))
    reg.register(id="m1", type="model", version="1")
    reg.register(id="m2", type="model", version="1", path="p", digest="d")
    reg.remove("m1")
    reg.rollback(id="m2", type="model", version="0", path="p", digest="d")
    assert [(r.id, r.version) for r in reg.list_by_type("model").collect()] == [("m2", "0")]
    digest = reg.save(lambda b: "sig")
    assert reg.index_digest() == digest
    assert [r.message for r in reg.verify(spark.createDataFrame([("p", b"x")], "path string, content binary")).collect()] == ["digest mismatch"]
    known = spark.createDataFrame([], registry.CHECKPOINT)
    entries = spark.createDataFrame([("c1", "sft", "v", "base", "ready", "", None, 5), ("c2", "dpo", "v", "c1", "ready", "", None, 9)], registry.CHECKPOINT)
    known = registry.register_checkpoints(entries, known)
    assert registry.latest(known).first().checkpoint_id == "c2" and registry.latest(known, "sft").first().checkpoint_id == "c1"
    rows = spark.createDataFrame([(0, "a"), (1, "b")], "seq long, text string")
    job = registry.job_manifest(rows, "seq", "sft", str(tmp_path / "job"))
    assert registry.load_json(spark, str(tmp_path / "job" / "training-job.manifest"))["job_id"] == job["job_id"]


def test_runs_and_router_training(spark, tmp_path):
    def run(i, mode, passed):
        return {"task_id": f"t.{i}", "model": "qwen", "mode": mode, "final_pass": passed, "repair_rounds": i % 3, "latency_ms": float(i), "token_cost": {"prompt": i, "generation": 2 * i}, "violations": [{"level": "hard", "category": "format"}] * (i % 4)}

    put(tmp_path / "one" / "runs.jsonl", [run(i, m, (i % 4 == 0) if m == "direct" else i % 2 == 0) for i in range(40) for m in ("direct", "full_pcl")])
    rows = runs.load(spark, {"one": 42, "absent": 43}, str(tmp_path))
    assert rows.count() == 80 and rows.first().seed == 42
    found = runs.samples(rows)
    assert {r.label: r["count"] for r in found.groupBy("label").count().collect()} == {"small_model_can_handle": 10, "need_repair": 10, "need_large_model": 20}
    record = runs.router_records(found).where("task_id = 't.3@one'").first()
    assert record.features.eval_generation_tokens == 6 and record.features.taskspec_n_hard == 3
    trained = runs.train(found, folds=2, settings=boosting.Settings(rounds=6, depth=3, rate=0.5, share=1.0, least=1))
    assert trained["accuracy"] > 0.8 and abs(sum(trained["importances"].values()) - 1) < 1e-9
    fixed = runs.static_features(runs.router_records(found))
    assert fixed.columns == ["task_id", "label", *runs.STATIC] and fixed.where("task_id = 't.3@one'").first().taskspec_n_hard == 3.0
    assert runs.evaluation(rows, F.lit("A")).where("task_id = 't.5'").first().prompt_tokens == 5
    assert [r.task_id for r in runs.held_out(rows, 2).collect()] == ["t.39", "t.38"]
    assert runs.summary(rows).where("mode is null and model is null").first().n == 80
    assert runs.first_lines(rows.withColumn("line", F.lit(1)), 7).orderBy("seq").select("seq").collect() == rows.orderBy("seq").select("seq").limit(7).collect()


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("m", 13, 22), ("none", 0, 0)], "model_id string, pass_count int, n_trials int")
    assert "0.591 | 0.387 | 0.767" in reports.benchmark_table(rows) and "| none | 0 | 0 | 0.000 |" in reports.benchmark_table(rows)
    (tmp_path / "task").mkdir()
    (tmp_path / "task" / "answer.txt").write_text("42")
    found = lint.findings(lint.listing(spark, str(tmp_path / "task")))
    records = jsonl.read(spark, put(tmp_path / "e.jsonl", [{"schema_version": "aep/v0.2", "run_id": "r", "created_at_ms": 1.0, "repo_commit": "c"}]), AEP, strict=False)
    text = reports.audit("Audit", "2024-01-01", ingestion.validated(records), records, {"task": found}, [{"run_id": "r1", "receipt_digest": "ab"}])
    assert "**1 pass, 0 fail**" in text and "1/1 (100%)" in text and "gold-answer-readable" in text and "### r1" in text
    assert "S1" in reports.taxonomy() and reports.surfaces(found).count() == 2
    texts = spark.createDataFrame([("write a@b.com",), ("none",)], "t string")
    assert reports.redaction(texts, ["t"])["n_fields_modified"] == 1
    read = spark.createDataFrame([(0.01, 0.4, 0.0), (0.05, 0.15, 0.2), (0.2, 0.1, None)], "p double, lottery_rate double, first_class_rate double")
    assert [tuple(r) for r in read.select(*reports.reading(F.col("p"), F.col("lottery_rate"), F.col("first_class_rate"))).collect()] == [("significant", "high", "gamma"), ("marginal", "moderate", "alpha"), ("not_significant", "low", None)]
    put(tmp_path / "w.json", [])
    said = lambda *v: [{"id": f"q{k}", "correct": x} if x is not None else {"id": f"q{k}"} for k, x in enumerate(v)]
    for name, rows_ in (("w", said(True, True, True, False, None, True)), ("b", said(True, False, False, True, True) + [{"id": "q0", "correct": False}])):
        (tmp_path / f"{name}.json").write_text(json.dumps({"results": rows_}))
    (tmp_path / "sc.json").write_text(json.dumps({"n_tested": 65, "lottery_count": 25, "lottery_rate": 0.3846}))
    one = reports.paired_audit(jsonl.results(spark, str(tmp_path / "w.json")), jsonl.results(spark, str(tmp_path / "b.json")), reports.rates(spark, str(tmp_path / "sc.json"))).first()
    assert (one.n, one.winner_correct, one.baseline_correct, one.baseline_only, one.winner_only) == (4, 3, 1, 1, 3)
    assert one.p == 0.625 and one.lottery == "high" and one.channel is None and one.significance == "not_significant"
    assert reports.unfilled(reports.card("n", {"a": 1}, template="{name} {other}")) == ["{other}"]


def test_synthesis_and_scrubbing(spark, tmp_path):
    tasks = spark.createDataFrame([("a", "write", None), ("b", "search", ["web"])], "task_id string, intent string, allowed_tools array<string>")
    rules = spark.createDataFrame([("a", "c1", "be short", "content", None), ("a", "c2", "be right", "style", 90), ("a", "c3", "cite", "content", 95)], "task_id string, constraint_id string, desc string, category string, priority int")
    specs = synthesis.specs(tasks, rules)
    a, b = specs.orderBy("task_id").collect()
    assert [(c.constraint_id, c.level, c.verify_method, c.priority) for c in a.constraints] == [("c3", "hard", "section_presence", 95), ("c2", "hard", "schema_validate", 90), ("c1", "hard", "section_presence", 70)]
    assert (b.constraints, b.allowed_tools, b.language, b.max_rounds) == ([], ["web"], "en", 3)
    specs.coalesce(1).write.json(str(tmp_path / "specs"))
    loaded = synthesis.load(spark, str(tmp_path / "specs"))
    made = synthesis.generate(loaded, lambda m: m[0]["content"][:20], 2, 2).collect()
    assert sorted((r.task_id, r.output_type) for r in made) == [("a", "final_answer")] * 2 + [("a", "preference")] * 2 + [("a", "repair_patch")] * 2 + [("b", "final_answer")] * 2
    assert {tuple(r) for r in made} == {tuple(r) for r in synthesis.generate(loaded.repartition(3), lambda m: m[0]["content"][:20], 2, 2).collect()}
    line = {"task_id": "t", "model": "m", "mode": "full", "artifact": "bad", "final_pass": False, "violations": [{"constraint_id": "c", "level": "hard", "category": "format", "hint": "fix it"}]}
    runs_ = jsonl.read(spark, put(tmp_path / "r.jsonl", [line, line | {"task_id": "u", "final_pass": True, "violations": [], "artifact": "good"}]), schemas.COMPLIANCE.replace("\n", " "))
    assert {(r.task_id, r.assistant) for r in synthesis.from_compliance(runs_, lambda m: "patch").collect()} == {("t", "patch"), ("u", "good")}
    notes = spark.createDataFrame([([("recovery",), ("high_value",)],), ([],), (None,)], "a array<struct<loss_weight_tokens:string>>")
    assert [r.x for r in notes.select(synthesis.collapsed(F.col("a")).alias("x")).collect()] == ["high_value", "default", "default"]
    message = {"role": "a@b.com", "content": [{"x-api-key": "z", "deep": ["mail a@b.com", 3]}]}
    df = spark.createDataFrame([(json.dumps(message),)], "m string")
    got = df.select(scrub.json_text(F.col("m")).alias("all"), scrub.message(F.col("m")).alias("own")).first()
    assert json.loads(got.all)["role"] == "[REDACTED]" and json.loads(got.own) == {"role": "a@b.com", "content": [{"x-api-key": "[REDACTED]", "deep": ["mail [REDACTED]", 3]}]}


def test_stores_and_schemas(spark, tmp_path):
    now = [0.0]
    cache = store.Cache(2, 10, lambda: now[0])
    for k in "abc":
        cache.set(k, k)
    assert cache.get("a") is None and cache.get("c") == "c"
    now[0] = 11.0
    assert cache.get("c") is None
    ev = spark.createDataFrame([("3", "2024-01-01", 1), ("4", "2024-03-01", 2)], "subject_id string, day string, v int")
    hot, cold = (storage.TraceStore(spark, str(tmp_path / n)) for n in ("hot", "cold"))
    hot.write(ev, F.col("day").cast("timestamp"))
    plan = spark.createDataFrame([("3", "2024-01-01", "migrate", "hot"), ("4", "2024-03-01", "keep", "hot")], "p_key string, dt string, action string, tier string")
    storage.apply(hot, cold, plan, dry_run=True)
    storage.apply(hot, cold, plan)
    assert [r.v for r in cold.read().collect()] == [1] and [r.v for r in hot.read().collect()] == [2]
    made = schema_files.generated(spark)
    files = spark.createDataFrame([("rollout", json.dumps(made["rollout"])), ("evaluation", "{}")], "name string, text string")
    assert {r.name: r.status for r in schema_files.drift(spark, files).collect()} == {"rollout": "same", "compliance": "missing", "evaluation": "drift", "evidence": "missing"}
    lines = spark.createDataFrame([('{"task_id": "a"}',), ("{bad",), ("{}",)], "value string")
    r = schema_files.parse_errors(lines, "compliance", ("task_id",)).first()
    assert (r.n, r.n_unparsed, r.n_lacking) == (3, 1, 1)


def test_replay_stops_and_cassettes():
    acts = [{"action_id": "1", "tool_name": "t", "state_changing": True, "result_digest": "d", "post_state_digest": "s"}, {"action_id": "2", "pre_state_digest": "wrong", "result_digest": "e"}]
    assert replay.fold(acts)["determinism_score"] == 0.5
    good = replay.digest({"_seed": 0, "post_state:1": "s"})
    assert replay.fold([acts[0], acts[1] | {"pre_state_digest": good}])["determinism_score"] == 1.0
    stopped = replay.fold(acts, stop_at="2")
    assert (stopped["stop_reason"], stopped["n_replayed"], json.loads(stopped["state"])["post_state:1"]) == ("action_id", 1, "s")
    first = replay.fold([acts[1], acts[0]], stop_at_mismatch=True)
    assert (first["stop_reason"], json.loads(first["state"])) == ("mismatch", {"_seed": 0})
    assert [m["kind"] for m in replay.fold(acts[:1], cassette=[])["mismatches"]] == ["side_effect"]
    a, b = stats.paired_outcomes(2000, 0.65, 0.65, 0.5, 1)
    assert abs(sum(a) / 2000 - 0.65) < 0.04 and abs(sum(b) / 2000 - 0.65) < 0.04


def test_positions_over_splits(spark, tmp_path):
    p = put(tmp_path / "x.jsonl", [json.dumps({"correct": i % 3 == 0, "pad": "y" * 200}) for i in range(2000)])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = jsonl.correctness(spark, p).orderBy("position").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r.position, r.correct) for r in rows] == [(i, i % 3 == 0) for i in range(2000)]


def test_smaller_parts(spark, tmp_path):
    from loomtrace.functions import scrub as s
    from loomtrace.streaming import compliance

    p = put(tmp_path / "router.jsonl", [{"task_id": "t", "features": {"taskspec_n_hard": 2}, "label": "need_repair", "provenance": {"source": "x"}}])
    r = runs.load_router_records(spark, p).first()
    assert (r.features.taskspec_n_hard, r.label, r.provenance.source) == (2, "need_repair", "x")
    found = stats.self_test(spark, 60, 0.6, 0.6, seeds=3, n_iter=50)
    assert stats.self_test_summary(found).first().n_seeds == 3 and all(x.ci_lo <= x.delta <= x.ci_hi for x in found.collect())
    checked = spark.createDataFrame([("s", "1", 1, "aep_schema", None), ("s", "2", 2, None, "evidence_complete"), ("s", "3", 3, "no_injection_signal", None), ("s", "4", 4, None, None)], "subject string, run_id string, seq long, hard string, soft string")
    scores = spark.createDataFrame([("2", 0.5, "audit_only"), ("1", 0.1, "reject")], "run_id string, score double, category string")
    got = {x.run_id: x for x in compliance.feedback(checked, scores, 1).collect()}
    assert [v.constraint_id for v in got["3"].violations] == ["no_injection_signal", "subject_violation_budget"] and got["1"].violations[0].category == "format"
    assert got["2"].category == "audit_only" and got["1"].score is None and got["4"].verdict == "quarantine"
