"""Readers, converters, importers and checks on small hand-made rows."""

import json

import pytest
from pyspark.sql import functions as F

from loomtrace import schemas
from loomtrace.operators import contamination, datasets, harness, lineage, lint, metrics, quality, replay, routing, telemetry, training, trust
from loomtrace.plans import export
from loomtrace.sources import importers, jsonl


def put(tmp_path, name, rows):
    p = tmp_path / name
    p.write_text("\n".join(r if isinstance(r, str) else json.dumps(r, ensure_ascii=False) for r in rows))
    return str(p)


def branch(i, score, **more):
    return {"rollout_id": "r1", "task": "Write a two-sentence summary of the water cycle.", "branch_index": i, "final_answer": f"answer {i}", "objective_score": score, "objective_status": "pass" if score else "fail", "total_score": float(score), "tool_call_sequence": []} | more


CALLS = [
    {"event": "tool_result", "data": {"callId": "c1", "output": "ok"}},
    {"event": "tool_call", "data": {"callId": "c1", "toolName": "search", "args": "{\"q\": 1}"}},
    {"event": "tool_call", "data": {"callId": "c2", "toolName": "shell"}},
    {"event": "tool_result", "data": {"callId": "c2", "error": "boom"}},
]


def test_rollouts_and_flagship(spark, tmp_path):
    p = put(tmp_path, "r.jsonl", ["# note", "", branch(0, 1, tool_call_sequence=CALLS), branch(1, 0), {"rollout_id": "t", "fork_map": None}])
    rows = jsonl.rollouts(spark, p)
    assert rows.count() == 2
    first = rows.where("branch_index = 0").first()
    assert [(c.tool_name, c.result, c.error) for c in first.tools] == [("search", "ok", None), ("shell", None, "boom")]
    sft = training.sft(rows).collect()
    assert len(sft) == 1 and sft[0].task_hash == "fad7e1bace9f56d3"
    assert [m.role for m in sft[0].messages] == ["user", "assistant", "tool", "assistant", "tool", "assistant"]
    dpo = training.dpo(rows).collect()
    assert [(r.chosen, r.rejected) for r in dpo] == [("answer 0", "answer 1")] and training.ppo(rows).count() == 2
    assert training.episode_steps(rows).count() == 5 + 1 and training.transitions(rows).count() == 3 + 1
    manifest = export.run(spark, str(tmp_path / "out"), p)
    assert (manifest["n_sft"], manifest["n_dpo"], manifest["n_ppo"]) == (1, 1, 2)


def test_preference_edges(spark):
    make = lambda rows: spark.createDataFrame(rows, schemas.ROLLOUT.replace("\n", " "))
    row = lambda rid, i, score, status, total, signer=None: (rid, "t", i, 0.0, "s", [], f"a{i}", score, status, 0, total, signer)
    tied = make([row("x", 0, 1, "pass", 1.0), row("x", 1, 1, "pass", 1.0)])
    assert training.dpo(tied).count() == 0
    three = make([row("x", 2, 0, "fail", 0.0), row("x", 0, 1, "pass", 0.5), row("x", 1, 1, "pass", 0.5), row("x", 3, 0, "unknown", 9.0)])
    r = training.dpo(three).first()
    assert (r.chosen_branch, r.rejected_branch) == (0, 2)
    signed = make([row("x", 0, 1, "pass", 1.0, [("attested", ("k",))]), row("x", 1, 0, "fail", 0.0, [("self", ("k",))])])
    assert training.dpo(signed).count() == 0 and training.dpo(signed, require_attested=False).count() == 1


def test_lenient_reading_and_errors(spark, tmp_path):
    p = put(tmp_path, "a.jsonl", ['{"run_id": "a"}', "{bad", '{"run_id": "b"}'])
    rows = jsonl.read(spark, p, "run_id string", strict=False).collect()
    assert sum(r.error is not None for r in rows) == 1
    with pytest.raises(Exception):
        jsonl.read(spark, p, "run_id string").collect()


def test_correctness_and_samples(spark, tmp_path):
    a = put(tmp_path, "a.jsonl", [{"correct": True}, {"pass": True}, {}])
    b = put(tmp_path, "b.json", ['[true, false, null]'])
    c = put(tmp_path, "c.json", ['{"items": [{"correct": false}, {"pass": true}]}'])
    values = lambda p: [r.correct for r in jsonl.correctness(spark, p).orderBy("position").collect()]
    assert values(a) == [True, True, False] and values(b) == [True, False, False] and values(c) == [False, True]
    p = put(tmp_path, "s.jsonl", [{"doc_id": 0, "target": "42", "filtered_resps": [["it is 42"]]}, {"doc": {"idx": 7}, "answer": "x", "resps": ["y"], "acc": 1.0}, {"target": "no id"}])
    got = {r.id: r for r in jsonl.evaluation_samples(spark, p).collect()}
    assert got["0"].correct and got["0"].predicted == "42" and got["7"].correct and got["7"].gen_text == "y" and len(got) == 2


def test_compliance_rows(spark):
    v = [("c1", "hard", "format", "add a title"), ("c2", "soft", "style", "shorter")]
    rows = [("t1", "h" * 20, "m", "direct", v, [], 0, False, 1.0, "bad"), ("t1", "h" * 20, "m", "full_pcl", v, [(1, ["c1"], "s", True), (2, ["zz"], "s", True)], 2, True, 1.0, "good")]
    df = spark.createDataFrame(rows, schemas.COMPLIANCE.replace("\n", " ")).withColumn("seq", F.monotonically_increasing_id())
    sft = training.compliance_sft(df).orderBy("part").collect()
    assert [r.output_type for r in sft] == ["final_answer", "repair_patch"]
    assert sft[0].messages[0].content == '{"task_id": "t1", "mode": "full_pcl"}\n\nConstraint violations:\n- [hard/format] add a title\n- [soft/style] shorter'
    assert sft[1].messages[0].content.endswith("Round 1 violations:\n- [hard] add a title")
    assert training.compliance_sft(df, True).count() == 3
    bad = spark.createDataFrame([("t1", ["good ", "worse"])], "task_id string, bad array<string>")
    assert sorted(r.rejected[:5] for r in training.compliance_dpo(df, bad).collect()) == ["[pre-", "worse"]
    pair = training.cross_mode_dpo(df, "seq").first()
    assert (pair.chosen_mode, pair.rejected_mode, pair.loss_weight_tokens) == ("full_pcl", "direct", "recovery")


SAMPLES = {
    "bfcl": {"task_id": "b", "question": "q", "model_id": "m", "calls": [{"name": "f", "arguments": "{}"}], "pass_rate": 1.0, "raw_response": "r"},
    "mcp-atlas": {"task_id": "a", "user_query": "q", "model_id": "m", "trajectory": [{"step_index": 0, "server_id": "s", "tool_name": "t", "result": "x", "latency_ms": 5.0}], "claims": [{"claim_id": "k", "passed": True}], "claims_passed": 1, "claims_total": 2, "session_id": "z"},
    "tau-bench": {"task_id": "a", "user_query": "q", "rules": ["x", "y"], "model_id": "m", "turns": [{"role": "user"}, {"role": "agent", "tool_name": "t"}, {"role": "tool", "tool_result": "ok"}], "task_completed": True, "rule_violations": 1, "session_id": "z"},
    "terminal-bench": {"task_id": "a", "description": "d", "model_id": "m", "trajectory": [{"command": "ls", "output": "x", "exit_code": 0, "timestamp_ms": 3.0}, {"command": "no", "output": "", "exit_code": 1}], "passed": True, "session_id": "z"},
    "tool-sandbox": {"task_id": "a", "user_request": "q", "model_id": "m", "tool_calls": [{"tool_name": "t", "error": "bad"}], "success": False, "session_id": "z"},
    "agent-harm": {"task_id": "a", "harmful_instruction": "i", "harm_category": "fraud", "model_id": "m", "actions": [{"action_id": "1", "tool_name": "t", "was_prevented": True, "harm_category": "fraud"}], "refused": False, "harmful_actions_taken": 1, "session_id": "z"},
    "ms-agent-framework": {"run_id": "w", "model_id": "m", "steps": [{"id": "1", "name": "t", "type": "tool", "status": "failed", "started_at": "2024-01-01T00:00:01Z"}, {"id": "2", "name": "h", "type": "human", "status": "completed"}], "status": "partial", "session_id": "z"},
    "a2a-task": {"task_id": "a", "session_id": "z", "messages": [{"message_id": "1", "role": "agent", "content": "c", "timestamp": "2024-01-01T00:00:01Z"}], "artifacts": [{"artifact_id": "f"}], "status": "completed"},
}


def test_single_line_importers(spark, tmp_path):
    got = {k: importers.load(spark, k, put(tmp_path, k, [s]), "evidence" if k != "bfcl" else "rollout").first() for k, s in SAMPLES.items()}
    assert got["bfcl"].objective_status == "pass" and got["bfcl"].tools[0].result == "[bfcl-grader: f]"
    assert got["mcp-atlas"].verifier_results[0].verifier_id == "mcp-atlas-claim/k" and got["mcp-atlas"].actions[0].state_changing
    assert [v.passed for v in got["tau-bench"].verifier_results] == [False, True] and got["tau-bench"].verifier_results[0].score == 0.8 and got["tau-bench"].actions[0].action_id == "turn-1"
    assert [x.state_changing for x in got["terminal-bench"].actions] == [True, False]
    assert got["tool-sandbox"].capability_decisions[0].reason_code == "tool_error"
    assert got["agent-harm"].capability_decisions[0].reason_code == "harm_prevention:fraud" and not got["agent-harm"].verifier_results[0].passed and not got["agent-harm"].actions[0].state_changing
    assert len(got["ms-agent-framework"].verifier_results) == 1 and got["ms-agent-framework"].created_at_ms == 1704067201000.0 and got["ms-agent-framework"].capability_decisions[0].subject == "agent"
    assert got["a2a-task"].output_refs[0].uri == "a2a-artifact/f" and got["a2a-task"].verifier_results[0].passed
    tau = importers.load(spark, "tau-bench", put(tmp_path, "t", [SAMPLES["tau-bench"]]), "rollout").first()
    assert tau.objective_status == "fail" and tau.tools[0].result == "ok"
    with pytest.raises(ValueError):
        importers.load(spark, "bfcl", "x", "evidence")


def test_span_importers(spark, tmp_path):
    oai = [{"trace_id": "t", "span_id": "1", "type": "agent.run", "started_at": "2024-01-01T00:00:01Z", "session_id": "s", "agent_name": "ag"}, {"trace_id": "t", "span_id": "2", "type": "llm.generate", "attributes": {"model": "gp"}}, {"trace_id": "t", "span_id": "3", "type": "tool.call", "name": "n", "attributes": {"state_changing": True}, "error": "e"}, {"trace_id": "t", "span_id": "4", "type": "guardrail", "name": "g", "attributes": {"triggered": True}}]
    r = importers.load(spark, "oai-agents", put(tmp_path, "o", oai)).first()
    assert (r.model_id, r.created_at_ms, r.actions[0].tool_name, r.capability_decisions[0].subject, r.verifier_results[0].passed) == ("gp", 1704067201000.0, "n", "ag", False)
    ls = [{"id": "a", "name": "c", "run_type": "chain", "start_time": "2024-01-01T00:00:01Z"}, {"id": "b", "name": "l1", "run_type": "llm", "parent_run_id": "a"}, {"id": "c", "name": "tool", "run_type": "tool", "parent_run_id": "b", "outputs": {"x": 1}}, {"id": "d", "name": "l2", "run_type": "llm", "parent_run_id": "a"}, {"id": "z", "name": "q", "run_type": "chain", "parent_run_id": "gone", "error": "e"}]
    got = {x.trace_id: x for x in importers.load(spark, "langsmith", put(tmp_path, "l", ls)).collect()}
    assert set(got) == {"a", "z"} and got["a"].model_id == "l2" and got["a"].actions[0].state_changing and got["z"].capability_decisions[0].reason_code == "chain_error"
    adk = [{"trace_id": "t", "event_id": "1", "type": "model_response", "timestamp": "2024-01-01T00:00:01Z", "content": {"model": "gm"}}, {"trace_id": "t", "event_id": "2", "type": "function_call", "content": {"function_name": "f"}}, {"trace_id": "t", "event_id": "3", "type": "final_response"}]
    r = importers.load(spark, "adk", put(tmp_path, "k", adk)).first()
    assert (r.model_id, r.actions[0].tool_name, r.verifier_results[0].verifier_id, r.created_at_ms) == ("gm", "f", "adk-completion", 1704067201000.0)
    otel = [{"traceId": "t", "spanId": "1", "name": "tool.x", "attributes": {"state_changing": "false", "gen_ai.request.model": "om"}}, {"traceId": "t", "spanId": "2", "name": "check policy", "kind": "CLIENT"}, {"trace_id": "t", "name": "call", "kind": "CLIENT", "attributes": {"rpc.method": "rm"}}]
    r = importers.load(spark, "otel", put(tmp_path, "e", otel)).first()
    assert r.model_id == "om" and [(x.tool_name, x.state_changing) for x in r.actions] == [("tool.x", False), ("rm", True)] and r.verifier_results[0].claim_ids == ["2"]
    assert trust.trust(importers.load(spark, "otel", put(tmp_path, "e", otel))).first().known >= 2


def test_checks_and_lint(spark, tmp_path):
    rows = spark.createDataFrame([([("user", "q"), ("assistant", " ")], "a", "a ", 1.5), ([], "x", "y", 0.5)], f"messages array<{schemas.MESSAGE}>, chosen string, rejected string, reward double")
    assert [r.errors for r in quality.validate_rows(rows).collect()] == [["last assistant message has empty content", "chosen and rejected are identical", "reward outside [0, 1]"], ["messages is empty"]]
    pairs = spark.createDataFrame([("a" * 40, "a" * 40), ("short", "r" * 99)], "chosen string, rejected string")
    assert sorted(r.check for r in quality.check_dpo(pairs).collect()) == ["dpo_extreme_length_ratio", "dpo_identical_pairs", "dpo_min_records", "dpo_short_chosen"]
    scores = spark.createDataFrame([("1.0",), ("NaN",), ("-0.1",), ("x",), (None,), ("0.5",)], "s string").select(quality.anomalous_score(F.col("s")).alias("a")).collect()
    assert [r.a for r in scores] == [False, True, True, True, False, False]
    task = tmp_path / "task"
    (task / ".git").mkdir(parents=True)
    for n, t in (("answer.txt", "42"), ("test_a.py", ""), (".env", ""), ("run.sh", "ANSWER=1"), ("grade.py", "")):
        (task / n).write_text(t)
    found = lint.findings(lint.listing(spark, str(task)))
    assert sorted(r.check_id for r in found.collect()) == ["env-answer-in-script", "env-file-present", "git-dir-present", "gold-answer-readable", "grader-writable", "no-task-manifest", "test-script-writable"]
    assert quality.benchmark_trust(found).first().score == 0.0


def test_contamination_by_characters(spark):
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog today")], "item_id int, text string")
    train = spark.createDataFrame([(10, "the quick brown fox jumps over the lazy dog todaz"), (11, "nothing alike at all in here, really"), (12, "x" * 3000), (13, "")], "id int, text string")
    got = contamination.check(train, items, "id", "item_id").collect()
    assert [r.train for r in got] == [10] and got[0].char_jaccard > 0.8


def test_lineage_registry_replay_and_routing(spark):
    chain = spark.createDataFrame([(i, i - 1) for i in range(1, 20)] + [(100, None)], "id long, p long")
    assert {(r.id, r.root, r.depth) for r in lineage.roots(chain, "id", "p").collect()} == {(i, 1, i - 1) for i in range(1, 20)} | {(100, 100, 0)}
    log = spark.createDataFrame([("a", "register", 1, "v1"), ("a", "rollback", 3, "v0"), ("b", "register", 2, "v1"), ("b", "remove", 4, None)], "id string, event string, seq int, version string")
    assert [(r.id, r.version) for r in lineage.current(log).collect()] == [("a", "v0")]
    assert lineage.mismatch(log, spark.createDataFrame([("a",), ("c",)], "id string")).select("id").distinct().count() == 2
    act = "struct<action_id:string,state_changing:boolean,result_digest:string,pre_state_digest:string,post_state_digest:string>"
    runs = spark.createDataFrame([("r", [("1", True, "d", None, "s1"), ("2", True, None, "sX", "s2")]), ("e", [])], f"run_id string, actions array<{act}>")
    got = {r.run_id: r for r in replay.replay(runs).collect()}
    assert ([m.kind for m in got["r"].mismatches], got["r"].n_matched, got["r"].determinism_score) == (["causal"], 1, 0.5) and got["e"].determinism_score == 1.0
    assert replay.regression(runs, runs).count() == 0
    ring = routing.ring()
    import bisect
    import hashlib

    keys = [f"user-{i}" for i in range(300)] + ["_unknown"]
    want = [ring[bisect.bisect_left([h for h, _ in ring], hashlib.md5(k.encode()).hexdigest()) % len(ring)][1] for k in keys]
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, k string")
    assert [r.s for r in df.select("i", routing.shard_of(F.col("k")).alias("s")).orderBy("i").collect()] == want


def test_telemetry_datasets_and_harness(spark, tmp_path):
    lines = ['{"loss": 2.0, "step": 1}', "noise", "loss=1.0", "'loss' = 0.5", "loss: 0.05"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "seq int, value string")
    r = telemetry.history(df).select("*", telemetry.health().alias("h")).first()
    assert r.losses == [2.0, 1.0, 0.5, 0.05] and r.steps == 4 and 0.7 < r.h <= 1
    rows = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "seq long, text string")
    assert datasets.digest(rows, "seq", 7) == datasets.digest(rows.repartition(5), "seq", 7) != datasets.digest(rows.withColumn("text", F.upper("text")), "seq", 7)
    made = datasets.version(rows, "seq", "sft", str(tmp_path))
    assert made["n_records"] == 50 and made["path"].endswith(made["version"])
    tasks = spark.createDataFrame([("a", "ok", 0), ("b", "fix", 0), ("c", "big", 0), ("d", "never", 0), ("e", "ok", 50)], "task_id string, task string, n_hard int")
    out = harness.cascade(tasks, lambda t: "s", lambda t, x, h: "r", lambda t: "l", lambda t, x: ((t, x) in {("ok", "s"), ("fix", "r"), ("big", "l"), ("ok", "l")}, []))
    assert {r.task_id: r.tier_used for r in out.collect()} == {"a": "small", "b": "repair", "c": "large", "d": "failed", "e": "large"}

    def broken(i, t):
        raise RuntimeError("no model")

    ran = harness.run_groups(tasks, {"A": lambda i, t: {"final_pass": t == "ok", "tool_calls_total": 2, "tool_calls_valid": 1}, "B": broken})
    assert ran.where("error is not null").count() == 5
    m = metrics.group_metrics(ran.where("error is null")).first()
    assert m.taskspec_pass_rate == 0.4 and m.tool_call_validity == 0.5


def test_transitions_without_formatters_and_null_ids(spark):
    import io
    from contextlib import redirect_stdout

    from loomtrace.operators import training
    from loomtrace.plans import adapters

    rolled = adapters.rollouts(spark, "/root/testdata/sf0.001").where("rollout_id = '1'")
    rows = training.transitions(rolled)
    plan = io.StringIO()
    with redirect_stdout(plan):
        rows.explain()
    assert "format_string" not in plan.getvalue()
    assert all(r.state_ref == f"trace://1/{r.branch_index}/step/{r.step_index}/pre" for r in rows.collect())
    null = training.transitions(rolled.withColumn("rollout_id", F.lit(None).cast("string")))
    assert all(r.state_ref.startswith(f"trace://null/{r.branch_index}/") for r in null.collect())


def test_mode_summary_is_one_aggregation(spark):
    import io
    from contextlib import redirect_stdout

    from loomtrace.operators import training

    rows = spark.createDataFrame([("t", "m", mode, seq, ok) for seq, (mode, ok) in enumerate([("direct", True), ("direct", False), ("prompt_retry", False), ("full_pcl", True), ("other", True)])] + [("u", "m", "direct", 9, True)], "task_id string, model string, mode string, seq long, final_pass boolean")
    found = training.cross_mode_summary(rows, "seq")
    plan = io.StringIO()
    with redirect_stdout(plan):
        found.explain()
    assert "pivot" not in plan.getvalue()
    assert found.first().asDict() == {"tasks_with_all_3_modes": 1, "pcl_beats_direct": 1, "pcl_beats_retry": 1, "retry_beats_pcl": 0, "direct_beats_retry": 0, "all_pass_no_signal": 0, "all_fail_no_signal": 0, "only_pcl_passes": 1}
