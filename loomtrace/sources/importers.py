"""Third-party traces to evidence records and rollouts.

Each format is a declared schema and a projection; span and event formats group lines into runs first.
Evidence parts keep the shapes of ``schemas`` so that every operator on evidence works on imports.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace import schemas
from loomtrace.functions.times import iso_millis
from loomtrace.operators.lineage import roots
from loomtrace.sources import jsonl

CALL = "struct<name:string,arguments:string>"
BFCL = f"task_id string, category string, question string, difficulty string, model_id string, calls array<{CALL}>, pass_rate double, raw_response string"
MCP_STEP = "struct<step_index:int,server_id:string,tool_name:string,arguments:string,result:string,error:string,latency_ms:double>"
MCP_ATLAS = f"task_id string, user_query string, model_id string, trajectory array<{MCP_STEP}>, claims array<struct<claim_id:string,passed:boolean>>, claims_passed int, claims_total int, final_answer string, session_id string"
TAU = "task_id string, user_query string, rules array<string>, model_id string, turns array<struct<role:string,content:string,tool_name:string,tool_args:string,tool_result:string>>, task_completed boolean, rule_violations int, session_id string"
TERMINAL = "task_id string, description string, model_id string, trajectory array<struct<command:string,output:string,exit_code:int,timestamp_ms:double>>, passed boolean, session_id string"
SANDBOX = "task_id string, user_request string, model_id string, tool_calls array<struct<tool_name:string,arguments:string,result:string,error:string,latency_ms:double>>, final_response string, success boolean, session_id string"
HARM = "task_id string, harmful_instruction string, harm_category string, severity string, benchmark string, model_id string, actions array<struct<action_id:string,tool_name:string,arguments:string,is_harmful:boolean,was_prevented:boolean,harm_category:string>>, refused boolean, harmful_actions_taken int, session_id string"
OPENAI = "trace_id string, span_id string, type string, name string, started_at string, parent_span_id string, attributes struct<tool_name:string,state_changing:boolean,triggered:boolean,model:string>, error string, session_id string, agent_name string"
LANGSMITH = "id string, name string, run_type string, start_time string, outputs string, error string, parent_run_id string, extra struct<invocation_params:struct<model:string>>, session_id string"
ADK = "trace_id string, event_id string, type string, timestamp string, content struct<function_name:string,model:string>, error string, session_id string, model_id string"
MS = "run_id string, workflow_name string, model_id string, steps array<struct<id:string,name:string,type:string,status:string,started_at:string,error:string>>, status string, session_id string, agent_name string"
A2A = "task_id string, session_id string, messages array<struct<message_id:string,role:string,content:string,timestamp:string>>, artifacts array<struct<artifact_id:string,uri:string>>, status string, model_id string"
OTEL_ATTR = "struct<model:string,`llm.model`:string,`gen_ai.request.model`:string,triggered:boolean,error:string,tool_name:string,`rpc.method`:string,state_changing:string>"
OTEL = f"trace_id string, traceId string, span_id string, spanId string, name string, operationName string, kind string, spanKind string, error string, attributes {OTEL_ATTR}, tags {OTEL_ATTR}"


def action(id_: Column, tool: Column, changing: Column, time: Column, refs: Column | None = None) -> Column:
    null = F.lit(None).cast("string")
    refs = F.expr("cast(array() as array<string>)") if refs is None else F.array(refs)
    return F.struct(
        id_.alias("action_id"), tool.alias("tool_name"), F.coalesce(changing, F.lit(False)).alias("state_changing"), null.alias("result_digest"), null.alias("precondition_digest"),
        refs.alias("evidence_refs"), F.coalesce(time, F.lit(0.0)).cast("double").alias("timestamp_ms"), null.alias("args"), null.alias("pre_state_digest"), null.alias("post_state_digest"),
    )


def decision(tool: Column, subject: Column, code: Column, kind: str = "tool") -> Column:
    return F.struct(F.concat(F.lit(f"{kind}:"), tool).alias("capability"), subject.alias("subject"), tool.alias("resource"), F.lit("deny").alias("decision"), code.alias("reason_code"))


def verifier(id_: Column, passed: Column, claims: Column, score: Column | None = None) -> Column:
    passed = F.coalesce(passed, F.lit(False))
    return F.struct(id_.alias("verifier_id"), passed.alias("passed"), (F.when(passed, 1.0).otherwise(0.0) if score is None else score).cast("double").alias("score"), claims.alias("claim_ids"))


def _none(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)".replace("\n", ""))


def evidence(df: DataFrame, provider: str, run_id: Column, actions: Column, model: Column, verifiers: Column | None = None, decisions: Column | None = None, created: Column | None = None, input_uri: Column | None = None, outputs: Column | None = None, trace: Column | None = None) -> DataFrame:
    """An evidence row of schema ``AEP`` from the parts a format has."""
    ref = "struct<uri:string,redaction_profile:string>"
    given = {
        "schema_version": F.lit("aep/v0.1"), "run_id": run_id, "trace_id": trace, "model_id": model, "model_provider": F.lit(provider),
        "input_refs": F.array(F.struct(input_uri.alias("uri"))) if input_uri is not None else None,
        "output_refs": outputs if outputs is not None else _none(ref), "actions": F.coalesce(actions, _none(schemas.ACTION)),
        "capability_decisions": F.coalesce(decisions, _none(schemas.DECISION)) if decisions is not None else _none(schemas.DECISION),
        "verifier_results": F.coalesce(verifiers, _none(schemas.VERIFIER)) if verifiers is not None else _none(schemas.VERIFIER),
        "created_at_ms": created if created is not None else F.lit(0.0),
    }
    empty = df.sparkSession.createDataFrame([], schemas.AEP)
    cols = [(given[f.name] if given.get(f.name) is not None else F.lit(None)).cast(f.dataType).alias(f.name) for f in empty.schema.fields]
    return df.select(*cols)


def _uri(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p, F.lit("")) for p in parts])


def _out(*parts: Column | str) -> Column:
    return F.array(F.struct(_uri(*parts).alias("uri"), F.lit(None).cast("string").alias("redaction_profile")))


def tool_call(name: Column, arguments: Column, result: Column, error: Column | None = None) -> Column:
    return F.struct(name.alias("tool_name"), F.coalesce(arguments, F.lit("{}")).alias("arguments"), result.alias("result"), (error if error is not None else F.lit(None)).cast("string").alias("error"))


def rollout(df: DataFrame, source: str | Column, task: Column, tools: Column, final: Column, passed: Column, session: Column, total: Column | None = None, status: Column | None = None) -> DataFrame:
    """A one-branch rollout row of schema ``ROLLOUT``."""
    passed = F.coalesce(passed, F.lit(False))
    given = {
        "rollout_id": _uri(source, "/", F.col("task_id")), "task": task, "branch_index": F.lit(0), "temperature": F.lit(0.0), "session_id": session,
        "tools": F.coalesce(tools, _none(schemas.CALL)), "final_answer": final, "objective_score": passed.cast("int"),
        "objective_status": status if status is not None else F.when(passed, "pass").otherwise("fail"), "rank": F.lit(0),
        "total_score": total if total is not None else F.when(passed, 1.0).otherwise(0.0),
    }
    empty = df.sparkSession.createDataFrame([], schemas.ROLLOUT.replace("\n", " "))
    return df.select(*[(given[f.name] if f.name in given else F.lit(None)).cast(f.dataType).alias(f.name) for f in empty.schema.fields])


def _three(rate: Column) -> Column:
    return F.when(rate == 1.0, "pass").when(rate == 0.0, "fail").otherwise("unknown")


def bfcl_rollouts(rows: DataFrame) -> DataFrame:
    rate = F.coalesce("pass_rate", F.lit(0.0))
    tools = F.transform("calls", lambda c: tool_call(c["name"], c["arguments"], F.concat(F.lit("[bfcl-grader: "), c["name"], F.lit("]"))))
    return rollout(rows, "bfcl", F.col("question"), tools, F.col("raw_response"), F.floor(rate) >= 1, _uri("bfcl-", F.col("task_id"), "-", F.coalesce("model_id", F.lit("unknown"))), rate, F.when(F.col("pass_rate").isNull(), "unknown").otherwise(_three(F.col("pass_rate"))))


def mcp_atlas_evidence(rows: DataFrame) -> DataFrame:
    acts = F.transform("trajectory", lambda s: action(_uri("step-", s["step_index"].cast("string")), s["tool_name"], s["result"].isNotNull() & s["error"].isNull(), s["latency_ms"]))
    claims = F.transform("claims", lambda c: verifier(_uri("mcp-atlas-claim/", c["claim_id"]), c["passed"], F.array(c["claim_id"])))
    whole = F.array(verifier(F.lit("mcp-atlas-claims"), F.col("claims_passed") == F.col("claims_total"), _none("string"), F.col("claims_passed") / F.col("claims_total")))
    checks = F.when(F.size("claims") > 0, claims).when(F.col("claims_total") > 0, whole).otherwise(_none(schemas.VERIFIER))
    return evidence(rows, "benchmark", _uri("mcp-atlas/", F.col("task_id"), "/", F.col("model_id")), acts, F.col("model_id"), checks, input_uri=_uri("mcp-atlas/task/", F.col("task_id")), outputs=_out("mcp-atlas/result/", F.col("session_id")))


def mcp_atlas_rollouts(rows: DataFrame) -> DataFrame:
    rate = F.when(F.col("claims_total") > 0, F.col("claims_passed") / F.col("claims_total")).otherwise(0.0)
    tools = F.transform("trajectory", lambda s: tool_call(_uri(s["server_id"], "/", s["tool_name"]), s["arguments"], F.coalesce(s["result"], s["error"], F.lit(""))))
    return rollout(rows, "mcp-atlas", F.col("user_query"), tools, F.col("final_answer"), rate == 1.0, F.coalesce("session_id", _uri("mcp-atlas-", F.col("task_id"))), rate, _three(rate))


def tau_evidence(rows: DataFrame) -> DataFrame:
    turns = F.transform("turns", lambda t, i: F.struct(t.alias("t"), i.alias("i")))
    acts = F.transform(F.filter(turns, lambda x: x["t"]["role"] == "agent"), lambda x: action(_uri("turn-", x["i"].cast("string")), F.coalesce(x["t"]["tool_name"], F.lit("chat")), x["t"]["tool_name"].isNotNull(), x["i"] * 1000.0))
    names = F.transform("rules", lambda _, j: _uri("rule-", j.cast("string")))
    broken = F.coalesce("rule_violations", F.lit(0))
    checks = F.array(verifier(F.lit("tau-rule-compliance"), broken == 0, names, F.greatest(F.lit(0.0), 1.0 - broken * 0.2)), verifier(F.lit("tau-task-completion"), F.col("task_completed"), F.array("task_id")))
    return evidence(rows, "benchmark", _uri("tau-bench/", F.col("task_id"), "/", F.col("model_id")), acts, F.col("model_id"), checks, input_uri=_uri("tau-bench/task/", F.col("task_id")), outputs=_out("tau-bench/result/", F.col("session_id")))


def tau_rollouts(rows: DataFrame) -> DataFrame:
    turns = F.transform("turns", lambda t, i: F.struct(t.alias("t"), i.alias("i")))
    calls = F.filter(turns, lambda x: (x["t"]["role"] == "agent") & x["t"]["tool_name"].isNotNull())

    def result(x: Column) -> Column:
        after = F.filter(turns, lambda y: (y["t"]["role"] == "tool") & (y["i"] > x["i"]))
        return F.coalesce(F.try_element_at(after, F.lit(1))["t"]["tool_result"], F.lit(""))

    tools = F.transform(calls, lambda x: tool_call(x["t"]["tool_name"], x["t"]["tool_args"], result(x)))
    passed = F.col("task_completed") & (F.coalesce("rule_violations", F.lit(0)) == 0)
    return rollout(rows, "tau-bench", F.col("user_query"), tools, F.lit(""), passed, F.coalesce("session_id", _uri("tau-", F.col("task_id"))))


def terminal_evidence(rows: DataFrame) -> DataFrame:
    acts = F.transform("trajectory", lambda c, i: action(_uri("cmd-", i.cast("string")), F.lit("bash"), (c["exit_code"] == 0) & (F.coalesce(c["output"], F.lit("")) != ""), c["timestamp_ms"], _uri("tb-cmd/", i.cast("string"))))
    return evidence(rows, "benchmark", _uri("terminal-bench/", F.col("task_id"), "/", F.col("model_id")), acts, F.col("model_id"), F.array(verifier(F.lit("terminal-bench-tests"), F.col("passed"), F.array("task_id"))), input_uri=_uri("terminal-bench/task/", F.col("task_id")), outputs=_out("terminal-bench/result/", F.col("session_id")))


def terminal_rollouts(rows: DataFrame) -> DataFrame:
    tools = F.transform("trajectory", lambda c: tool_call(F.lit("bash"), F.to_json(F.struct(c["command"].alias("command"))), c["output"]))
    return rollout(rows, "terminal-bench", F.col("description"), tools, F.lit(""), F.col("passed"), F.coalesce("session_id", _uri("tb-", F.col("task_id"))))


def sandbox_evidence(rows: DataFrame) -> DataFrame:
    acts = F.transform("tool_calls", lambda c, i: action(_uri("call-", i.cast("string")), c["tool_name"], c["error"].isNull(), c["latency_ms"]))
    failed = F.filter("tool_calls", lambda c: F.coalesce(c["error"], F.lit("")) != "")
    denies = F.transform(failed, lambda c: decision(c["tool_name"], F.lit("agent"), F.lit("tool_error")))
    return evidence(rows, "benchmark", _uri("tool-sandbox/", F.col("task_id"), "/", F.col("model_id")), acts, F.col("model_id"), F.array(verifier(F.lit("tool-sandbox-success"), F.col("success"), F.array("task_id"))), denies, input_uri=_uri("tool-sandbox/task/", F.col("task_id")), outputs=_out("tool-sandbox/result/", F.col("session_id")))


def sandbox_rollouts(rows: DataFrame) -> DataFrame:
    tools = F.transform("tool_calls", lambda c: tool_call(c["tool_name"], c["arguments"], c["result"], c["error"]))
    return rollout(rows, "tool-sandbox", F.col("user_request"), tools, F.col("final_response"), F.col("success"), F.coalesce("session_id", _uri("ts-", F.col("task_id"))))


def _bench() -> Column:
    return F.coalesce("benchmark", F.lit("agent-harm"))


def _safe() -> Column:
    return F.coalesce("refused", F.lit(False)) | (F.coalesce("harmful_actions_taken", F.lit(0)) == 0)


def harm_evidence(rows: DataFrame) -> DataFrame:
    acts = F.transform("actions", lambda a: action(a["action_id"], a["tool_name"], ~F.coalesce(a["was_prevented"], F.lit(False)), F.lit(0.0)))
    denies = F.transform(F.filter("actions", lambda a: a["was_prevented"]), lambda a: decision(a["tool_name"], F.lit("agent"), _uri("harm_prevention:", a["harm_category"])))
    checks = F.array(verifier(_uri(_bench(), "-safety"), _safe(), F.array(_uri("harm-prevention:", F.col("harm_category")))))
    return evidence(rows, "benchmark", _uri(_bench(), "/", F.col("task_id"), "/", F.col("model_id")), acts, F.col("model_id"), checks, denies, input_uri=_uri(_bench(), "/task/", F.col("task_id")), outputs=_out(_bench(), "/result/", F.col("session_id")))


def harm_rollouts(rows: DataFrame) -> DataFrame:
    tools = F.transform("actions", lambda a: tool_call(a["tool_name"], a["arguments"], F.when(a["was_prevented"], "prevented").otherwise("executed")))
    return rollout(rows, _bench(), F.col("harmful_instruction"), tools, F.when(F.col("refused"), "refused").otherwise(""), _safe(), F.coalesce("session_id", _uri("harm-", F.col("task_id"))))


def _runs(rows: DataFrame, key: Column) -> DataFrame:
    """Lines gathered into runs, in line order; a run's spans are bounded by one agent run."""
    cols = [c for c in rows.columns if c != "file"]
    return rows.groupBy(key.alias("run")).agg(F.sort_array(F.collect_list(F.struct("seq", *[c for c in cols if c != "seq"]))).alias("spans"))


def _first(spans: Column | str, pick, value) -> Column:
    return F.try_element_at(F.transform(F.filter(spans, pick), value), F.lit(1))


def openai_evidence(rows: DataFrame) -> DataFrame:
    runs = _runs(rows, F.coalesce("trace_id", F.lit("unknown")))
    agent = F.coalesce(F.when(F.element_at("spans", 1)["agent_name"] != "", F.element_at("spans", 1)["agent_name"]), F.lit("agent"))
    tool = lambda s: F.coalesce(s["attributes"]["tool_name"], s["name"])
    calls = F.filter("spans", lambda s: s["type"] == "tool.call")
    acts = F.transform(calls, lambda s: action(s["span_id"], tool(s), s["attributes"]["state_changing"], iso_millis(s["started_at"]), _uri("oai-span/", s["span_id"])))
    denies = F.transform(F.filter(calls, lambda s: F.coalesce(s["error"], F.lit("")) != ""), lambda s: decision(tool(s), agent, F.lit("tool_error")))
    checks = F.transform(F.filter("spans", lambda s: s["type"] == "guardrail"), lambda s: verifier(_uri("guardrail/", s["name"]), s["error"].isNull() & ~F.coalesce(s["attributes"]["triggered"], F.lit(False)), F.array(s["span_id"])))
    created = F.coalesce(_first("spans", lambda s: (s["type"] == "agent.run") & s["parent_span_id"].isNull(), lambda s: iso_millis(s["started_at"])), F.lit(0.0))
    model = F.coalesce(_first("spans", lambda s: s["type"] == "llm.generate", lambda s: s["attributes"]["model"]), F.lit("unknown"))
    return evidence(runs, "openai", _uri("oai-agents/", F.col("run")), acts, model, checks, denies, created, outputs=_out("oai-agents/session/", F.element_at("spans", 1)["session_id"]), trace=F.col("run"))


def langsmith_evidence(rows: DataFrame) -> DataFrame:
    top = roots(rows, "id", "parent_run_id").select(F.col("id").alias("_id"), "root")
    runs = _runs(rows.join(top, F.col("id") == F.col("_id")).drop("_id"), F.col("root"))
    tools = F.filter("spans", lambda r: r["run_type"] == "tool")
    full = lambda c: ~F.coalesce(c, F.lit("")).isin("", "{}", "[]", "null")
    acts = F.transform(tools, lambda r: action(r["id"], r["name"], r["error"].isNull() & full(r["outputs"]), iso_millis(r["start_time"]), _uri("langsmith/", r["id"])))
    failed = F.filter("spans", lambda r: r["run_type"].isin("tool", "chain") & (F.coalesce(r["error"], F.lit("")) != ""))
    denies = F.transform(failed, lambda r: F.struct(F.concat_ws(":", r["run_type"], r["name"]).alias("capability"), F.lit("agent").alias("subject"), r["name"].alias("resource"), F.lit("deny").alias("decision"), F.concat(r["run_type"], F.lit("_error")).alias("reason_code")))
    models = F.transform(F.filter("spans", lambda r: r["run_type"] == "llm"), lambda r: F.coalesce(F.when(r["extra"]["invocation_params"]["model"] != "", r["extra"]["invocation_params"]["model"]), r["name"]))
    created = F.coalesce(_first("spans", lambda r: (r["run_type"] == "chain") & r["parent_run_id"].isNull(), lambda r: iso_millis(r["start_time"])), F.lit(0.0))
    return evidence(runs, "langsmith", _uri("langsmith/", F.col("run")), acts, F.coalesce(F.try_element_at(models, F.lit(-1)), F.lit("")), None, denies, created, outputs=_out("langsmith/session/", F.element_at("spans", 1)["session_id"]), trace=F.col("run"))


def adk_evidence(rows: DataFrame) -> DataFrame:
    runs = _runs(rows, F.coalesce("trace_id", F.lit("unknown")))
    acts = F.transform(F.filter("spans", lambda e: e["type"] == "function_call"), lambda e: action(e["event_id"], F.coalesce(e["content"]["function_name"], e["event_id"]), e["error"].isNull(), iso_millis(e["timestamp"]), _uri("adk-event/", e["event_id"])))
    checks = F.transform(F.filter("spans", lambda e: e["type"] == "final_response"), lambda e: verifier(F.lit("adk-completion"), e["error"].isNull(), F.array(F.col("run"))))
    model = F.coalesce(_first("spans", lambda e: e["type"] == "model_response", lambda e: e["content"]["model"]), F.element_at("spans", 1)["model_id"], F.lit("unknown"))
    return evidence(runs, "google", _uri("google-adk/", F.col("run")), acts, model, checks, None, iso_millis(F.element_at("spans", 1)["timestamp"]), outputs=_out("google-adk/session/", F.element_at("spans", 1)["session_id"]), trace=F.col("run"))


def ms_evidence(rows: DataFrame) -> DataFrame:
    tools = F.filter("steps", lambda s: s["type"] == "tool")
    acts = F.transform(tools, lambda s: action(s["id"], s["name"], (s["status"] == "completed") & s["error"].isNull(), iso_millis(s["started_at"]), _uri("ms-step/", s["id"])))
    agent = F.coalesce(F.when(F.col("agent_name") != "", F.col("agent_name")), F.lit("agent"))
    denies = F.transform(F.filter(tools, lambda s: (F.coalesce(s["error"], F.lit("")) != "") | (s["status"] == "failed")), lambda s: decision(s["name"], agent, F.lit("step_failed")))
    people = F.transform(F.filter("steps", lambda s: s["type"] == "human"), lambda s: verifier(_uri("human-approval/", s["id"]), s["status"] == "completed", F.array(s["id"])))
    status = F.coalesce("status", F.lit("completed"))
    end = F.when(status.isin("completed", "failed"), F.array(verifier(F.lit("ms-workflow-completion"), status == "completed", F.array("run_id")))).otherwise(_none(schemas.VERIFIER))
    created = F.coalesce(iso_millis(F.try_element_at("steps", F.lit(1))["started_at"]), F.lit(0.0))
    return evidence(rows, "microsoft", _uri("ms-agent/", F.col("run_id")), acts, F.col("model_id"), F.concat(people, end), denies, created, outputs=_out("ms-agent/run/", F.col("session_id")), trace=F.col("run_id"))


def a2a_evidence(rows: DataFrame) -> DataFrame:
    acts = F.transform(F.filter("messages", lambda m: m["role"] == "agent"), lambda m: action(m["message_id"], F.lit("a2a_message"), F.lit(False), iso_millis(m["timestamp"]), _uri("a2a-msg/", m["message_id"])))
    outs = F.transform("artifacts", lambda a: F.struct(F.when(F.coalesce(a["uri"], F.lit("")) != "", a["uri"]).otherwise(_uri("a2a-artifact/", a["artifact_id"])).alias("uri"), F.lit(None).cast("string").alias("redaction_profile")))
    outputs = F.when(F.size("artifacts") > 0, outs).otherwise(_out("a2a/session/", F.col("session_id")))
    created = F.coalesce(iso_millis(F.try_element_at("messages", F.lit(1))["timestamp"]), F.lit(0.0))
    return evidence(rows, "a2a", _uri("a2a/", F.col("task_id")), acts, F.coalesce("model_id", F.lit("unknown")), F.array(verifier(F.lit("a2a-task-completion"), F.coalesce("status", F.lit("completed")) == "completed", F.array("task_id"))), None, created, outputs=outputs, trace=F.col("session_id"))


def otel_evidence(rows: DataFrame) -> DataFrame:
    filled = lambda *cs: F.coalesce(*[F.when(c != "", c) for c in cs])
    flat = rows.select(
        "seq",
        F.coalesce(filled(F.col("trace_id"), F.col("traceId")), F.lit("unknown")).alias("trace"),
        F.coalesce(filled(F.col("span_id"), F.col("spanId")), F.lit("")).alias("span_id"),
        F.coalesce(filled(F.col("name"), F.col("operationName")), F.lit("")).alias("name"),
        F.lower(F.coalesce(filled(F.col("kind"), F.col("spanKind")), F.lit(""))).alias("kind"),
        F.col("error"),
        F.coalesce("attributes", "tags").alias("attrs"),
    )
    low = F.lower("name")
    kind = F.when((low == "guardrail") | F.contains(low, F.lit("policy")), "verifier").when(low.startswith("tool") | (F.col("kind") == "client"), "tool")
    flat = flat.withColumn("what", kind).withColumn("model", filled(F.col("attrs.model"), F.col("attrs.`llm.model`"), F.col("attrs.`gen_ai.request.model`")))
    runs = _runs(flat, F.col("trace"))
    tools = F.filter("spans", lambda s: s["what"] == "tool")

    def changing(s: Column) -> Column:
        said = F.lower(s["attrs"]["state_changing"])
        return F.when(said.isNotNull(), ~said.isin("false", "0", "no")).otherwise(F.coalesce(filled(s["error"], s["attrs"]["error"]), F.lit("")) == "")

    acts = F.transform(tools, lambda s, i: action(F.when(s["span_id"] != "", s["span_id"]).otherwise(_uri("span-", i.cast("string"))), filled(s["attrs"]["tool_name"], s["attrs"]["rpc.method"], s["name"]), changing(s), F.lit(0.0)))
    checks = F.transform(F.filter("spans", lambda s: s["what"] == "verifier"), lambda s: verifier(_uri("guardrail/", s["name"]), ~F.coalesce(s["attrs"]["triggered"], F.lit(False)), F.when(s["span_id"] != "", F.array(s["span_id"])).otherwise(_none("string"))))
    model = F.coalesce(_first("spans", lambda s: s["model"].isNotNull(), lambda s: s["model"]), F.lit(""))
    return evidence(runs, "otel", _uri("otel/", F.col("run")), acts, model, checks, input_uri=_uri("otel/trace/", F.col("run")))


#: format -> (schema, to evidence, to rollouts)
FORMATS = {
    "bfcl": (BFCL, None, bfcl_rollouts),
    "mcp-atlas": (MCP_ATLAS, mcp_atlas_evidence, mcp_atlas_rollouts),
    "tau-bench": (TAU, tau_evidence, tau_rollouts),
    "terminal-bench": (TERMINAL, terminal_evidence, terminal_rollouts),
    "tool-sandbox": (SANDBOX, sandbox_evidence, sandbox_rollouts),
    "agent-harm": (HARM, harm_evidence, harm_rollouts),
    "oai-agents": (OPENAI, openai_evidence, None),
    "langsmith": (LANGSMITH, langsmith_evidence, None),
    "adk": (ADK, adk_evidence, None),
    "ms-agent-framework": (MS, ms_evidence, None),
    "a2a-task": (A2A, a2a_evidence, None),
    "otel": (OTEL, otel_evidence, None),
}


def load(spark: SparkSession, kind: str, paths: str | list[str], to: str = "evidence") -> DataFrame:
    """A third-party file as ``evidence`` or ``rollout`` rows."""
    schema, to_evidence, to_rollouts = FORMATS[kind]
    convert = to_evidence if to == "evidence" else to_rollouts
    if convert is None:
        raise ValueError(f"{kind} has no {to} form")
    return convert(jsonl.read(spark, paths, schema))
