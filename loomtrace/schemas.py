"""Record shapes, declared once; nothing is inferred from data."""

from __future__ import annotations

CALL = "struct<tool_name:string,arguments:string,result:string,error:string>"

#: One branch of a rollout. ``tools`` are normalised tool calls; arguments are JSON text.
ROLLOUT = f"""rollout_id string, task string, branch_index int, temperature double, session_id string,
tools array<{CALL}>, final_answer string, objective_score int, objective_status string, rank int, total_score double,
verifier_results array<struct<evidence_source:string,signer:struct<key_id:string>>>"""

VIOLATION = "struct<constraint_id:string,level:string,category:string,hint:string>"
REPAIR = "struct<round:int,violation_ids:array<string>,strategy:string,ok:boolean>"
COMPLIANCE = f"""task_id string, task_spec_hash string, model string, mode string, violations array<{VIOLATION}>,
repair_trace array<{REPAIR}>, repair_rounds int, final_pass boolean, latency_ms double, artifact string"""

EVAL = """task_id string, `group` string, final_pass boolean, tool_calls_total long, tool_calls_valid long, repair_rounds long,
repair_rounds_ok long, has_evidence boolean, escalated boolean, prompt_tokens long, generation_tokens long, repair_tokens long,
latency_ms double, general_score double"""

ACTION = """struct<action_id:string,tool_name:string,state_changing:boolean,result_digest:string,precondition_digest:string,
evidence_refs:array<string>,timestamp_ms:double,args:string,pre_state_digest:string,post_state_digest:string>"""
DECISION = "struct<capability:string,subject:string,resource:string,decision:string,reason_code:string>"
VERIFIER = "struct<verifier_id:string,passed:boolean,score:double,claim_ids:array<string>>"
LIMITED = "struct<limit:double,spent:double>"
#: One run's evidence.
AEP = f"""schema_version string, run_id string, trace_id string, model_id string, model_provider string, repo_commit string,
tool_manifest_digest string, recording_mode string, subject_id string, user_id string, organization_id string, tenant_id string,
run_context struct<org:string,organization_id:string,tenant_id:string,subject_id:string,user_id:string,run_id:string,trace_id:string>,
input_refs array<struct<uri:string>>, output_refs array<struct<uri:string,redaction_profile:string>>,
actions array<{ACTION}>, capability_decisions array<{DECISION}>, verifier_results array<{VERIFIER}>,
budget_ledger struct<token_budget:{LIMITED},retry_budget:{LIMITED},tool_budget:{LIMITED}>, created_at_ms double,
objective_score string, task string, final_answer string, prompt string, user_message string""".replace("\n", " ")

MESSAGE = "struct<role:string,content:string>"
FEATURES = (
    "taskspec_n_constraints", "taskspec_n_hard", "taskspec_has_tools", "taskspec_n_allowed_tools", "taskspec_max_repair_rounds",
    "eval_repair_rounds", "eval_violation_count", "eval_hard_violation_count", "eval_tool_calls_total", "eval_tool_calls_valid",
    "eval_tool_validity_rate", "eval_escalated", "eval_latency_ms", "eval_prompt_tokens", "eval_generation_tokens",
)
LABELS = ("small_model_can_handle", "need_repair", "need_large_model", "need_human_review")
