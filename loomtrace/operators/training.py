"""Rollouts and compliance runs to training rows: supervised, preference, reward, step and context rows.

A rollout's order is its ``branch_index``; where a tie must fall to the first row, that index decides.
Best and worst branch come from ``max_by``/``min_by`` (partial aggregation), never from a sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.functions.jsontext import spaced_json
from loomtrace.functions.text import short_hash

MODES = ("direct", "prompt_retry", "full_pcl")


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), F.coalesce(content, F.lit("")).alias("content"))


def outcome(call: Column) -> Column:
    return F.coalesce(call["result"], call["error"], F.lit(""))


def messages(final: bool = True) -> Column:
    """User task, an assistant and a tool turn for each named call, and the final answer."""
    named = F.filter("tools", lambda c: F.coalesce(c["tool_name"], F.lit("")) != "")
    turns = F.flatten(F.transform(named, lambda c: F.array(message("assistant", c["tool_name"]), message("tool", outcome(c)))))
    parts = [F.array(message("user", F.col("task"))), turns]
    return F.concat(*parts, F.array(message("assistant", F.col("final_answer")))) if final else F.concat(*parts)


def pair_events(events: Column) -> Column:
    """Tool-call and tool-result events (event, call_id, name, args, output, error) joined on call_id.

    A repeated call id keeps its first place and its last value.
    """
    calls = F.filter(events, lambda e: e["event"] == "tool_call")
    results = F.filter(events, lambda e: e["event"] == "tool_result")
    ids = F.array_distinct(F.transform(calls, lambda e: F.coalesce(e["call_id"], F.lit(""))))

    def last(rows: Column, k: Column) -> Column:
        return F.try_element_at(F.filter(rows, lambda e: F.coalesce(e["call_id"], F.lit("")) == k), F.lit(-1))

    return F.transform(
        ids,
        lambda k: F.struct(
            F.coalesce(last(calls, k)["name"], F.lit("")).alias("tool_name"),
            F.coalesce(last(calls, k)["args"], F.lit("{}")).alias("arguments"),
            last(results, k)["output"].alias("result"),
            last(results, k)["error"].alias("error"),
        ),
    )


def sft(rollouts: DataFrame, only_passing: bool = True) -> DataFrame:
    rows = rollouts.where(F.col("objective_score") == 1) if only_passing else rollouts
    return rows.select("rollout_id", "branch_index", messages().alias("messages"), F.lit("final_answer").alias("output_type"), short_hash(F.col("task")).alias("task_hash"))


def ppo(rollouts: DataFrame, reward: Column | None = None) -> DataFrame:
    reward = F.col("objective_score").cast("double") if reward is None else reward
    return rollouts.select("rollout_id", "branch_index", messages().alias("messages"), reward.alias("reward"))


def attested(results: Column) -> Column:
    """No verifier results at all, or one that is attested and signed."""
    signed = F.exists(results, lambda v: (v["evidence_source"] == "attested") & (F.coalesce(v["signer"]["key_id"], F.lit("")) != ""))
    return (F.coalesce(F.size(results), F.lit(0)) <= 0) | F.coalesce(signed, F.lit(False))


def dpo(rollouts: DataFrame, require_attested: bool = True) -> DataFrame:
    """Per rollout the best against the worst known branch; none if both are the same branch."""
    known = rollouts.where(F.col("objective_status") != "unknown")
    if require_attested:
        known = known.where(attested(F.col("verifier_results")))
    row = F.struct("branch_index", "task", "tools", "final_answer")
    order = lambda tie: F.struct("objective_score", "total_score", tie.alias("tie"))
    ends = known.groupBy("rollout_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.max_by(row, order(-F.col("branch_index"))).alias("best"),
        F.min_by(row, order(F.col("branch_index"))).alias("worst"),
    )
    pairs = ends.where((F.col("n") >= 2) & (F.col("best.branch_index") != F.col("worst.branch_index")))
    shaped = pairs.select("rollout_id", "best.*", F.col("worst.final_answer").alias("rejected"), F.col("worst.branch_index").alias("rejected_branch"))
    return shaped.select(
        "rollout_id",
        F.col("branch_index").alias("chosen_branch"),
        "rejected_branch",
        messages(final=False).alias("prompt_messages"),
        F.col("final_answer").alias("chosen"),
        "rejected",
        short_hash(F.col("task")).alias("task_hash"),
        short_hash(F.col("final_answer")).alias("n_gram_hash"),
    )


def episode_reward() -> Column:
    """Score plus up to a tenth for the total, at most 1; 0 if the status is unknown."""
    bonus = F.greatest(F.lit(0.0), F.least(F.lit(0.1), F.col("total_score") / 1000))
    return F.when(F.col("objective_status") == "unknown", 0.0).otherwise(F.least(F.lit(1.0), F.col("objective_score") + bonus))


def branch_steps() -> Column:
    """The steps of a branch as an array: two a tool call (agent, environment) and a terminal agent step."""
    step = lambda role, content, tool, index, error: F.struct(F.lit(role).alias("role"), content.alias("content"), tool.alias("tool_name"), index.alias("tool_call_index"), error.alias("is_error"))
    null = F.lit(None)
    calls = F.flatten(
        F.transform(
            "tools",
            lambda c, i: F.array(
                step("agent", F.concat(F.lit('{"name": "'), c["tool_name"], F.lit('", "arguments": '), F.coalesce(c["arguments"], F.lit("{}")), F.lit("}")), c["tool_name"], i, null.cast("boolean")),
                step("environment", outcome(c), null.cast("string"), i, c["error"].isNotNull()),
            ),
        )
    )
    return F.concat(calls, F.array(step("agent", F.col("final_answer"), null.cast("string"), null.cast("int"), null.cast("boolean"))))


def episode_steps(rollouts: DataFrame) -> DataFrame:
    """2k + 1 rows a branch of k tool calls, as ``branch_steps`` has them."""
    rows = rollouts.select("rollout_id", "branch_index", F.concat_ws("/", "rollout_id", "branch_index").alias("episode_id"), (2 * F.size("tools")).alias("_last"), episode_reward().alias("_reward"), F.posexplode(branch_steps()).alias("step_index", "_s"))
    done = F.col("step_index") == F.col("_last")
    return rows.select("rollout_id", "branch_index", "episode_id", "step_index", "_s.*", F.when(done, F.col("_reward")).alias("reward"), done.alias("done"))


def transitions(rollouts: DataFrame, dims: tuple[str, ...] = ("build", "policy", "cost")) -> DataFrame:
    """One transition a tool call and a terminal one that carries the reward's parts."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    ref = lambda end: F.concat(F.lit("trace://"), named("rollout_id"), F.lit("/"), named("branch_index"), F.lit("/step/"), named("step_index"), F.lit(f"/{end}"))
    total = F.size("tools")
    build = F.when(F.col("objective_status") == "pass", 1.0).otherwise(0.0) if "build" in dims else F.lit(0.0)
    cost = F.greatest(F.lit(-0.1), -0.01 * F.greatest(F.lit(0), total - 1)) if "cost" in dims else F.lit(0.0)
    rows = rollouts.select("*", total.alias("_n"), build.alias("_b"), cost.alias("_c"), F.explode(F.sequence(F.lit(0), total)).alias("step_index"))
    call = F.try_element_at("tools", F.col("step_index") + 1)
    done = F.col("step_index") == F.col("_n")
    args = spaced_json(F.coalesce(call["arguments"], F.lit("{}")))
    payload = F.concat(F.lit('{"args": '), F.when(done, F.lit("{}")).otherwise(args), F.lit(', "tool": "'), F.when(done, F.lit("final_answer")).otherwise(call["tool_name"]), F.lit('"}'))
    return rows.select(
        "rollout_id",
        "branch_index",
        F.concat_ws("/", "rollout_id", "branch_index").alias("episode_id"),
        "step_index",
        ref("pre").alias("state_ref"),
        F.when(done, F.lit("final_answer")).otherwise(call["tool_name"]).alias("action"),
        short_hash(payload).alias("args_hash"),
        ref("post").alias("observation_ref"),
        F.when(done, F.col("_b")).alias("reward_build"),
        F.when(done, F.lit(1.0 if "policy" in dims else 0.0)).alias("reward_policy"),
        F.when(done, F.col("_c")).alias("reward_cost"),
        done.alias("done"),
    )


def _call_text(call: Column, i: Column) -> Column:
    result = F.when(call["result"].isNotNull(), F.substring(call["result"], 1, 512)).otherwise(F.concat(F.lit("[ERROR] "), F.coalesce(call["error"], F.lit("None"))))
    return F.concat(F.lit("[Step "), i.cast("string"), F.lit("] Tool: "), call["tool_name"], F.lit("\n  Arguments: "), F.coalesce(call["arguments"], F.lit("{}")), F.lit("\n  Result: "), result)


def context_qa(rollouts: DataFrame, least_calls: int = 1) -> DataFrame:
    """One long-context question for each passing branch with enough calls."""
    parts = F.concat(F.array(F.concat(F.lit("Task: "), F.col("task"))), F.transform("tools", _call_text), F.array(F.concat(F.lit("Final answer: "), F.col("final_answer"))))
    rows = rollouts.where((F.size("tools") >= least_calls) & (F.col("objective_status") == "pass")).withColumn("context", F.array_join(parts, "\n\n"))
    return rows.select("rollout_id", "branch_index", short_hash(F.concat_ws(":", "rollout_id", "context")).alias("record_id"), "context", F.col("task").alias("question"), F.col("final_answer").alias("answer"), F.size("tools").alias("n_tool_calls"))


def router_critic(rollouts: DataFrame, least_calls: int = 1) -> DataFrame:
    """One decision a call, with the context before it: stop, ask or continue."""
    texts = F.transform("tools", _call_text)
    total = F.size("tools")
    rows = rollouts.where(total >= least_calls).select("rollout_id", "branch_index", "task", "objective_status", total.alias("_n"), texts.alias("_t"), F.posexplode("tools").alias("step_index", "_call"))
    partial = F.array_join(F.concat(F.array(F.concat(F.lit("Task: "), F.col("task"))), F.slice("_t", F.lit(1), F.col("step_index"))), "\n\n")
    last = F.col("step_index") == F.col("_n") - 1
    decision = F.when(last & (F.col("objective_status") == "pass"), "stop").when(last & (F.col("objective_status") == "fail"), "ask").otherwise("continue")
    rows = rows.withColumn("partial_context", partial)
    return rows.select("rollout_id", "branch_index", "step_index", short_hash(F.concat(F.col("rollout_id"), F.lit("/"), F.col("step_index").cast("string"), F.lit(":"), F.col("partial_context"))).alias("record_id"), "partial_context", decision.alias("decision"), F.element_at("_t", F.col("step_index") + 1).alias("evidence"), (F.col("_n") - F.col("step_index") - 1).alias("n_remaining_steps"))


# ---- compliance runs ---------------------------------------------------------------------------


def task_context() -> Column:
    quoted = lambda c: F.expr(f"substring(to_json(array({c})), 2, length(to_json(array({c}))) - 2)")
    return F.concat(F.lit('{"task_id": '), quoted("task_id"), F.lit(', "mode": '), quoted("mode"), F.lit("}"))


def hints(violations: Column, category: bool = True) -> Column:
    level = lambda v: F.concat_ws("/", v["level"], v["category"]) if category else v["level"]
    return F.array_join(F.transform(violations, lambda v: F.concat(F.lit("- ["), level(v), F.lit("] "), F.coalesce(v["hint"], F.lit("")))), "\n")


def compliance_sft(records: DataFrame, include_failures: bool = False) -> DataFrame:
    """Answers of passing runs, and a repair row for each successful round with known violations."""
    user = F.when(F.col("final_pass") & (F.size("violations") > 0), F.concat(task_context(), F.lit("\n\nConstraint violations:\n"), hints(F.col("violations")))).otherwise(task_context())
    shaped = lambda kind, content, weight, part: F.struct(part.alias("part"), F.array(message("user", content), message("assistant", F.col("artifact"))).alias("messages"), F.lit(kind).alias("output_type"), weight.alias("loss_weight_tokens"))
    answers = F.array(shaped("final_answer", user, F.when(F.col("final_pass"), "default").otherwise("recovery"), F.lit(0)))
    trace = F.coalesce("repair_trace", F.expr(f"cast(array() as {records.schema['repair_trace'].dataType.simpleString()})"))
    rounds = F.filter(trace, lambda r: r["ok"] & F.exists("violations", lambda v: F.array_contains(r["violation_ids"], v["constraint_id"])))

    def repaired(r: Column, i: Column) -> Column:
        own = F.filter("violations", lambda v: F.array_contains(r["violation_ids"], v["constraint_id"]))
        content = F.concat(task_context(), F.lit("\n\nRound "), r["round"].cast("string"), F.lit(" violations:\n"), hints(own, category=False))
        return shaped("repair_patch", content, F.lit("recovery"), i + 1)

    keep = F.col("final_pass") | F.lit(include_failures)
    rows = F.concat(F.filter(answers, lambda _: keep), F.transform(rounds, repaired))
    return records.select("task_id", "model", "mode", F.explode(rows).alias("r")).select("task_id", "model", "mode", "r.*")


def compliance_dpo(records: DataFrame, bad_outputs: DataFrame | None = None) -> DataFrame:
    """Successful repair rounds against a sketch of what they fixed, and known bad outputs of a task."""
    passed = records.where("final_pass")
    rounds = passed.select("task_id", "artifact", F.explode("repair_trace").alias("r"), "violations").where(F.col("r.ok"))
    own = F.filter("violations", lambda v: F.array_contains(F.col("r.violation_ids"), v["constraint_id"]))
    listed = F.array_join(F.transform(own, lambda v: F.concat(F.lit("- "), F.coalesce(v["hint"], F.lit("")))), "\n")
    draft = F.concat(F.lit("[pre-repair draft \u2014 round "), F.col("r.round").cast("string"), F.lit("]\nViolations present:\n"), listed, F.lit("\n\nDraft artifact (incomplete):\n"), F.col("artifact"))
    out = rounds.where(F.size(own) > 0).select("task_id", F.col("artifact").alias("chosen"), draft.alias("rejected"))
    if bad_outputs is not None:
        more = passed.join(bad_outputs.select("task_id", F.explode("bad").alias("rejected")), "task_id").where(F.trim("artifact") != F.trim("rejected"))
        out = out.unionByName(more.select("task_id", F.col("artifact").alias("chosen"), "rejected"))
    return out


def last_by_mode(records: DataFrame, seq: str) -> DataFrame:
    """The last record of each (task, model, mode), with ``ord``, the mode's first position."""
    rest = [c for c in records.columns if c not in ("task_id", "model", "mode", seq)]
    return records.groupBy("task_id", "model", "mode").agg(F.min(seq).alias("ord"), F.max_by(F.struct(*rest), F.col(seq)).alias("r")).select("task_id", "model", "mode", "ord", "r.*")


def cross_mode_dpo(records: DataFrame, seq: str, include_boundary: bool = True) -> DataFrame:
    """For each task and model, pairs of modes of which one passed and the other failed."""
    rank = F.array_position(F.array(*[F.lit(m) for m in MODES]), F.col("mode")) - 1
    last = last_by_mode(records, seq).withColumn("rank", rank)
    won = last.where("final_pass").alias("w")
    lost = last.where(~F.col("final_pass")).alias("l")
    pairs = won.join(lost, ["task_id", "model"])
    if not include_boundary:
        pairs = pairs.where(F.col("w.rank") >= F.col("l.rank"))
    summary = F.when(F.size("l.violations") > 0, F.concat(F.lit("\nViolations:\n"), hints(F.col("l.violations")))).otherwise("")
    user = F.concat(F.lit("task_id="), F.col("task_id"), F.lit(" model="), F.col("model"), F.lit("\ntask_spec_hash="), F.substring("w.task_spec_hash", 1, 16), F.lit("\n"), summary)
    return pairs.select(
        "task_id",
        "model",
        F.col("w.mode").alias("chosen_mode"),
        F.col("l.mode").alias("rejected_mode"),
        user.alias("user_content"),
        F.col("w.artifact").alias("chosen"),
        F.col("l.artifact").alias("rejected"),
        F.when(F.col("w.repair_rounds") > 0, "recovery").otherwise("default").alias("loss_weight_tokens"),
        short_hash(F.col("w.artifact")).alias("n_gram_hash"),
        short_hash(F.col("task_id")).alias("task_hash"),
    )


def cross_mode_summary(records: DataFrame, seq: str) -> DataFrame:
    """Counts over tasks and models that have all three modes."""
    # one aggregation with a mode's last outcome a column, as a row a mode would be held in two tables of a task
    last = [F.max_by("final_pass", F.when(F.col("mode") == m, F.col(seq))).alias(m) for m in MODES]
    wide = records.groupBy("task_id", "model").agg(*last).where(" and ".join(f"{m} is not null" for m in MODES))
    count = lambda text: F.count_if(F.expr(text))
    return wide.agg(
        F.count(F.lit(1)).alias("tasks_with_all_3_modes"),
        count("full_pcl and not direct").alias("pcl_beats_direct"),
        count("full_pcl and not prompt_retry").alias("pcl_beats_retry"),
        count("prompt_retry and not full_pcl").alias("retry_beats_pcl"),
        count("direct and not prompt_retry and not full_pcl").alias("direct_beats_retry"),
        count("direct and prompt_retry and full_pcl").alias("all_pass_no_signal"),
        count("not direct and not prompt_retry and not full_pcl").alias("all_fail_no_signal"),
        count("full_pcl and not direct and not prompt_retry").alias("only_pcl_passes"),
    )


def preference_prompt(prompt: Column) -> Column:
    """The prompt of a preference row for trainers: non-empty contents joined by a space."""
    return F.array_join(F.filter(F.transform(prompt, lambda m: m["content"]), lambda c: c != ""), " ")
