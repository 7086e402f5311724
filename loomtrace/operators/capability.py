"""Capability tags of episode steps, and the gaps between a rollout's passing and failing branches."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.functions import phrases
from loomtrace.operators.training import branch_steps, episode_steps

# Parts of tool names and the tag each stands for.
TOOL_TAGS = {
    "read_file": "file_localization", "write_file": "file_localization", "search": "file_localization", "visual": "visual_grounding",
    "screenshot": "visual_grounding", "build": "build_repair", "run_build": "build_repair", "run_test": "build_repair",
    "typecheck": "build_repair", "shell": "cost_control", "approve": "policy_compliance", "policy": "policy_compliance",
}
VERIFIER_TAGS = {"build_passes": "build_repair", "test_passes": "build_repair", "policy_ok": "policy_compliance", "visual_assert": "visual_grounding"}
INSUFFICIENT = ("insufficient", "more information", "need more", "unclear", "ambiguous")
ERRORS = ("error", "traceback", "exception", "Error:", "Traceback")
PLANNING = ("plan", "step 1", "first,", "i will", "let me")
# The order in which a missing tag names the failure.
FAILURES = (
    "file_localization", "argument_generation", "planning", "recovery_after_error", "state_tracking",
    "build_repair", "visual_grounding", "policy_compliance", "cost_control", "insufficient_context_detection",
)


def _any(text: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(p)) for p in parts))


def _seen(has_arguments: Column, of: Callable[[str], Column]) -> Column:
    """What the rules look at in a step, each text lower-cased once."""
    answers = (of("role") == "agent") & of("tool_name").isNull()
    return F.struct(
        F.lower(F.coalesce(of("tool_name"), F.lit(""))).alias("tool"), F.when(answers, F.lower(F.coalesce(of("content"), F.lit("")))).alias("answer"),
        F.when(of("role") == "environment", F.coalesce(of("content"), F.lit(""))).alias("outcome"), has_arguments.alias("arguments"), ((of("role") == "agent") & (of("step_index") > 0)).alias("later"),
    )


def _ruled(s: Column, by_tool: bool = True) -> list[tuple[Column, list[tuple[Column, str]]]]:
    """Tags by condition, under a condition that they have in common."""
    named = [(_any(s["tool"], tuple(k for k, v in TOOL_TAGS.items() if v == tag)), tag) for tag in dict.fromkeys(TOOL_TAGS.values())] if by_tool else []
    return [
        (s["tool"] != "", [*named, (F.lit(True), "tool_selection")]),
        (s["answer"].isNotNull(), [(_any(s["answer"], PLANNING), "planning"), (_any(s["answer"], INSUFFICIENT), "insufficient_context_detection")]),
        (s["outcome"].isNotNull(), [(_any(s["outcome"], ERRORS), "recovery_after_error")]),
        (F.lit(True), [(s["arguments"], "argument_generation"), (s["later"], "state_tracking")]),
    ]


def tags(has_arguments: Column, verifier_keys: Column | None = None, tools: DataFrame | None = None, verifiers: DataFrame | None = None) -> Column:
    """Sorted tags of a step with columns role, content, tool_name and step_index.

    ``tools`` and ``verifiers`` are tables (phrase, tag) in place of ``TOOL_TAGS`` (parts of the lower-cased
    tool's name) and ``VERIFIER_TAGS`` (whole keys). The rules are looked at in a lambda over the step's one
    value, as in line they make a method too large for the JIT compiler.
    """
    empty = F.expr("cast(array() as array<string>)")
    listed = lambda s: F.concat(*[F.when(gate, F.array(*[F.when(c, F.lit(t)) for c, t in rules])).otherwise(empty) for gate, rules in _ruled(s, tools is None)])
    found = F.array_compact(F.element_at(F.transform(F.array(_seen(has_arguments, F.col)), listed), 1))
    if verifier_keys is not None:
        known = VERIFIER_TAGS.items() if verifiers is None else phrases.rules(verifiers)
        found = F.concat(found, F.array_compact(F.array(*[F.when(F.array_contains(verifier_keys, k), F.lit(v)) for k, v in known])))
    if tools is not None:
        found = F.concat(found, phrases.tags(F.lower(F.coalesce("tool_name", F.lit(""))), phrases.rules(tools), fold=False))
    return F.sort_array(F.array_distinct(found))


#: The tags of ``TOOL_TAGS`` and of the other rules in order; a step's tags are bits of a number, and strings only where a gap is told.
MARKS = sorted({*TOOL_TAGS.values(), "tool_selection", "planning", "insufficient_context_detection", "recovery_after_error", "argument_generation", "state_tracking"})


def _either(parts: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def marks(has_arguments: Column, of: Callable[[str], Column]) -> Column:
    """The tags of a step as bits of their places in ``MARKS``."""
    own = lambda s: _either(F.when(gate, _either(F.when(c, F.lit(1 << MARKS.index(t))).otherwise(0) for c, t in rules)).otherwise(0) for gate, rules in _ruled(s))
    return F.element_at(F.transform(F.array(_seen(has_arguments, of)), own), 1)


def _has_arguments(of: Callable[[str], Column] = F.col) -> Column:
    return of("tool_name").isNotNull() & ~of("content").endswith('"arguments": {}}')


def tagged_steps(rollouts: DataFrame, tools: DataFrame | None = None) -> DataFrame:
    """Every step of every branch with its tags, reference and first 120 characters."""
    steps = episode_steps(rollouts)
    snippet = F.substring(F.when(F.coalesce("tool_name", F.lit("")) != "", F.col("tool_name")).otherwise(F.col("content")), 1, 120)
    return steps.select("rollout_id", "branch_index", "step_index", F.concat_ws("/", "episode_id", "step_index").alias("step_ref"), tags(_has_arguments(), tools=tools).alias("tags"), snippet.alias("snippet"))


def gaps(rollouts: DataFrame, tools: DataFrame | None = None) -> DataFrame:
    """Each failing branch against its rollout's best passing one, where tags are missing; ``tools`` as for ``tags``.

    A branch's steps are looked at in its row, as bits; only a table of tools, whose automaton runs beside
    Spark and whose tags may be any, has them as rows and strings.
    """
    key = ["rollout_id", "branch_index"]
    rollouts = rollouts.where(F.col("rollout_id").isNotNull() & F.col("branch_index").isNotNull())
    own = F.struct("objective_score", "objective_status", F.coalesce("total_score", F.lit(0.0)).alias("total_score"), F.size("tools").alias("n_calls"))
    if tools is None:
        def marked(s: Column, i: Column) -> Column:
            of = lambda c: i if c == "step_index" else s[c]
            return F.struct(i.alias("step_index"), marks(_has_arguments(of), of).alias("tags"))

        rows = rollouts.select(*key, own.alias("own"), F.transform(branch_steps(), marked).alias("steps"))
        branches = rows.groupBy(*key).agg(F.collect_list("own").alias("own"), F.flatten(F.collect_list("steps")).alias("steps"))
        all_tags = F.aggregate("steps", F.lit(0), lambda x, s: x.bitwiseOR(s["tags"]))
        missing, some = F.col("p.tags").bitwiseAND(F.bitwise_not("tags")), F.col("missing") != 0
        shared = lambda s: s["tags"].bitwiseAND(F.col("missing")) != 0
        diff = F.filter(F.array(*[F.lit(t) for t in MARKS]), lambda _, i: F.expr("missing").bitwiseAND(F.call_function("shiftleft", F.lit(1), i)) != 0)
    else:
        steps = tagged_steps(rollouts, tools).groupBy(*key).agg(F.collect_list(F.struct("step_index", "tags")).alias("steps"))
        branches = rollouts.groupBy(*key).agg(F.collect_list(own).alias("own")).join(steps, key)
        all_tags = F.array_distinct(F.flatten("steps.tags"))
        missing, some = F.sort_array(F.array_except("p.tags", "tags")), F.size("missing") > 0
        shared, diff = lambda s: F.arrays_overlap(s["tags"], F.col("missing")), F.col("missing")
    rows = branches.select(*key, F.explode("own").alias("own"), all_tags.alias("tags"), "steps").select(*key, "own.*", "tags", "steps")
    best = rows.where("objective_score = 1").groupBy("rollout_id").agg(F.max_by(F.struct("branch_index", "tags", "steps"), F.struct("total_score", -F.col("branch_index"))).alias("p"))
    pairs = rows.where("objective_score = 0").drop("steps").join(best, "rollout_id").withColumn("missing", missing).where(some).withColumn("diff", diff)
    hit = F.array_min(F.transform(F.filter("p.steps", shared), lambda s: s["step_index"]))
    order = F.array(*[F.lit(x) for x in FAILURES])
    return pairs.select(
        "rollout_id",
        F.col("p.branch_index").alias("passing_branch"),
        F.col("branch_index").alias("failing_branch"),
        F.array_join("diff", ",").alias("tag_diff"),
        F.coalesce(F.try_element_at(F.filter(order, lambda x: F.array_contains("diff", x)), F.lit(1)), F.lit("unknown")).alias("failure_class"),
        F.when(F.col("objective_status").isin("pass", "fail"), "dpo_pair").otherwise("sft_targeted").alias("suggested_training_type"),
        F.concat_ws("/", "rollout_id", "p.branch_index", hit).alias("positive_step_ref"),
        F.greatest(F.lit(-0.1), -0.01 * F.greatest(F.lit(0), F.col("n_calls") - 1)).alias("reward_cost"),
    )


def gap_summary(rollouts: DataFrame) -> DataFrame:
    return gaps(rollouts).groupBy("failure_class", "suggested_training_type").agg(F.count(F.lit(1)).alias("n"))
