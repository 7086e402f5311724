"""Routing: feature vectors, labels, the rule classifier and its evaluation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.schemas import FEATURES, LABELS

SMALL, REPAIR, LARGE, HUMAN = LABELS


@dataclass(frozen=True)
class Limits:
    max_repair_rounds: int = 3
    max_violations: int = 3
    min_tool_validity: float = 0.8
    max_latency_ms: float = 30_000.0
    hard_constraint_limit: int = 10


def features(records: DataFrame, specs: DataFrame) -> DataFrame:
    """Evaluation records that have a task spec, with the 15 features.

    specs: task_id, n_constraints, n_hard, n_allowed_tools, max_repair_rounds; a dimension table.
    """
    rate = F.when(F.col("tool_calls_total") > 0, F.col("tool_calls_valid") / F.col("tool_calls_total")).otherwise(1.0)
    values = {
        "taskspec_n_constraints": F.col("n_constraints"), "taskspec_n_hard": F.col("n_hard"), "taskspec_has_tools": (F.col("n_allowed_tools") > 0).cast("int"),
        "taskspec_n_allowed_tools": F.col("n_allowed_tools"), "taskspec_max_repair_rounds": F.coalesce("max_repair_rounds", F.lit(3)),
        "eval_repair_rounds": F.col("repair_rounds"), "eval_violation_count": F.col("repair_rounds"), "eval_hard_violation_count": F.lit(0),
        "eval_tool_calls_total": F.col("tool_calls_total"), "eval_tool_calls_valid": F.col("tool_calls_valid"), "eval_tool_validity_rate": rate,
        "eval_escalated": F.col("escalated").cast("int"), "eval_latency_ms": F.col("latency_ms"), "eval_prompt_tokens": F.col("prompt_tokens"),
        "eval_generation_tokens": F.col("generation_tokens"),
    }
    joined = records.join(specs, "task_id")
    return joined.withColumns(values).withColumn("label", label()).select(*records.columns, "label", *FEATURES)


def vector() -> Column:
    return F.array(*[F.col(f).cast("double") for f in FEATURES])


def label(max_rounds: int = 3, failed_rounds: int = 2) -> Column:
    rounds = F.col("repair_rounds")
    return (
        F.when(F.col("escalated") | (rounds > max_rounds), LARGE)
        .when(F.col("final_pass") & (rounds == 0), SMALL)
        .when(F.col("final_pass") | (rounds < failed_rounds), REPAIR)
        .otherwise(LARGE)
    )


def decide(limits: Limits = Limits()) -> Column:
    """struct(label, reason) by the ordered rules over the feature columns."""
    f = F.col
    # The order of the rules and the texts of their reasons.
    rules = [
        (f("eval_escalated") != 0, LARGE, F.lit("already escalated in prior round")),
        (f("eval_repair_rounds") > limits.max_repair_rounds, LARGE, F.format_string(f"repair_rounds=%d > threshold={limits.max_repair_rounds}", "eval_repair_rounds")),
        (f("eval_violation_count") > limits.max_violations, LARGE, F.format_string(f"violation_count=%d > threshold={limits.max_violations}", "eval_violation_count")),
        ((f("eval_tool_calls_total") > 0) & (f("eval_tool_validity_rate") < limits.min_tool_validity), REPAIR, F.format_string(f"tool_validity_rate=%.2f < threshold={limits.min_tool_validity}", "eval_tool_validity_rate")),
        (f("taskspec_n_hard") > limits.hard_constraint_limit, LARGE, F.format_string(f"taskspec_n_hard=%d > limit={limits.hard_constraint_limit}", "taskspec_n_hard")),
        (f("eval_latency_ms") > limits.max_latency_ms, LARGE, F.format_string(f"latency=%.0fms > threshold={limits.max_latency_ms:.0f}ms", "eval_latency_ms")),
        (f("eval_repair_rounds") > 0, REPAIR, F.format_string("repair_rounds=%d > 0; repair path active", "eval_repair_rounds")),
    ]
    out = F.struct(F.lit(SMALL).alias("label"), F.lit("all thresholds satisfied").alias("reason"))
    for condition, name, reason in reversed(rules):
        out = F.when(condition, F.struct(F.lit(name).alias("label"), reason.alias("reason"))).otherwise(out)
    return out


def confusion(rows: DataFrame, truth: str = "label", predicted: str = "predicted") -> DataFrame:
    """The full label by label matrix with zeros."""
    labels = rows.sparkSession.createDataFrame([(x,) for x in LABELS], "label string")
    counted = rows.groupBy(F.col(truth).alias("label")).pivot(predicted, list(LABELS)).count()
    return labels.join(counted, "label", "left").na.fill(0)


def per_label(rows: DataFrame, truth: str = "label", predicted: str = "predicted") -> DataFrame:
    """True positives, false positives and false negatives a label."""
    each = F.explode(F.array(*[F.lit(x) for x in LABELS])).alias("name")
    t, p = F.col(truth) == F.col("name"), F.col(predicted) == F.col("name")
    return rows.select(truth, predicted, each).groupBy("name").agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))


def evidence_features(records: DataFrame) -> DataFrame:
    """The same features from evidence records, and the label they suggest."""
    deny = F.size(F.filter("capability_decisions", lambda d: d["decision"] == "deny"))
    failed = F.size(F.filter("verifier_results", lambda v: ~F.coalesce(v["passed"], F.lit(True))))
    broken = "error" in records.schema["actions"].dataType.elementType.fieldNames()
    done = lambda a: F.coalesce(a["state_changing"], F.lit(False)) & (F.coalesce(a["error"], F.lit("")) == "" if broken else F.lit(True))
    total, valid = F.size("actions"), F.size(F.filter("actions", done))
    suggested = F.when(deny >= 2, HUMAN).when(deny == 1, LARGE).when(failed > 0, REPAIR).otherwise(SMALL)
    zero = F.lit(0)
    values = {f: zero for f in FEATURES} | {
        "taskspec_has_tools": (total > 0).cast("int"), "eval_violation_count": failed, "eval_hard_violation_count": deny, "eval_tool_calls_total": total, "eval_tool_calls_valid": valid,
        "eval_tool_validity_rate": F.when(total > 0, valid / total).otherwise(1.0), "eval_escalated": (failed > 0).cast("int"), "eval_latency_ms": F.lit(0.0),
    }
    return records.select("run_id", *[v.alias(k) for k, v in values.items()], suggested.alias("label"))
