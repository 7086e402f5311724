"""Metrics of evaluation groups, and paired comparisons of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.functions.running import at_ranks
from loomtrace.functions.stats import mcnemar, wilson


def group_metrics(records: DataFrame) -> DataFrame:
    """Nine metrics and two intervals a group; costs and latency over accepted tasks only."""
    total, valid = F.sum("tool_calls_total"), F.sum("tool_calls_valid")
    rounds = F.sum("repair_rounds")
    passed = F.col("final_pass")
    cost = F.col("prompt_tokens") + F.col("generation_tokens") + F.col("repair_tokens")
    n, n_pass = F.count(F.lit(1)), F.count_if(passed)
    return records.groupBy("group").agg(
        n.alias("n"),
        (n_pass / n).alias("taskspec_pass_rate"),
        wilson(n_pass, n, z=1.96).alias("taskspec_pass_ci"),
        F.when(total > 0, valid / total).otherwise(1.0).alias("tool_call_validity"),
        wilson(valid, total, z=1.96).alias("tool_call_validity_ci"),
        F.when(rounds > 0, F.sum("repair_rounds_ok") / rounds).otherwise(1.0).alias("repair_success_rate"),
        (F.count_if("has_evidence") / n).alias("evidence_sufficiency"),
        (F.count_if("escalated") / n).alias("fallback_rate"),
        (rounds / n).alias("avg_repair_rounds"),
        F.coalesce(F.avg(F.when(passed, cost)), F.lit(0.0)).alias("cost_per_accepted_task"),
        F.coalesce(F.avg(F.when(passed, F.col("latency_ms"))), F.lit(0.0)).alias("latency_per_accepted_ms"),
        F.avg("general_score").alias("general_ability_score"),
    )


def rounded(metrics: DataFrame) -> DataFrame:
    """The metrics as reports show them."""
    places = {"avg_repair_rounds": 3, "cost_per_accepted_task": 1, "latency_per_accepted_ms": 1}
    cols = [c for c, kind in metrics.dtypes if kind == "double"]
    return metrics.withColumns({c: F.round(c, places.get(c, 4)) for c in cols})


def last_row(df: DataFrame, key: str, seq: str) -> DataFrame:
    rest = [c for c in df.columns if c not in (key, seq)]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(key, "r.*")


def paired(a: DataFrame, b: DataFrame, key: str, correct: str = "correct", groups: tuple[str, ...] = ()) -> DataFrame:
    """Discordant counts, exact McNemar p, accuracies and their intervals over items of both sides."""
    both = a.select(key, *groups, F.col(correct).alias("_a")).join(b.select(key, *groups, F.col(correct).alias("_b")), [key, *groups])
    return discordance(both, F.col("_a"), F.col("_b"), groups)


def discordance(rows: DataFrame, a: Column, b: Column, groups: tuple[str, ...] = ()) -> DataFrame:
    n = F.count(F.lit(1))
    agg = rows.groupBy(*groups).agg(n.alias("n"), F.count_if(a).alias("n_a"), F.count_if(b).alias("n_b"), F.count_if(a & ~b).alias("b"), F.count_if(~a & b).alias("c"))
    ci_a, ci_b = wilson(F.col("n_a"), F.col("n")), wilson(F.col("n_b"), F.col("n"))
    return agg.select(*groups, "n", "n_a", "n_b", "b", "c", ((F.col("n_a") - F.col("n_b")) / F.col("n")).alias("delta"), ci_a["lo"].alias("a_lo"), ci_a["hi"].alias("a_hi"), ci_b["lo"].alias("b_lo"), ci_b["hi"].alias("b_hi"), mcnemar("b", "c").alias("p"))


def against_reference(records: DataFrame, reference: str, key: str = "task_id", correct: str = "final_pass") -> DataFrame:
    """Every other group against the reference group, over common tasks."""
    ref = records.where(F.col("group") == reference).select(key, F.col(correct).alias("_a"))
    rows = records.where(F.col("group") != reference).select(key, "group", F.col(correct).alias("_b")).join(ref, key)
    return discordance(rows, F.col("_a"), F.col("_b"), ("group",))


def pass_rates(records: DataFrame, by: str, correct: str = "final_pass") -> DataFrame:
    return records.groupBy(by).agg(F.count_if(correct).alias("n_pass"), F.count(F.lit(1)).alias("n"))


def nearest_rank(rows: DataFrame, by: list[str], value: str, q: dict[str, float]) -> DataFrame:
    """Per key n and, under each name, the sorted value at half-even-rounded q * (n - 1)."""
    return at_ranks(rows, by, value, {k: F.bround(F.lit(x) * (F.col("n") - 1), 0).cast("long") for k, x in q.items()})
