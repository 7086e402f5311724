"""Losses from trainer logs, training health, and the routing decision of wrong answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Channels that a repair of the surface can mend.
FIRST_CLASS = ("A_truncated", "A_extract_v2", "B_stepwise", "B_selfcorrect_regress", "C_token")


def loss(line: Column) -> Column:
    """The loss of a JSON line, or the number that follows the first "loss"; null without one."""
    of_json = F.when(F.trim(line).startswith("{"), F.get_json_object(line, "$.loss").try_cast("double"))
    named = F.regexp_extract(F.lower(line), r"""loss[_=: \t'"]*([-.0-9e]+)""", 1).try_cast("double")
    return F.coalesce(of_json, named)


def history(lines: DataFrame, order: str = "seq", by: tuple[str, ...] = ()) -> DataFrame:
    """Per run: its losses in order, the first, the last and their number."""
    rows = lines.select(*by, F.col(order).alias("_o"), loss(F.col("value")).alias("loss")).where("loss is not null")
    kept = rows.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_o", "loss"))), lambda x: x["loss"]).alias("losses"))
    return kept.select(*by, "losses", F.element_at("losses", 1).alias("initial_loss"), F.element_at("losses", -1).alias("final_loss"), F.size("losses").alias("steps"))


def health(converged_below: float = 0.1) -> Column:
    """Half convergence, three tenths improvement, a fifth stability of the later half."""
    losses = F.col("losses")
    first, last, n = F.try_element_at(losses, F.lit(1)), F.try_element_at(losses, F.lit(-1)), F.size("losses")
    converged = F.when(last < converged_below, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), converged_below / last)))
    improved = F.when((n >= 2) & (first > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (first - last) / first))).otherwise(0.0)
    tail = F.slice(losses, F.floor(n / 2).cast("int") + 1, F.greatest(n - F.floor(n / 2).cast("int"), F.lit(1)))
    mean = F.aggregate(tail, F.lit(0.0), lambda s, x: s + x) / F.size(tail)
    spread = F.sqrt(F.aggregate(tail, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / F.size(tail))
    stable = F.when((n >= 4) & (mean > 0), F.greatest(F.lit(0.0), 1.0 - F.least(F.lit(1.0), spread / mean))).otherwise(0.5)
    return F.when(n > 0, 0.5 * converged + 0.3 * improved + 0.2 * stable).otherwise(0.0)


def decision(counts: DataFrame, alpha: float = 0.15, beta: float = 0.30) -> DataFrame:
    """counts: n_total, n_wrong, lottery_rate and a column a channel; adds rates and the case."""
    first = sum((F.coalesce(F.col(c), F.lit(0)) for c in FIRST_CLASS if c in counts.columns), F.lit(0))
    rate = F.when(F.col("n_total") > 0, first / F.col("n_total")).otherwise(0.0)
    case = F.when(F.col("lottery_rate") >= beta, "beta").when(rate >= alpha, "alpha").otherwise("gamma")
    return counts.select("*", first.alias("n_first_class"), rate.alias("first_class_rate"), case.alias("decision"))
