"""Compliance of evidence records, as they arrive or in batch.

The verdict's parts that need one record are columns; the hard-violation budget of a subject is keyed
state (``transformWithStateInPandas``) on a stream and a running count in batch, with equal results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from loomtrace.functions.running import running
from loomtrace.functions.text import injection_signal
from loomtrace.operators import trust
from loomtrace.operators.quality import anomalous_score, text_fields

FEEDBACK = "subject string, run_id string, seq long, hard string, soft string, n_hard long, verdict string"


def subject() -> Column:
    """The first non-empty of subject_id, user_id, the context's, run_id and trace_id."""
    named = [F.when(F.col(c) != "", F.col(c)) for c in ("subject_id", "user_id", "run_context.subject_id", "run_context.user_id", "run_id", "trace_id")]
    return F.coalesce(*named, F.lit("<unknown>"))


def checks(records: DataFrame, seq: str, floor: float = 1.0, signature: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """subject, run_id, seq, the first hard violation, and a soft one: the part without state; and the columns to ``keep``."""
    schema = ~F.coalesce(F.col("schema_version").isin(*trust.VERSIONS), F.lit(False)) | F.col("run_id").isNull() | F.col("created_at_ms").isNull()
    joined = F.array_join(text_fields(), "\n")
    hard = F.when(schema, "aep_schema")
    if signature is not None:  # errors of each record's signature
        hard = hard.when(F.size(signature) > 0, "aep_signature")
    hard = hard.when(anomalous_score(F.col("objective_score")), "objective_score_in_range").when(injection_signal(joined).isNotNull(), "no_injection_signal")
    n = F.size(trust.changing())
    soft = F.when((n > 0) & (F.size(trust.evidenced()) / n < floor), "evidence_complete")
    rows = records.select(subject().alias("subject"), F.coalesce("run_id", "trace_id", F.concat(F.lit("<seq-"), F.col(seq).cast("string"), F.lit(">"))).alias("run_id"), F.col(seq).cast("long").alias("seq"), hard.alias("hard"), soft.alias("soft"), *keep)
    return rows.withColumn("soft", F.when(F.col("hard").isNull(), F.col("soft")))


def verdict(budget: int) -> Column:
    over = F.col("n_hard") > budget
    return F.when(F.col("hard").isNotNull(), "reject").when(F.col("soft").isNotNull() | over, "quarantine").otherwise("pass")


def batch(checked: DataFrame, budget: int = 3) -> DataFrame:
    """Feedback rows with the running count of a subject's hard violations."""
    counted = running(checked, ["subject"], "seq", {"n_hard": F.col("hard").isNotNull().cast("long")})
    return counted.withColumn("verdict", verdict(budget))


def feedback(checked: DataFrame, scores: DataFrame | None = None, budget: int = 3) -> DataFrame:
    """Feedback with its violations as rows of an array, the budget's among them, and, for records that end early none, the admission (run_id, score, category)."""
    rows = batch(checked, budget)
    one = lambda id, level, category, when: F.when(when, F.struct(id.alias("constraint_id"), F.lit(level).alias("level"), category.alias("category")))
    kind = F.when(F.col("hard") == "aep_schema", "format").otherwise("security")
    over = F.col("n_hard") > budget
    found = F.array_compact(F.array(one(F.col("hard"), "hard", kind, F.col("hard").isNotNull()), one(F.col("soft"), "soft", F.lit("evidence"), F.col("soft").isNotNull()), one(F.lit("subject_violation_budget"), "soft", F.lit("policy"), over)))
    rows = rows.withColumn("violations", found).withColumn("early_terminated", F.col("hard").isNotNull())
    if scores is None:
        return rows
    own = scores.select(F.col("run_id").alias("_r"), "score", "category")
    joined = rows.join(own, F.col("run_id") == F.col("_r"), "left").drop("_r")
    return joined.withColumns({c: F.when(~F.col("early_terminated"), F.col(c)) for c in ("score", "category")})


class _Budget(StatefulProcessor):
    def __init__(self, budget: int, columns: list[str]):
        self.budget, self.columns = budget, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("n_hard", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n = self.count.get()[0] if self.count.exists() else 0
        f = pd.concat(list(rows)).sort_values("seq")
        f["n_hard"] = n + f["hard"].notna().cumsum()
        over = f["n_hard"] > self.budget
        f["verdict"] = "pass"
        f.loc[f["soft"].notna() | over, "verdict"] = "quarantine"
        f.loc[f["hard"].notna(), "verdict"] = "reject"
        self.count.update((int(f["n_hard"].iloc[-1]),))
        yield f[self.columns]

    def close(self) -> None:
        pass


def stream(checked: DataFrame, budget: int = 3) -> DataFrame:
    """The same feedback from a stream, further columns kept; the counts live in the state store, one long a subject."""
    own = [f.split()[0] for f in FEEDBACK.split(", ")]
    more = [f for f in checked.schema.fields if f.name not in own]
    schema = ", ".join([FEEDBACK, *[f"{f.name} {f.dataType.simpleString()}" for f in more]])
    return checked.groupBy("subject").transformWithStateInPandas(_Budget(budget, [*own, *[f.name for f in more]]), schema, "append", "none")


def stats(feedback: DataFrame, latency: Column | None = None, sla_ms: float = 1000.0) -> DataFrame:
    """Counts of verdicts, violation rate and, given latencies, mean, greatest and within the limit."""
    n = F.count(F.lit(1))
    cols = [n.alias("n"), F.count_if(F.col("verdict") == "pass").alias("n_pass"), F.count_if(F.col("verdict") == "quarantine").alias("n_quarantine"), F.count_if(F.col("verdict") == "reject").alias("n_reject"), (F.count_if(F.col("verdict") != "pass") / n).alias("violation_rate")]
    if latency is not None:
        cols += [F.avg(latency).alias("mean_ms"), F.max(latency).alias("max_ms"), (F.count_if(latency <= sla_ms) / n).alias("within_sla")]
    return feedback.agg(*cols)
