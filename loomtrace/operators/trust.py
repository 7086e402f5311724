"""Admission, trust and calibrated scores of evidence records; trust of subjects over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.functions.running import running
from loomtrace.functions.stats import geometric_mean
from loomtrace.shared import written

# Versions, categories, weights, required fields and bucket bounds.
VERSIONS = ("aep/v0.1", "aep/v0.2", "aep/v0.3", "aep/v0.4")
CATEGORIES = ("train_sft", "train_dpo", "train_repair", "train_router", "audit_only", "reject")
WEIGHTS = {"schema_validity": 0.20, "evidence_completeness": 0.25, "policy_compliance": 0.20, "verifier_strength": 0.15, "provenance": 0.10, "contamination_risk": 0.10}
REQUIRED = ("schema_version", "run_id", "model_id", "repo_commit", "tool_manifest_digest", "actions", "capability_decisions", "verifier_results", "created_at_ms")
# What lowers an admission score, in the order in which it is said; the last takes the score.
REASONS = (
    "invalid schema_version", "no capability_decisions for state-changing run", "no verifier_results", "missing repo_commit or model_id",
    "missing tool_manifest_digest \u2014 contamination risk elevated", "score %.2f below reject threshold 0.40",
)
BUCKETS = (0.0, 0.25, 0.5, 0.6, 0.75, 0.9, 1.0)


def _n(array: str | Column) -> Column:
    """Elements of an array, 0 for null."""
    return F.greatest(F.size(array), F.lit(0))


def _text(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) != ""


def changing() -> Column:
    return F.filter("actions", lambda a: F.coalesce(a["state_changing"], F.lit(False)))


def evidenced() -> Column:
    """State-changing actions with a result digest or evidence references."""
    return F.filter(changing(), lambda a: _text(a["result_digest"]) | (_n(a["evidence_refs"]) > 0))


def admission(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """run_id, score, category, the six dimensions, the reasons, and the columns to ``keep``."""
    n = _n(changing())
    with_digest = _n(F.filter(changing(), lambda a: _text(a["result_digest"]) | _text(a["precondition_digest"])))
    verifiers = _n("verifier_results")
    dims = {
        "schema_validity": F.lit(1.0),
        "evidence_completeness": F.when(n > 0, with_digest / n).otherwise(1.0),
        "policy_compliance": F.when((_n("capability_decisions") > 0) | (n == 0), 1.0).otherwise(0.5),
        "verifier_strength": F.least(F.lit(1.0), verifiers * 0.5),
        "provenance": F.when(_text("repo_commit") & _text("model_id"), 1.0).otherwise(0.5),
        "contamination_risk": F.when(_text("tool_manifest_digest"), 1.0).otherwise(0.7),
    }
    valid = F.coalesce(F.col("schema_version").isin(*VERSIONS), F.lit(False))
    bonus = F.when(F.col("recording_mode") == "full", 0.05).when(F.col("recording_mode") == "delta", 0.02).otherwise(0.0)
    score = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        score = score + F.col(name) * weight
    rows = records.select("*", *[v.alias(k) for k, v in dims.items()])
    rows = rows.withColumn("score", F.when(valid, F.least(F.lit(1.0), score + bonus)).otherwise(0.0))
    repair = F.exists("verifier_results", lambda v: F.contains(F.lower(F.coalesce(v["verifier_id"], F.lit(""))), F.lit("repair")))
    passed = _n(F.filter("verifier_results", lambda v: F.coalesce(v["passed"], F.lit(False)))) > 0
    pair = _text("dpo_pair_id") if "dpo_pair_id" in records.columns else F.lit(False)
    category = (
        F.when(~valid | (F.col("score") < 0.4), "reject")
        .when(F.col("score") < 0.6, "audit_only")
        .when(F.coalesce(repair, F.lit(False)), "train_repair")
        .when(pair, "train_dpo")
        .when(passed & (F.col("evidence_completeness") >= 0.8), "train_sft")
        .otherwise("train_router")
    )
    low = [F.col("policy_compliance") < 1, F.col("verifier_strength") == 0, F.col("provenance") < 1, F.col("contamination_risk") < 1]
    said = F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, r in zip(low, REASONS[1:5], strict=True)], F.when(F.col("score") < 0.4, F.format_string(REASONS[5], "score"))))
    reasons = F.when(valid, said).otherwise(F.array(F.lit(REASONS[0])))
    return rows.select("run_id", F.round("score", 4).alias("score"), category.alias("category"), *[F.when(valid, F.col(d)).alias(d) for d in WEIGHTS], reasons.alias("reasons"), *keep)


def admission_summary(records: DataFrame) -> DataFrame:
    """Count and mean score of every category, zeros included."""
    names = records.sparkSession.createDataFrame([(c,) for c in CATEGORIES], "category string")
    counted = admission(records).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"))
    return names.join(counted, "category", "left").na.fill(0, ["n"])


def dimensions() -> dict[str, Column]:
    """The four evidence dimensions, each null without evidence."""
    n, denied = _n(changing()), _n(F.filter("capability_decisions", lambda d: d["decision"] == "deny"))
    passed = _n(F.filter("verifier_results", lambda v: F.coalesce(v["passed"], F.lit(False))))
    budgets = [F.col(f"budget_ledger.{b}") for b in ("token_budget", "retry_budget", "tool_budget")]
    checks = sum((b["limit"].isNotNull().cast("int") for b in budgets), F.lit(0))
    over = sum((F.coalesce(b["spent"] > b["limit"], F.lit(False)).cast("int") for b in budgets), F.lit(0))
    share = lambda part, whole: F.when(whole > 0, part / whole)
    return {
        "evidence_completeness": share(_n(evidenced()), n),
        "policy_compliance": 1.0 - share(denied, _n("capability_decisions")),
        "verifier_agreement": share(passed, _n("verifier_results")),
        "budget_compliance": 1.0 - share(F.coalesce(over, F.lit(0)), F.coalesce(checks, F.lit(0))),
    }


def receipt(present: Column, verified: Column) -> Column:
    return F.when(present & verified, 1.0).when(present, 0.7).otherwise(0.5)


def grade(overall: Column, known: Column) -> Column:
    return F.when((overall >= 0.9) & (known >= 6), "A").when((overall >= 0.75) & (known >= 4), "B").when(overall >= 0.6, "C").when(overall >= 0.4, "D").otherwise("F")


def trust(records: DataFrame, extra: dict[str, Column] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """run_id, each dimension, overall (geometric mean of the known ones), known and grade.

    ``extra`` adds named dimensions, clamped to 0..1; supply_chain_integrity is 0.5 unless given.
    """
    dims = dimensions() | {"supply_chain_integrity": F.lit(0.5)}
    dims |= {k: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)) for k, v in (extra or {}).items()}
    rows = records.select("run_id", *keep, *[v.alias(k) for k, v in dims.items()])
    values = F.array(*[F.col(d) for d in dims])
    rows = rows.withColumn("overall", geometric_mean(values)).withColumn("known", F.size(F.array_compact(values)))
    return rows.withColumn("grade", grade(F.col("overall"), F.col("known")))


def calibrated(records: DataFrame) -> DataFrame:
    """Evidence health, policy risk, training eligibility, their composite and its label."""
    present = sum((F.col(c).isNotNull().cast("int") for c in REQUIRED), F.lit(0))
    n, with_evidence = _n(changing()), _n(evidenced())
    coverage = F.when(n > 0, with_evidence / n).otherwise(1.0)
    decisions, verifiers = _n("capability_decisions"), _n("verifier_results")
    deny = F.when(decisions > 0, _n(F.filter("capability_decisions", lambda d: d["decision"] == "deny")) / decisions).otherwise(0.0)
    passed = F.when(verifiers > 0, _n(F.filter("verifier_results", lambda v: F.coalesce(v["passed"], F.lit(False)))) / verifiers).otherwise(0.5)
    health = present / len(REQUIRED) * 0.4 + (_n("actions") > 0).cast("double") * 0.3 + coverage * 0.3
    risk = F.greatest(F.lit(0.0), 1.0 - (deny * 0.6 + (1.0 - coverage) * 0.4))
    source = _text("repo_commit").cast("double") * 0.5 + _text("tool_manifest_digest").cast("double") * 0.5
    eligible = passed * 0.45 + coverage * 0.30 + source * 0.25
    rows = records.select("run_id", health.alias("evidence_health"), risk.alias("policy_risk"), eligible.alias("training_eligibility"))
    rows = rows.withColumn("composite", F.col("evidence_health") * 0.35 + F.col("policy_risk") * 0.35 + F.col("training_eligibility") * 0.30)
    c = F.col("composite")
    return rows.withColumn("label", F.when(c >= 0.8, "high_trust").when(c >= 0.6, "medium_trust").when(c >= 0.4, "low_trust").otherwise("untrusted"))


def scored(records: DataFrame, subject: str, order: str) -> DataFrame:
    """The subject, order, run_id and overall trust of each record that has one."""
    return trust(records, keep=tuple(dict.fromkeys((subject, order)))).where(F.col("overall").isNotNull()).select(subject, order, "run_id", "overall")


def by_subject(records: DataFrame, subject: str, order: str) -> DataFrame:
    """Trust of each subject over its records in order: means, spread, extremes, and the drift between halves."""
    # read three times below, so the narrow rows are written once
    return over_time(written(scored(records, subject, order), "scored"), subject, order)


def over_time(scored: DataFrame, subject: str, order: str) -> DataFrame:
    """``by_subject`` of rows that are scored."""
    many = scored.groupBy(subject).agg(F.count(F.lit(1)).alias("m"))
    ranked = running(scored, [subject], order, {"k": F.lit(1).cast("long")}, ties=("run_id",)).join(many, subject)
    first = F.col("k") <= F.floor(F.col("m") / 2)
    s = F.col("overall")
    half = F.abs(F.avg(F.when(~first, s)) - F.avg(F.when(first, s)))
    return ranked.groupBy(subject).agg(
        F.count(F.lit(1)).alias("n_records"),
        F.when(F.min(s) > 0, F.exp(F.avg(F.ln(F.when(s > 0, s))))).otherwise(0.0).alias("overall"),
        F.avg(s).alias("mean"),
        F.stddev_samp(s).alias("std_dev"),
        F.min(s).alias("min_score"),
        F.max(s).alias("max_score"),
        F.when(F.count(F.lit(1)) >= 4, half).alias("drift"),
    )


def exposition(subjects: DataFrame, subject: str) -> DataFrame:
    """Gauge lines: one for the score and one for each bucket bound a subject."""
    bounds = F.explode(F.array(*[F.lit(b) for b in BUCKETS])).alias("le")
    rows = subjects.select(subject, "overall", bounds)
    line = F.format_string('agent_trust_score_bucket{subject_id="%s",le="%s"} %d', F.col(subject).cast("string"), F.col("le").cast("string"), (F.col("overall") <= F.col("le")).cast("int"))
    return rows.select(subject, "le", line.alias("line"))


def historical_consistency(status: Column, score: Column) -> Column:
    """Aggregate over traces: pass 1, fail 0, else the clamped score; null without any."""
    return F.avg(F.when(status == "pass", 1.0).when(status == "fail", 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))))
