"""Checks of training rows and verifiers: one aggregation each, issues as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.functions.running import at_ranks
from loomtrace.functions.text import injection_signal, short_hash

ISSUE = "struct<level:string,check:string,value:double,threshold:double>"
# What a finding of each severity costs; the checks' names, levels and bounds below are fixed too.
SEVERITY = {"critical": 0.4, "high": 0.2, "medium": 0.1, "low": 0.05, "info": 0.0}


def _issue(level: str, check: str, value: Column, threshold: float, when: Column) -> Column:
    made = F.struct(F.lit(level).alias("level"), F.lit(check).alias("check"), value.cast("double").alias("value"), F.lit(float(threshold)).alias("threshold"))
    return F.when(when, made)


def _issues(row: DataFrame, issues: list[Column]) -> DataFrame:
    return row.select(F.explode(F.array_compact(F.array(*issues))).alias("i")).select("i.*")


def check_sft(rows: DataFrame, min_records: int = 100, low: float = 0.05, high: float = 0.6, min_chars: int = 20) -> DataFrame:
    """rows: output_type and messages (role, content)."""
    own = F.filter("messages", lambda m: m["role"] == "assistant")
    short = F.length(F.try_element_at(own, F.lit(-1))["content"]) < min_chars
    n, share = F.col("n"), F.col("repair") / F.col("n")
    row = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("output_type") == "repair_patch").alias("repair"), F.count_if(F.coalesce(short, F.lit(False))).alias("short"))
    return _issues(
        row,
        [
            _issue("error", "sft_min_records", n, min_records, n < min_records),
            _issue("warning", "sft_repair_patch_fraction", F.round(share, 4), low, (n > 0) & (share < low)),
            _issue("warning", "sft_repair_patch_fraction", F.round(share, 4), high, (n > 0) & (share > high)),
            _issue("warning", "sft_short_assistant", F.col("short"), 0, F.col("short") > 0),
        ],
    )


def check_dpo(rows: DataFrame, min_records: int = 20, min_chars: int = 30, ratio: float = 10.0) -> DataFrame:
    """rows: chosen and rejected."""
    a, b = F.length("chosen"), F.length("rejected")
    skewed = ((b > 0) & (a / b > ratio)) | ((a > 0) & (b / a > ratio))
    row = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.trim("chosen") == F.trim("rejected")).alias("same"),
        F.count_if(a < min_chars).alias("short"),
        F.count_if(F.coalesce(skewed, F.lit(False))).alias("skewed"),
    )
    return _issues(
        row,
        [
            _issue("warning", "dpo_min_records", F.col("n"), min_records, F.col("n") < min_records),
            _issue("error", "dpo_identical_pairs", F.col("same"), 0, F.col("same") > 0),
            _issue("warning", "dpo_short_chosen", F.col("short"), 0, F.col("short") > 0),
            _issue("warning", "dpo_extreme_length_ratio", F.col("skewed"), 0, F.col("skewed") > 0),
        ],
    )


def anomalous_score(score: Column) -> Column:
    """Not null, and not a number from 0 to 1; NaN sorts above all numbers, so it is named."""
    number = score.try_cast("double")
    return score.isNotNull() & (number.isNull() | F.isnan(number) | (number < 0) | (number > 1))


def text_fields(of_actions: tuple[str, ...] = ()) -> Column:
    """Non-empty texts of a record that may carry an injection, and of its actions those of the fields named."""
    own = F.array("task", "final_answer", "prompt", "user_message")
    if of_actions:
        inner = F.flatten(F.transform("actions", lambda a: F.array(*[a[f] for f in of_actions])))
        own = F.concat(own, F.coalesce(inner, F.expr("cast(array() as array<string>)")))
    return F.filter(own, lambda x: F.coalesce(x, F.lit("")) != "")


def check_texts(rows: DataFrame, text: str = "text", normalized: bool = False) -> DataFrame:
    """Counts of texts by the first injection signal they hold."""
    return rows.select(injection_signal(F.col(text), normalized=normalized).alias("signal")).where("signal is not null").groupBy("signal").agg(F.count(F.lit(1)).alias("n"))


def validate_rows(rows: DataFrame) -> DataFrame:
    """errors of training rows with messages and, where present, chosen, rejected and reward."""
    first, last = F.try_element_at("messages", F.lit(1)), F.try_element_at("messages", F.lit(-1))
    empty = F.coalesce(F.size("messages"), F.lit(0)) <= 0
    blank = F.trim(F.coalesce(last["content"], F.lit(""))) == ""
    rules = [first["role"] != "user", last["role"] != "assistant", (last["role"] == "assistant") & blank]
    names = ["first message role is not user", "last message role is not assistant", "last assistant message has empty content"]
    if "chosen" in rows.columns:
        rules += [F.trim("chosen") == "", F.trim("rejected") == "", F.trim("chosen") == F.trim("rejected")]
        names += ["chosen is empty", "rejected is empty", "chosen and rejected are identical"]
    if "reward" in rows.columns:
        rules.append((F.col("reward") < 0) | (F.col("reward") > 1))
        names.append("reward outside [0, 1]")
    found = F.array_compact(F.array(*[F.when(r, n) for r, n in zip(rules, names, strict=True)]))
    return rows.withColumn("errors", F.when(empty, F.array(F.lit("messages is empty"))).otherwise(found))


def content_key(messages: Column) -> Column:
    """Key of a supervised row: the first 200 characters of each content, as the surveyed feature has it; the rest is not looked at."""
    return short_hash(F.array_join(F.transform(messages, lambda m: F.substring(F.coalesce(m["content"], F.lit("")), 1, 200)), "|"), 20)


def keep_first(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row of each key, by partial aggregation."""
    cols = rows.columns
    return rows.groupBy(key.alias("_k")).agg(F.min_by(F.struct(*cols), order).alias("r")).select("r.*")


def merge(sources: list[DataFrame], key, schema_version: str | None = None) -> DataFrame:
    """Ordered union of sources with the first row of each key; earlier sources win."""
    out = None
    for k, s in enumerate(sources):
        if schema_version is not None:
            s = s.where(F.col("schema_version") == schema_version)
        s = s.withColumn("_source", F.lit(k)).withColumn("_at", F.struct(F.lit(k).alias("k"), F.monotonically_increasing_id().alias("i")))
        out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    return keep_first(out, key, "_at").drop("_source", "_at")


def verifier_audit(records: DataFrame) -> DataFrame:
    """Per verifier: results, pass rate, findings and the strength left after their severities."""
    each = records.select(F.explode("verifier_results").alias("v")).select(
        F.coalesce("v.verifier_id", F.lit("<unknown>")).alias("verifier_id"), F.coalesce("v.passed", F.lit(False)).alias("passed"), "v.score", (F.coalesce(F.size("v.claim_ids"), F.lit(0)) <= 0).alias("bare")
    )
    row = each.groupBy("verifier_id").agg(F.count(F.lit(1)).alias("total"), (F.count_if("passed") / F.count(F.lit(1))).alias("pass_rate"), F.count("score").alias("scored"), F.count_distinct("score").alias("values"), F.count_if("bare").alias("bare"))
    low = F.lower("verifier_id")
    rules = {
        "oracle_leakage_risk": ("critical", F.contains(low, F.lit("oracle")) | F.contains(low, F.lit("ground_truth"))),
        "high_pass_rate": ("high", (F.col("pass_rate") > 0.95) & (F.col("total") >= 10)),
        "no_score_signal": ("medium", F.col("scored") == 0),
        "binary_score_only": ("medium", (F.col("scored") > 0) & (F.col("values") <= 2)),
        "low_pass_rate": ("medium", (F.col("pass_rate") < 0.05) & (F.col("total") >= 10)),
        "missing_claim_ids": ("low", F.col("bare") > F.col("total") * 0.5),
    }
    findings = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, (_, rule) in rules.items()]))
    lost = sum((rule.cast("int") * {"critical": 0.3, "high": 0.15}.get(severity, 0.0) for severity, rule in rules.values()), F.lit(0.0))
    return row.select("verifier_id", "total", "pass_rate", F.array_join(findings, ",").alias("findings"), F.greatest(F.lit(0.0), 1.0 - lost).alias("strength"))


def output_types(rows: DataFrame, by: str = "output_type") -> DataFrame:
    """Rows of each type and their share; null is a type."""
    counted = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n").alias("_all"))  # a row
    return counted.crossJoin(F.broadcast(total)).select(by, "n", (F.col("n") / F.col("_all")).alias("share"))


def benchmark_trust(findings: DataFrame) -> DataFrame:
    """1 less the weights of severities, 0 at least; findings: severity."""
    weight = F.coalesce(*[F.when(F.col("severity") == k, F.lit(v)) for k, v in SEVERITY.items()], F.lit(0.0))
    return findings.agg(F.greatest(F.lit(0.0), 1.0 - F.coalesce(F.sum(weight), F.lit(0.0))).alias("score"), F.count(F.lit(1)).alias("n"))


def length_stats(rows: DataFrame, tokens: Column, by: str) -> DataFrame:
    """Least, greatest, mean (whole), the value at index floor(0.95 n), and 1.2 times the greatest."""
    own = rows.select(by, tokens.alias("_t"))
    whole = own.groupBy(by).agg(F.min("_t").alias("least"), F.max("_t").alias("most"), F.floor(F.avg("_t")).alias("mean"), F.floor(F.max("_t") * 1.2).cast("long").alias("suggested"))
    ranked = at_ranks(own, [by], "_t", {"p95": F.least(F.floor(F.col("n") * 0.95), F.col("n") - 1)}).select(by, "p95")
    return whole.join(ranked, by).select(by, "least", "most", "mean", "p95", "suggested")
