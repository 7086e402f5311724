"""Reports as Markdown: aggregates are computed as DataFrames, and a few rows of them are rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.functions import text as T
from loomtrace.functions.stats import paired_bootstrap, quantile_of_normal, wilson
from loomtrace.operators import metrics, quality
from loomtrace.operators.lint import SURFACES

# Controls of the coverage matrix, the risk and the field of evidence of each.
CONTROLS = (
    ("OWASP-MCP-01", "Tool Poisoning", "tool_manifest_digest"), ("OWASP-MCP-02", "Scope Creep", "capability_decisions"), ("OWASP-MCP-03", "Rug Pull", "tool_manifest_digest"),
    ("OWASP-MCP-05", "Taint Passthrough", "input_refs[*].taint_labels"), ("OWASP-MCP-07", "Supply Chain", "repo_commit"), ("OTel-GenAI", "Observability Export", "trace_id"), ("AEP-Provenance", "Action Provenance", "actions[*].result_digest"),
)


def table(head: list[str], rows: list[list]) -> str:
    return "\n".join("| " + " | ".join(map(str, r)) + " |" for r in [head, ["---"] * len(head), *rows])


def evidence(validated: DataFrame, by: str = "file") -> DataFrame:
    """Per file: records that pass, all, and the mean completeness of their evidence."""
    return validated.groupBy(by).agg(F.count_if("passed").alias("n_passed"), F.count(F.lit(1)).alias("n"), F.avg("evidence_completeness").alias("completeness"))


def _present() -> dict[str, Column]:
    text = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    any_ = lambda rows, test: F.coalesce(F.exists(rows, test), F.lit(False))
    return {
        "tool_manifest_digest": text("tool_manifest_digest"), "repo_commit": text("repo_commit"), "trace_id": text("trace_id"), "capability_decisions": F.size("capability_decisions") > 0,
        "input_refs[*].taint_labels": any_("input_refs", lambda r: F.size(r["taint_labels"]) > 0), "actions[*].result_digest": any_("actions", lambda a: a["result_digest"] != ""),
    }


def standards(records: DataFrame) -> DataFrame:
    """Per control: records with its field of evidence, their share in per cent, and covered, partial or gap."""
    fields = _present()
    kinds = dict(records.dtypes)
    if "taint_labels" not in kinds.get("input_refs", ""):
        fields["input_refs[*].taint_labels"] = F.lit(False)
    if "trace_id" not in kinds:
        fields["trace_id"] = F.lit(False)
    names = list(fields)
    counted = records.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(fields[f]).alias(f"c{k}") for k, f in enumerate(names)])
    each = F.array(*[F.struct(F.lit(c).alias("control"), F.lit(r).alias("risk"), F.lit(f).alias("field"), F.col(f"c{names.index(f)}").alias("present")) for c, r, f in CONTROLS])
    out = counted.select("n", F.explode(each).alias("x")).select("x.*", "n", F.when(F.col("n") > 0, F.col("x.present") / F.col("n") * 100).otherwise(0.0).alias("percent"))
    return out.withColumn("status", F.when(F.col("percent") >= 50, "covered").when(F.col("percent") > 0, "partial").otherwise("gap"))


def audit(title: str, date: str, validated: DataFrame | None = None, records: DataFrame | None = None, lint: dict[str, DataFrame] | None = None, receipts: list[dict] | None = None) -> str:
    """Validation, coverage of standards, benchmark folders and run receipts in one report."""
    out = [f"# {title}\n\n> {date}", "## Record validation"]
    if validated is None:
        out.append("_No records given._")
    else:
        rows = evidence(validated).orderBy("file").collect()
        passed, n = sum(r["n_passed"] for r in rows), sum(r["n"] for r in rows)
        out += [f"**{passed} pass, {n - passed} fail**", table(["File", "Passed", "Evidence completeness"], [[r["file"], f"{r['n_passed']}/{r['n']}", f"{r['completeness']:.0%}"] for r in rows])]
    out.append("## Standards coverage")
    if records is None:
        out.append("_No records given._")
    else:
        out.append(table(["Control", "Risk", "Evidence field", "Coverage", "Status"], [[r["control"], r["risk"], f"`{r['field']}`", f"{r['present']}/{r['n']} ({r['percent']:.0f}%)", r["status"]] for r in standards(records).collect()]))
    out.append("## Benchmark trust")
    for folder, found in (lint or {}).items():
        out.append(folder_report(folder, found))
    if not lint:
        out.append("_No task folders given._")
    out.append("## Provenance")
    for r in receipts or []:
        out.append(f"### {r.get('run_id')}\n\n- Operator: {r.get('operator')}\n- Models: {', '.join(r.get('models') or []) or 'none'}\n- Receipt digest: `{str(r.get('receipt_digest'))[:16]}`\n- Inputs: {len(r.get('inputs') or {})}, outputs: {len(r.get('outputs') or {})}")
    if not receipts:
        out.append("_No receipts given._")
    return "\n\n".join(out) + "\n"


def folder_report(folder: str, found: DataFrame, trusted_from: float = 0.7) -> str:
    """A benchmark folder's score and its findings that matter most."""
    score = quality.benchmark_trust(found).first()["score"]
    worst = found.where(F.col("severity").isin("critical", "high")).orderBy("severity", "check_id", "path").collect()
    lines = [f"- [{r['severity']}] {r['check_id']}: {r['path'] or folder}" for r in worst]
    return "\n".join([f"`{folder}`: {score:.2f}, {'trusted' if score >= trusted_from else 'untrusted'}", *lines])


def taxonomy() -> str:
    """The exploit surfaces and the checks that find them."""
    by: dict[str, list[str]] = {}
    for check, surface in SURFACES.items():
        by.setdefault(surface, []).append(check)
    return table(["Surface", "Checks"], [[s, "`" + ", ".join(c) + "`"] for s, c in sorted(by.items())])


def surfaces(found: DataFrame) -> DataFrame:
    """Each exploit surface of the findings once, with its findings, in the order of its first check."""
    place = F.coalesce(*[F.when(F.col("check_id") == c, F.lit(k)) for k, c in enumerate(SURFACES)], F.lit(len(SURFACES)))
    return found.where("surface_id is not null").groupBy("surface_id").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).orderBy("first", "surface_id").drop("first")


def benchmark_intervals(counts: DataFrame, level: float = 0.95) -> DataFrame:
    """counts (model_id, pass_count, n_trials): pass rate and its Wilson interval."""
    ci = wilson(F.col("pass_count"), F.col("n_trials"), z=quantile_of_normal(level))
    rate = F.when(F.col("n_trials") > 0, F.col("pass_count") / F.col("n_trials")).otherwise(0.0)
    return counts.select("model_id", "pass_count", "n_trials", rate.alias("pass_rate"), ci["lo"].alias("ci_lower"), ci["hi"].alias("ci_upper"), F.lit(level).alias("ci_level"))


def benchmark_table(counts: DataFrame, level: float = 0.95) -> str:
    rows = benchmark_intervals(counts, level).orderBy("model_id").collect()
    return table(["Model", "Pass", "N", "Pass rate", f"Lower ({level:.0%})", f"Upper ({level:.0%})"], [[r["model_id"], r["pass_count"], r["n_trials"], *(f"{r[c]:.3f}" for c in ("pass_rate", "ci_lower", "ci_upper"))] for r in rows])


def redaction(rows: DataFrame, fields: list[str], version: str = "redact/v1", source: str = "unknown") -> dict:
    """What a redaction pass finds: records looked at, and fields that it changes."""
    changed = [F.count_if(T.redact(F.col(f)) != F.col(f)).alias(f) for f in fields]
    r = rows.agg(F.count(F.lit(1)).alias("_n"), *changed).first()
    return {"redaction_version": version, "evidence_source": source, "fields_redacted": fields, "patterns_applied": len(T.REDACTIONS), "n_records_scanned": r["_n"], "n_fields_modified": sum(r[f] for f in fields)}


# Bounds of the reading of a paired audit.
SIGNIFICANT, MARGINAL, MODERATE, HIGH, FIRST_CLASS = 0.05, 0.10, 0.15, 0.30, 0.15


def reading(p: Column, lottery_rate: Column, first_class_rate: Column) -> list[Column]:
    """How to read a paired audit, as columns: significance, lottery, channel; null where the rate is unknown."""
    known = lambda c, rest: F.when(c.isNotNull(), rest)
    return [
        known(p, F.when(p > MARGINAL, "not_significant").when(p < SIGNIFICANT, "significant").otherwise("marginal")).alias("significance"),
        known(lottery_rate, F.when(lottery_rate >= HIGH, "high").when(lottery_rate >= MODERATE, "moderate").otherwise("low")).alias("lottery"),
        known(first_class_rate, F.when(first_class_rate >= FIRST_CLASS, "alpha").otherwise("gamma")).alias("channel"),
    ]


def rates(spark: SparkSession, samples: str | None = None, channels: str | None = None) -> DataFrame:
    """One row: the lottery rate of a file of resampled answers, and the rates of a file of error channels; null without one."""
    fields = {samples: "n_tested long, lottery_count long, lottery_rate double", channels: "n_total long, n_wrong long, n_first_class long, first_class_rate_of_total double"}
    out = spark.range(1).select()
    for path, shape in fields.items():
        read = spark.read.text(path, wholetext=True).select(F.from_json("value", shape).alias("r")).select("r.*") if path else spark.range(1).select(*[F.lit(None).cast(x.split()[1]).alias(x.split()[0]) for x in shape.split(", ")])
        out = out.crossJoin(F.broadcast(read))  # a row each
    return out


def paired_audit(winner: DataFrame, baseline: DataFrame, other: DataFrame, n_iter: int = 10_000, seed: int = 42) -> DataFrame:
    """Two runs' results (id, correct) over the ids of both: counts, intervals, exact p, the resampled difference, and how to read them beside ``rates``."""
    both = winner.select("id", F.col("correct").alias("w")).join(baseline.select("id", F.col("correct").alias("b")), "id").withColumn("k", F.lit(0))
    found = metrics.discordance(both, F.col("w"), F.col("b"))
    drawn = paired_bootstrap(both, "k", "id", "w", "b", n_iter, seed).select((F.col("ci_lo") * 100).alias("delta_pp_lo"), (F.col("ci_hi") * 100).alias("delta_pp_hi"), "p_two_sided")
    row = found.where("n > 0").crossJoin(F.broadcast(drawn)).crossJoin(F.broadcast(other))  # a row each
    named = row.select(
        "n", F.col("n_a").alias("winner_correct"), F.col("n_b").alias("baseline_correct"), (F.col("delta") * 100).alias("delta_pp"), F.col("a_lo").alias("winner_lo"), F.col("a_hi").alias("winner_hi"), F.col("b_lo").alias("baseline_lo"), F.col("b_hi").alias("baseline_hi"),
        F.col("c").alias("baseline_only"), F.col("b").alias("winner_only"), "p", "delta_pp_lo", "delta_pp_hi", "p_two_sided", *other.columns,
    )
    return named.select("*", *reading(F.col("p"), F.col("lottery_rate"), F.col("first_class_rate_of_total")))


def card(name: str, totals: dict[str, int], date: str = "", template: str | None = None) -> str:
    """A card of a template with {name}, {date} and {totals}; a plain one without."""
    body = table(["part", "records"], [[k, v] for k, v in totals.items()])
    return (template or "# {name}\n\n{date}\n\n{totals}\n").replace("{name}", name).replace("{date}", date).replace("{totals}", body)


def unfilled(text: str) -> list[str]:
    """Placeholders left in a card."""
    import re

    return re.findall(r"\{[a-z_]+\}", text)


def evidence_totals(records: DataFrame) -> dict[str, int]:
    """Records, decisions and verifier results, as a card of evidence states them."""
    size = lambda c: F.sum(F.greatest(F.size(c), F.lit(0)))
    r = records.agg(F.count(F.lit(1)).alias("records"), size("capability_decisions").alias("policy_decisions"), size("verifier_results").alias("verifier_results")).first()
    return {k: int(v or 0) for k, v in r.asDict().items()}
