"""Command line: ``python -m loomtrace COMMAND ...``; every command is a few calls of the library."""

from __future__ import annotations

import argparse
import importlib
import json
import sys
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loomtrace import schemas
from loomtrace.functions import scrub, stats, text
from loomtrace.operators import capability, contamination, datasets, ingestion, lineage, lint, metrics, quality, registry, replay, reports, router, synthesis, training, trust
from loomtrace.plans import export
from loomtrace.sources import importers, jsonl
from loomtrace.shared import shared_dir
from loomtrace.streaming import compliance, service


def _show(rows) -> None:
    for r in rows.toJSON().toLocalIterator():
        print(r)


def _save(rows, out: str | None) -> None:
    jsonl.write(rows, out) if out else _show(rows)


def main(argv: list[str] | None = None) -> int:
    ap = argparse.ArgumentParser(prog="loomtrace", description=__doc__)
    sub = ap.add_subparsers(dest="command", required=True)

    def add(name: str, *flags: str, **typed) -> argparse.ArgumentParser:
        p = sub.add_parser(name)
        for f in flags:
            p.add_argument(f"--{f.rstrip('!')}", required=f.endswith("!"))
        for k, v in typed.items():
            p.add_argument(f"--{k.replace('_', '-')}", type=type(v), default=v)
        return p

    add("export", "rollout", "compliance", "out-dir!", "eval-items", contamination_threshold=0.2).add_argument("--include-failing", action="store_true")
    for name in ("adp-export", "mine-gaps"):
        add(name, "rollout!", "out")
    add("rl-export", "rollout!", "out", reward="build,policy,cost")
    add("compile-context", "rollout!", "out", mode="long_context_qa", min_tool_calls=1)
    add("router", "input!", "out", max_repair_rounds=3, max_violations=3, min_tool_validity=0.8, max_latency_ms=30_000.0, hard_constraint_limit=10)
    add("validate", "input!", "out", "eval-items", contamination_threshold=0.2).add_argument("--strict", action="store_true")
    add("validate-aep", "input!", fail_under=0.0)
    p = add("stream-eval", "input!", "out", "checkpoint", "verifier", max_hard_per_subject=3, fail_under=0.0, fail_under_sla=0.0, evidence_completeness_threshold=1.0, sla_ms=1000.0, most_files=100)
    p.add_argument("--require-signature", action="store_true")
    p.add_argument("--no-admission", action="store_true")
    add("trust-score", "aep!", "output")
    add("replay", "aep!", "output", "debug-action")
    add("audit-report", "aep", "task-dir", "receipt", "out", title="Audit report", date="")
    add("registry-register", "root!", "id!", "type", "version", "path", "digest")
    add("synthesize", "specs!", "chat!", "out", n_good=5, n_bad=5, seed=42)
    add("conformal", "input!", key="model_id", error="error", alpha=0.1)
    add("audit", "winner!", "baseline!", "samples", "channels", "out")
    add("lint-benchmark", "task-dir!", fail_under=0.0)
    add("receipt", "run-id!", "input!", "output!", "model", "operator", "save")
    add("registry-list", "log!", "type")
    add("scrub", "input!", "out")
    add("paired", "a!", "b!")
    add("truncation", "input!", max_new_tokens=768)
    for kind in importers.FORMATS:
        add(f"import-{kind}", "input!", "output", format="evidence")
    a = ap.parse_args(argv)
    spark = SparkSession.builder.appName("loomtrace").getOrCreate()
    return run(spark, a)


def run(spark: SparkSession, a: argparse.Namespace) -> int:
    name = a.command
    evidence = lambda path: jsonl.read(spark, path, schemas.AEP, strict=False)
    if name == "export":
        print(json.dumps(export.run(spark, a.out_dir, a.rollout, a.compliance, items_of(spark, a), a.contamination_threshold, not a.include_failing), default=str))
    elif name in ("adp-export", "rl-export", "mine-gaps"):
        make = {"adp-export": training.episode_steps, "rl-export": lambda r: training.transitions(r, tuple(a.reward.split(","))), "mine-gaps": capability.gaps}[name]
        _save(make(jsonl.rollouts(spark, a.rollout)), a.out)
    elif name == "compile-context":
        make = training.context_qa if a.mode == "long_context_qa" else training.router_critic
        _save(make(jsonl.rollouts(spark, a.rollout), a.min_tool_calls), a.out)
    elif name == "router":
        rows = jsonl.read(spark, a.input, ", ".join(f"{f} double" for f in schemas.FEATURES) + ", task_id string")
        limits = router.Limits(a.max_repair_rounds, a.max_violations, a.min_tool_validity, a.max_latency_ms, a.hard_constraint_limit)
        rows = rows.withColumns({f: F.col(f).cast("long") for f in ("eval_repair_rounds", "eval_violation_count", "taskspec_n_hard")})
        _save(rows.select("task_id", router.decide(limits).alias("d")).select("task_id", "d.*"), a.out)
    elif name == "validate":
        rows = jsonl.read(spark, a.input, f"messages array<{schemas.MESSAGE}>, chosen string, rejected string, reward double", strict=False)
        checked = quality.validate_rows(rows).where(F.size("errors") > 0)
        _save(checked, a.out)
        if (items := items_of(spark, a)) is not None:
            said = F.coalesce(F.try_element_at("messages", F.lit(-1))["content"], "chosen", F.lit(""))
            _show(contamination.check(rows.select("seq", said.alias("text")), items, "seq", "item_id", a.contamination_threshold))
        return int(a.strict and not checked.isEmpty())
    elif name == "stream-eval":
        return stream_eval(spark, a)
    elif name == "validate-aep":
        rows = compliance.batch(compliance.checks(evidence(a.input), "seq"), 1 << 30)
        _show(rows)
        total = compliance.stats(rows).first()
        print(json.dumps(total.asDict()))
        return int(bool(total["n"]) and total["n_pass"] / total["n"] < a.fail_under)
    elif name == "trust-score":
        _save(trust.trust(evidence(a.aep)), a.output)
    elif name == "replay":
        _save(replay.replay(evidence(a.aep), stop_at=a.debug_action, stop_at_mismatch=a.debug_action is not None), a.output)
    elif name == "audit-report":
        records = evidence(a.aep) if a.aep else None
        found = {a.task_dir: lint.findings(lint.listing(spark, a.task_dir))} if a.task_dir else None
        receipts = [registry.load_json(spark, a.receipt)] if a.receipt else None
        made = reports.audit(a.title, a.date, ingestion.validated(records) if records is not None else None, records, found, receipts)
        print(made)
        if a.out:
            spark.createDataFrame([(made,)], "value string").coalesce(1).write.mode("overwrite").text(a.out)
    elif name == "registry-register":
        registry.Registry(spark, a.root).register(**{k: v for k in ("id", "type", "version", "path", "digest") if (v := getattr(a, k))})
    elif name == "synthesize":
        module, _, function = a.chat.partition(":")
        _save(synthesis.generate(synthesis.load(spark, a.specs), getattr(importlib.import_module(module), function), a.n_good, a.n_bad, a.seed), a.out)
    elif name == "conformal":
        _show(stats.conformal(jsonl.read(spark, a.input, f"{a.key} string, {a.error} double"), a.key, a.error, a.alpha))
    elif name == "audit":
        results = lambda path: jsonl.results(spark, path)
        _save(reports.paired_audit(results(a.winner), results(a.baseline), reports.rates(spark, a.samples, a.channels)), a.out)
    elif name == "lint-benchmark":
        found = lint.findings(lint.listing(spark, a.task_dir))
        _show(found)
        score = quality.benchmark_trust(found).first()["score"]
        print(json.dumps({"score": score}))
        return int(score < a.fail_under)
    elif name == "receipt":
        sums = {r["path"]: r["d"] for p in (a.input, a.output) for r in spark.read.format("binaryFile").load(p).select("path", F.sha2("content", 256).alias("d")).collect()}
        made = json.dumps(datasets.receipt(a.run_id, sums, {}, [a.model] if a.model else [], a.operator or ""))
        print(made)
        if a.save:
            spark.createDataFrame([(made,)], "value string").coalesce(1).write.mode("overwrite").text(a.save)
    elif name == "registry-list":
        rows = lineage.current(jsonl.read(spark, a.log, "id string, event string, type string, version string, digest string"))
        _show(rows if a.type is None else rows.where(F.col("type") == a.type))
    elif name == "scrub":
        _save(jsonl.lines(spark, a.input).select(scrub.json_text(F.col("value")).alias("value")), a.out)
    elif name == "paired":
        x, y = jsonl.correctness(spark, a.a), jsonl.correctness(spark, a.b)
        n = x.count()
        if n != y.count() or x.join(y, "position").count() != n:
            print("[error] the files' lines don't pair up", file=sys.stderr)
            return 1
        _show(metrics.paired(x, y, "position"))
        both = x.withColumnRenamed("correct", "a").join(y.withColumnRenamed("correct", "b"), "position").withColumn("k", F.lit("a-b"))
        _show(stats.paired_bootstrap(both, "k", "position", "a", "b"))
    elif name == "truncation":
        rows = jsonl.read(spark, a.input, "id string, correct boolean, gen_text string")
        _show(rows.where(~F.col("correct")).agg(F.count(F.lit(1)).alias("n_wrong"), F.count_if(text.truncated(F.coalesce("gen_text", F.lit("")), a.max_new_tokens)).alias("A_truncated")))
    elif name.startswith("import-"):
        _save(importers.load(spark, name.removeprefix("import-"), a.input, a.format), a.output)
    return 0


def items_of(spark: SparkSession, a: argparse.Namespace):
    """The evaluation items of --eval-items, or None."""
    if not a.eval_items:
        return None
    return jsonl.read(spark, a.eval_items, "item_id string, text string, task string").select("item_id", F.coalesce("text", "task").alias("text"))


def stream_eval(spark: SparkSession, a: argparse.Namespace) -> int:
    """Evaluate what a file or folder has; with the same --out and --checkpoint again, what came since."""
    root = (a.out or f"{shared_dir(spark).rstrip('/')}/stream-eval-{uuid.uuid4().hex}").rstrip("/")
    signature = None
    if a.require_signature:
        if not a.verifier:
            print("[error] --require-signature needs --verifier module:function", file=sys.stderr)
            return 2
        module, _, function = a.verifier.partition(":")
        signature = ingestion.signatures(F.col("value"), getattr(importlib.import_module(module), function))
    records = service.source(spark, a.input, a.most_files)
    q = service.evaluate(records, root, a.checkpoint or f"{root}/_checkpoint", a.max_hard_per_subject, a.evidence_completeness_threshold, signature, not a.no_admission, a.sla_ms)
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    try:
        total = service.stats(spark, root).first()
    except FileNotFoundError:  # no record has come yet
        return 0
    _show(spark.read.parquet(f"{root}/feedback").orderBy("batch", "seq"))
    print(json.dumps(total.asDict()))
    return int(total["n"] > 0 and (total["n_pass"] / total["n"] < a.fail_under or total["within_sla"] < a.fail_under_sla))


if __name__ == "__main__":
    sys.exit(main())
