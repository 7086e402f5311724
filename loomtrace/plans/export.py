"""The export: rollouts and compliance runs to training files, with checks and a manifest."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace import schemas
from loomtrace.operators import contamination, datasets, quality, training
from loomtrace.sources import jsonl


def parts(rollouts: DataFrame | None, compliance: DataFrame | None, only_passing: bool = True) -> dict[str, DataFrame]:
    """The training tables that the inputs give; nothing is read yet."""
    out = {}
    if rollouts is not None:
        out |= {"sft": training.sft(rollouts, only_passing), "dpo": training.dpo(rollouts), "ppo": training.ppo(rollouts)}
    if compliance is not None:
        out |= {"compliance_sft": training.compliance_sft(compliance, not only_passing), "compliance_dpo": training.compliance_dpo(compliance), "cross_mode_dpo": training.cross_mode_dpo(compliance, "seq")}
    return out


def run(spark: SparkSession, out_dir: str, rollout_path: str | None = None, compliance_path: str | None = None, eval_texts: DataFrame | None = None, threshold: float = 0.2, only_passing: bool = True) -> dict:
    """Write every non-empty table as JSON lines under ``out_dir``; the manifest has counts and checks."""
    rollouts = jsonl.rollouts(spark, rollout_path) if rollout_path else None
    compliance = jsonl.read(spark, compliance_path, schemas.COMPLIANCE) if compliance_path else None
    counts: dict[str, int] = {}
    checks: dict[str, list] = {}
    for name, rows in parts(rollouts, compliance, only_passing).items():
        if not rows.isEmpty():
            jsonl.write(rows, f"{out_dir}/{name}")
            rows = spark.read.schema(rows.schema).json(f"{out_dir}/{name}")
        counts[f"n_{name}"] = rows.count()
        if "messages" in rows.columns:
            checks[f"{name}_invalid"] = [quality.validate_rows(rows).where(F.size("errors") > 0).count()]
        if name == "dpo":
            checks["dpo_quality"] = [r.asDict() for r in quality.check_dpo(rows).collect()]
        if name == "sft":
            checks["sft_quality"] = [r.asDict() for r in quality.check_sft(rows).collect()]
            if eval_texts is not None:
                texts = rows.select(F.concat_ws("/", "rollout_id", "branch_index").alias("id"), F.element_at("messages", -1)["content"].alias("text"))
                checks["contaminated"] = [r.asDict() for r in contamination.check(texts, eval_texts, "id", "item_id", threshold).collect()]
    manifest = counts | {"checks": checks}
    card = datasets.card("training export", counts)
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out_dir}/manifest")
    spark.createDataFrame([(card,)], "value string").coalesce(1).write.mode("overwrite").text(f"{out_dir}/card")
    return manifest
