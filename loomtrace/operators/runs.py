"""Raw benchmark runs: loading with seeds, summaries, evaluation records, and training of routers.

Training is boosted trees over stratified folds (``boosting``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomtrace import schemas
from loomtrace.operators import boosting
from loomtrace.schemas import LABELS
from loomtrace.sources import jsonl

RUN = schemas.COMPLIANCE.replace("\n", " ") + ", token_cost string"
#: Features of a direct run, in their order in a vector.
FEATURES = (
    "taskspec_has_tools", "taskspec_n_allowed_tools", "n_violations", "n_hard_violations", "n_soft_violations", "n_format_violations", "n_content_violations",
    "repair_rounds", "n_repair_ok", "n_repair_fail", "latency_ms", "prompt_tokens", "generation_tokens", "token_ratio", "model_is_qwen",
)
#: Those known before a run.
STATIC = ("taskspec_n_constraints", "taskspec_n_hard", "taskspec_has_tools", "taskspec_n_allowed_tools", "taskspec_max_repair_rounds")


def load(spark: SparkSession, folders: dict[str, int | None], root: str) -> DataFrame:
    """Runs of the folders that exist, with ``subdir`` and ``seed``."""
    out = None
    for folder, seed in folders.items():
        path = f"{root.rstrip('/')}/{folder}/runs.jsonl"
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            rows = jsonl.read(spark, path, RUN).withColumns({"subdir": F.lit(folder), "seed": F.lit(seed).cast("int")})
            out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], f"seq long, file string, {RUN}, subdir string, seed int")


def first_lines(runs: DataFrame, most: int) -> DataFrame:
    """The first ``most`` runs of each folder; each task keeps no more than that of its own."""
    place = F.row_number().over(W.partitionBy("subdir").orderBy("seq"))
    return runs.withColumn("_place", place).where(F.col("_place") <= most).drop("_place")


def summary(runs: DataFrame) -> DataFrame:
    """Runs, passes and repaired ones by mode and model; roll-ups have nulls."""
    n = F.count(F.lit(1))
    return runs.rollup("mode", "model").agg(n.alias("n"), F.count_if("final_pass").alias("n_pass"), (F.count_if("final_pass") / n).alias("pass_rate"), F.count_if(F.col("repair_rounds") > 0).alias("n_repaired"))


def _tokens(part: str) -> Column:
    """A part of a token cost that is an object, or a plain number of prompt tokens."""
    cost = F.col("token_cost")
    plain = cost.try_cast("double")
    of_object = F.get_json_object(cost, f"$.{part}").try_cast("double")
    return F.coalesce(of_object, plain if part == "prompt" else F.lit(None).cast("double"), F.lit(0.0))


def evaluation(runs: DataFrame, group: Column) -> DataFrame:
    """Runs as evaluation records; all rounds of a passing run count as successful."""
    rounds = F.coalesce("repair_rounds", F.greatest(F.size("repair_trace"), F.lit(0)))
    passed = F.coalesce("final_pass", F.lit(False))
    zero = F.lit(0).cast("long")
    return runs.select(
        "task_id", group.alias("group"), passed.alias("final_pass"), zero.alias("tool_calls_total"), zero.alias("tool_calls_valid"), rounds.cast("long").alias("repair_rounds"), F.when(passed, rounds).otherwise(0).cast("long").alias("repair_rounds_ok"),
        F.lit(True).alias("has_evidence"), F.lit(False).alias("escalated"), _tokens("prompt").cast("long").alias("prompt_tokens"), _tokens("generation").cast("long").alias("generation_tokens"), zero.alias("repair_tokens"),
        F.coalesce("latency_ms", F.lit(0.0)).alias("latency_ms"), F.lit(None).cast("double").alias("general_score"),
    )


def held_out(tasks: DataFrame, n: int = 10) -> DataFrame:
    """The last n task ids by the number after their last point."""
    number = F.regexp_extract("task_id", r"([0-9]+)$", 1).cast("long")
    return tasks.select("task_id").distinct().orderBy(number.desc(), F.desc("task_id")).limit(n)


def features(prefix: str = "direct.") -> dict[str, Column]:
    c = lambda name: F.col(prefix + name)
    count = lambda rows, test: F.greatest(F.size(F.filter(rows, test)), F.lit(0)).cast("double")
    violations, trace = c("violations"), c("repair_trace")
    n, hard = count(violations, lambda v: F.lit(True)), count(violations, lambda v: v["level"] == "hard")
    ok = count(trace, lambda e: F.coalesce(e["ok"], F.lit(False)))
    part = lambda name: F.coalesce(F.get_json_object(c("token_cost"), f"$.{name}").try_cast("double"), F.lit(0.0))
    zero = F.lit(0.0)
    values = [
        zero, zero, n, hard, n - hard, count(violations, lambda v: v["category"] == "format"), count(violations, lambda v: v["category"] == "content"), F.coalesce(c("repair_rounds"), F.lit(0)).cast("double"), ok,
        count(trace, lambda e: F.lit(True)) - ok, F.coalesce(c("latency_ms"), zero), part("prompt"), part("generation"), part("generation") / (part("prompt") + 1), F.contains(F.lower(F.coalesce(c("model"), F.lit(""))), F.lit("qwen")).cast("double"),
    ]
    return dict(zip(FEATURES, values, strict=True))


def samples(runs: DataFrame) -> DataFrame:
    """Tasks with a direct and a full run (the last of each): features of the direct one, and a label from both."""
    cols = [c for c in runs.columns if c not in ("seq", "file", "task_id", "subdir")]
    last = lambda mode: F.max_by(F.when(F.col("mode") == mode, F.struct(*cols)), F.when(F.col("mode") == mode, F.col("seq")))
    rows = runs.groupBy("task_id", "model", "subdir").agg(last("direct").alias("direct"), last("full_pcl").alias("full")).where("direct is not null and full is not null")
    passed = lambda c: F.coalesce(F.col(f"{c}.final_pass"), F.lit(False))
    label = F.when(passed("direct"), LABELS[0]).when(passed("full"), LABELS[1]).otherwise(LABELS[2])
    return rows.select("task_id", F.col("model"), "subdir", *[v.alias(k) for k, v in features().items()], label.alias("label"), passed("direct").alias("direct_pass"), passed("full").alias("full_pass"))


def router_records(rows: DataFrame, source: str = "runs") -> DataFrame:
    """Samples as router records: the fifteen features of a router, the label and where it comes from."""
    n, hard, zero = F.col("n_violations").cast("long"), F.col("n_hard_violations").cast("long"), F.lit(0).cast("long")
    values = [
        n, hard, F.col("taskspec_has_tools").cast("long"), F.col("taskspec_n_allowed_tools").cast("long"), F.lit(3).cast("long"), F.col("repair_rounds").cast("long"), n, hard, zero, zero, F.lit(1.0), zero, F.col("latency_ms"),
        F.col("prompt_tokens").cast("long"), F.col("generation_tokens").cast("long"),
    ]
    return rows.select(F.concat_ws("@", "task_id", "subdir").alias("task_id"), F.struct(*[v.alias(k) for k, v in zip(schemas.FEATURES, values, strict=True)]).alias("features"), "label", F.struct(F.lit(source).alias("source"), F.col("task_id"), F.substring(F.sha2("task_id", 256), 1, 16).alias("task_hash")).alias("provenance"))


def load_router_records(spark: SparkSession, path: str) -> DataFrame:
    fields = ",".join(f"{f}:{'double' if f in ('eval_tool_validity_rate', 'eval_latency_ms') else 'bigint'}" for f in schemas.FEATURES)
    return jsonl.read(spark, path, f"task_id string, features struct<{fields}>, label string, provenance struct<source:string,task_id:string,task_hash:string>")


def static_features(records: DataFrame) -> DataFrame:
    """What is known of a router record before a run, as columns, beside its task and label."""
    return records.select("task_id", "label", *[F.coalesce(F.col(f"features.{c}").cast("double"), F.lit(0.0)).alias(c) for c in STATIC])


def train(rows: DataFrame, columns: tuple[str, ...] = FEATURES, folds: int = 5, settings: boosting.Settings = boosting.Settings()) -> dict:
    """Cross-validated scores of boosted trees over ``columns``, and the importances of the model of all rows."""
    return boosting.cross_validated(rows, list(columns), folds=folds, settings=settings)
