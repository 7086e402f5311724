"""Checks of benchmark folders, from a listing (path, mode) and the texts of its scripts."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# File names that give an answer or a grader away.
GOLD = ("answer.txt", "gold.txt", "gold_answer.txt", "expected_output.txt", "solution.txt", "correct.txt", "expected.txt", "answer.json", "gold.json")
GRADERS = ("grade.py", "grader.py", "grader.sh", "eval.py", "evaluator.py", "score.py", "check.py", "checker.py", "verify.py", "run_eval.sh")
ANSWERS = ("ANSWER=", "SOLUTION=", "GOLD=", "EXPECTED=")
# Check -> exploit surface.
SURFACES = {"gold-answer-readable": "S1", "test-script-writable": "S2", "env-file-present": "S3", "env-answer-in-script": "S3", "grader-writable": "S4", "git-dir-present": "S5", "no-task-manifest": "S6"}


def listing(spark: SparkSession, root: str) -> DataFrame:
    """One row a file or .git folder of a local task folder: path, name, depth, readable, writable, text of scripts."""
    rows = []
    for folder, dirs, files in os.walk(root):
        for name in [*files, *(d for d in dirs if d == ".git")]:
            full = os.path.join(folder, name)
            path = os.path.relpath(full, root)
            text = open(full, errors="replace").read() if name.endswith(".sh") and os.path.isfile(full) else None
            rows.append((path, name, path.count(os.sep), os.path.isdir(full), os.access(full, os.R_OK), os.access(full, os.W_OK), text))
        dirs[:] = [d for d in dirs if d != ".git"]
    return spark.createDataFrame(rows, "path string, name string, depth int, is_dir boolean, readable boolean, writable boolean, text string")


def findings(files: DataFrame) -> DataFrame:
    """check_id, severity, surface_id and path."""
    low, file = F.lower("name"), ~F.col("is_dir")
    said = F.lit(False)
    for a in ANSWERS:
        said = said | F.contains(F.coalesce("text", F.lit("")), F.lit(a))
    rules: list[tuple[str, str, Column]] = [
        ("gold-answer-readable", "critical", file & low.isin(*GOLD) & F.col("readable")),
        ("test-script-writable", "high", file & F.col("name").endswith(".py") & F.contains(low, F.lit("test")) & F.col("writable")),
        ("env-file-present", "high", file & (F.col("depth") == 0) & F.col("name").startswith(".env")),
        ("env-answer-in-script", "medium", file & said),
        ("grader-writable", "critical", file & low.isin(*GRADERS) & F.col("writable")),
        ("git-dir-present", "high", F.col("is_dir") & (F.col("path") == ".git")),
    ]
    made = [F.when(rule, F.struct(F.lit(c).alias("check_id"), F.lit(s).alias("severity"))) for c, s, rule in rules]
    found = files.select("path", F.explode(F.array_compact(F.array(*made))).alias("f")).select("f.*", "path")
    has = files.agg(F.count_if((F.col("depth") == 0) & F.col("name").isin("task.json", "task.yaml", "task.yml")).alias("n")).where("n = 0")
    found = found.unionByName(has.select(F.lit("no-task-manifest").alias("check_id"), F.lit("info").alias("severity"), F.lit(None).cast("string").alias("path")))
    surface = F.coalesce(*[F.when(F.col("check_id") == k, F.lit(v)) for k, v in SURFACES.items()])
    return found.withColumn("surface_id", surface)


def control_characters(files: DataFrame) -> DataFrame:
    """Files (path, content) with control bytes other than tab, line feed and carriage return."""
    return files.where(F.decode("content", "ISO-8859-1").rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")).select("path")


def locked(lock: DataFrame, files: DataFrame) -> DataFrame:
    """lock (path, sha256) against files (path, content): OK, DRIFT or MISSING."""
    actual = files.select("path", F.sha2("content", 256).alias("actual"))
    return lock.join(actual, "path", "left").select("path", F.when(F.col("actual").isNull(), "MISSING").when(F.col("actual") == F.col("sha256"), "OK").otherwise("DRIFT").alias("status"))


def schema_drift(required: DataFrame, fields: DataFrame) -> DataFrame:
    """Per schema: required names that the model lacks, and names beyond them."""
    both = required.join(fields, "schema")
    return both.select("schema", F.array_except("required", "fields").alias("missing"), F.array_except("fields", "required").alias("extra"), (F.size(F.array_except("required", "fields")) == 0).alias("ok"))
