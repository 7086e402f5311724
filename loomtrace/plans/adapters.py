"""Views of the driver's tables in the shapes that the operators take.

The flat part of each view is SQL that Spark and DuckDB both read, so a query and its oracle start
from the same rows; nested parts are built from the flat ones in Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace import schemas

TOOLS = ("read_file", "run_test", "plan_step", "search_docs", "shell")

#: Branches of rollouts: an order's lines in a fixed order.
BRANCHES = """
SELECT CAST(l_orderkey AS STRING) AS rollout_id,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS INT) AS branch_index,
  concat('task ', CAST(l_orderkey AS STRING)) AS task, concat('answer ', CAST(l_partkey AS STRING)) AS final_answer,
  CASE l_returnflag WHEN 'A' THEN 1 ELSE 0 END AS objective_score,
  CASE l_returnflag WHEN 'A' THEN 'pass' WHEN 'R' THEN 'fail' ELSE 'unknown' END AS objective_status,
  l_extendedprice AS total_score, CAST(l_quantity AS INT) % 4 AS n_calls, l_partkey AS p, l_suppkey AS s, l_linenumber AS ln
FROM lineitem"""

#: Compliance runs: three modes of a task and model.
RUNS = """
SELECT CAST(l_orderkey AS STRING) AS task_id, l_linestatus AS model,
  CASE l_returnflag WHEN 'A' THEN 'direct' WHEN 'R' THEN 'prompt_retry' ELSE 'full_pcl' END AS mode,
  l_discount > 0.05 AS final_pass, concat('artifact ', CAST(l_partkey AS STRING)) AS artifact, l_linenumber % 3 AS repair_rounds,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS seq
FROM lineitem"""

#: Evaluation records of five groups.
EVALS = """
SELECT CAST(o_custkey AS STRING) AS task_id, substr(o_orderpriority, 1, 1) AS "group", o_orderkey AS seq, o_orderstatus = 'F' AS final_pass,
  o_orderkey % 7 AS tool_calls_total, o_orderkey % 7 - CASE WHEN o_orderkey % 11 = 0 AND o_orderkey % 7 > 0 THEN 1 ELSE 0 END AS tool_calls_valid,
  o_custkey % 5 AS repair_rounds, CASE WHEN o_custkey % 5 > 0 THEN o_custkey % 5 - 1 ELSE 0 END AS repair_rounds_ok,
  o_orderkey % 9 <> 0 AS has_evidence, o_orderkey % 13 = 0 AS escalated, o_orderkey % 100 AS prompt_tokens, o_custkey % 50 AS generation_tokens,
  o_orderkey % 3 AS repair_tokens, o_totalprice / 10 AS latency_ms, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey % 10 AS DOUBLE) / 10 END AS general_score
FROM orders"""

#: Task specs: a dimension table.
SPECS = "SELECT CAST(p_partkey AS STRING) AS task_id, p_size % 14 AS n_constraints, p_size % 13 AS n_hard, p_size % 4 AS n_allowed_tools, p_size % 5 AS max_repair_rounds FROM part"

#: Actions of evidence records, one a line of an order.
ACTIONS = """
SELECT l_orderkey AS run, l_linestatus = 'F' AS state_changing, l_tax > 0.02 AS has_digest, l_tax > 0.05 AS has_refs, l_discount > 0.08 AS denied, l_quantity > 12 AS passed, l_suppkey % 6 AS verifier
FROM lineitem"""


def views(spark: SparkSession, sf_dir: str, *tables: str) -> None:
    for t in tables:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def _sql(spark: SparkSession, text: str) -> DataFrame:
    return spark.sql(text.replace('"group"', "`group`"))


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "lineitem")
    names = F.array(*[F.lit(t) for t in TOOLS])

    def call(i):
        fails = (F.col("ln") + i) % 7 == 0
        return F.struct(
            F.element_at(names, ((F.col("p") + i) % 5 + 1).cast("int")).alias("tool_name"),
            F.when((F.col("s") + i) % 3 == 0, F.lit("{}")).otherwise(F.concat(F.lit('{"n": '), i.cast("string"), F.lit("}"))).alias("arguments"),
            F.when(~fails, F.concat(F.lit("r"), (F.col("p") + i).cast("string"))).alias("result"),
            F.when(fails, F.lit("Error: no result")).alias("error"),
        )

    none = F.expr(f"cast(array() as array<{schemas.CALL}>)")
    tools = F.when(F.col("n_calls") > 0, F.transform(F.sequence(F.lit(0), F.col("n_calls") - 1), call)).otherwise(none)
    signed = F.expr("cast(null as array<struct<evidence_source:string,signer:struct<key_id:string>>>)")
    return _sql(spark, BRANCHES).withColumn("tools", tools).withColumn("verifier_results", signed)


def compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "lineitem")
    none = F.expr(f"cast(array() as array<{schemas.VIOLATION}>)")
    broken = F.array(F.struct(F.lit("c1").alias("constraint_id"), F.lit("hard").alias("level"), F.lit("format").alias("category"), F.lit("add a title").alias("hint")))
    return _sql(spark, RUNS).withColumn("violations", F.when(F.col("repair_rounds") > 0, broken).otherwise(none)).withColumn("task_spec_hash", F.sha2("task_id", 256))


def evaluations(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "orders")
    return _sql(spark, EVALS)


def specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir, "part")
    return spark.sql(SPECS)


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence records: orders with their lines as actions, decisions and verifier results."""
    views(spark, sf_dir, "orders", "lineitem")
    a = spark.sql(ACTIONS)
    null = F.lit(None).cast("string")
    act = F.struct(F.col("state_changing"), F.when(F.col("has_digest"), F.lit("d")).alias("result_digest"), null.alias("precondition_digest"), F.when(F.col("has_refs"), F.array(F.lit("e"))).alias("evidence_refs"), null.alias("pre_state_digest"), null.alias("post_state_digest"), null.alias("action_id"))
    decided = F.struct(F.when(F.col("denied"), "deny").otherwise("allow").alias("decision"))
    checked = F.struct(F.concat(F.lit("v"), F.col("verifier").cast("string")).alias("verifier_id"), F.col("passed"), F.when(F.col("verifier") != 1, F.col("passed").cast("double")).alias("score"), F.when(F.col("has_refs"), F.array(F.lit("c"))).alias("claim_ids"))
    lines = a.groupBy("run").agg(F.collect_list(act).alias("actions"), F.collect_list(decided).alias("capability_decisions"), F.collect_list(checked).alias("verifier_results"))
    o = F.col("o_orderkey")
    limited = lambda limit, spent: F.struct(limit.cast("double").alias("limit"), spent.cast("double").alias("spent"))
    empty = lambda c, kind: F.coalesce(c, F.expr(f"cast(array() as array<{kind}>)"))
    kinds = {c: lines.schema[c].dataType.elementType.simpleString() for c in lines.columns if c != "run"}
    rows = spark.table("orders").join(lines, o == F.col("run"), "left")
    return rows.select(
        o.cast("string").alias("run_id"),
        F.lit("aep/v0.3").alias("schema_version"),
        F.col("o_custkey").alias("subject_id"),
        o.alias("seq"),
        F.when(o % 5 != 0, F.lit("m")).alias("model_id"),
        F.when(o % 3 != 0, F.lit("c")).alias("repo_commit"),
        F.when(o % 4 != 0, F.lit("t")).alias("tool_manifest_digest"),
        F.when(o % 6 == 0, F.lit("full")).when(o % 6 == 1, F.lit("delta")).alias("recording_mode"),
        F.lit(0.0).alias("created_at_ms"),
        F.struct(limited(F.when(o % 2 == 0, F.lit(100)), o % 150).alias("token_budget"), limited(F.lit(3), o % 5).alias("retry_budget"), limited(F.lit(None), F.lit(1)).alias("tool_budget")).alias("budget_ledger"),
        *[empty(F.col(c), kinds[c]).alias(c) for c in ("actions", "capability_decisions", "verifier_results")],
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id and its messages in turn order."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return c.groupBy("conv_id").agg(turns.alias("t")).select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def replayable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose actions carry ids that recur, results, and for denied ones a state that was never reached."""
    views(spark, sf_dir, "orders", "lineitem")
    a = spark.sql(ACTIONS)
    act = F.struct(
        F.concat(F.lit("a"), F.col("verifier").cast("string")).alias("action_id"), F.lit("t").alias("tool_name"), F.col("state_changing"), F.when(F.col("has_digest"), F.lit("d")).alias("result_digest"),
        F.when(F.col("denied"), F.lit("never reached")).alias("pre_state_digest"), F.when(F.col("has_refs"), F.lit("s")).alias("post_state_digest"),
    )
    runs = a.groupBy("run").agg(F.collect_list(act).alias("actions"))
    return spark.table("orders").join(runs, F.col("o_orderkey") == F.col("run"), "left").select(F.col("o_orderkey").cast("string").alias("run_id"), "actions")
