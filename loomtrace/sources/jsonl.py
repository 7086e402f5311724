"""JSON-lines readers and writers with declared schemas.

``#`` and blank lines are skipped. Strict readers fail on a bad line, lenient ones return it as an error
row. ``seq`` orders rows by file and position where an operator needs first or last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtrace import schemas
from loomtrace.functions.text import answer


def lines(spark: SparkSession, paths: str | list[str], stream: bool = False) -> DataFrame:
    """value, file and, in batch, seq: increasing within a file, as one task reads a split in order."""
    raw = (spark.readStream.text(paths if isinstance(paths, str) else paths[0]) if stream else spark.read.text(paths)).select(F.trim("value").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    rows = raw.where((F.col("value") != "") & ~F.col("value").startswith("#"))
    return rows.drop("block") if stream else rows.withColumn("seq", F.monotonically_increasing_id())


def parsed(rows: DataFrame, schema: str, strict: bool = True) -> DataFrame:
    """The record's fields beside ``seq`` and ``file``; lenient: a bad line has ``error``."""
    schema = schema.replace("\n", " ")
    keep = [c for c in ("seq", "file", "block") if c in rows.columns]
    # guarded here too, as the optimiser may parse before the filter of comments
    text = F.when((F.col("value") != "") & ~F.col("value").startswith("#"), F.col("value"))
    if strict:
        return rows.select(*keep, F.from_json(text, schema, {"mode": "FAILFAST"}).alias("r")).select(*keep, "r.*")
    got = rows.select(*keep, "value", F.from_json(text, f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    error = F.when(F.col("r._bad").isNotNull(), F.concat(F.lit("JSON parse error: "), F.substring("value", 1, 80)))
    return got.select(*keep, "r.*", error.alias("error")).drop("_bad")


def read(spark: SparkSession, paths: str | list[str], schema: str, strict: bool = True) -> DataFrame:
    return parsed(lines(spark, paths), schema, strict)


def has_key(value: Column, key: str) -> Column:
    """Whether a JSON object text has the key, even with a null value."""
    return F.coalesce(F.array_contains(F.json_object_keys(value), key), F.lit(False))


def rollouts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Rollout branches; rows that describe a tree (fork_map without branch_index) are skipped.

    The raw tool sequence may be typed calls or call/result events; both become ``tools``.
    """
    from loomtrace.operators.training import pair_events

    raw = lines(spark, paths)
    raw = raw.where(~(has_key(F.col("value"), "fork_map") & ~has_key(F.col("value"), "branch_index")))
    events = "array<struct<event:string,data:struct<toolName:string,args:string,callId:string,output:string,error:string>,tool_name:string,arguments:string,result:string,error:string>>"
    schema = schemas.ROLLOUT.replace(f"tools array<{schemas.CALL}>", f"tool_call_sequence {events}")
    rows = parsed(raw, schema)
    seq = F.col("tool_call_sequence")
    typed = F.transform(seq, lambda e: F.struct(e["tool_name"].alias("tool_name"), F.coalesce(e["arguments"], F.lit("{}")).alias("arguments"), e["result"].alias("result"), e["error"].alias("error")))
    flat = F.transform(seq, lambda e: F.struct(e["event"].alias("event"), e["data"]["callId"].alias("call_id"), e["data"]["toolName"].alias("name"), e["data"]["args"].alias("args"), e["data"]["output"].alias("output"), e["data"]["error"].alias("error")))
    none = F.expr(f"cast(array() as array<{schemas.CALL}>)")
    tools = F.when(F.size(seq) <= 0, none).when(F.try_element_at(seq, F.lit(1))["tool_name"].isNotNull(), typed).otherwise(pair_events(flat))
    return rows.withColumn("tools", F.coalesce(tools, none)).drop("tool_call_sequence")


def numbered(rows: DataFrame) -> DataFrame:
    """Adds ``position``, gapless from 0 in the order of file names and lines, however the files were split.

    A split (file, first byte) is read by one task in its order; the sizes of the splits before are added.
    """
    sizes = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n")).orderBy("file", "block").collect()
    before, total = [], 0
    for r in sizes:
        before.append((r["file"], r["block"], total))
        total += r["n"]
    shifts = F.broadcast(rows.sparkSession.createDataFrame(before, "file string, block long, _before long"))
    own = F.row_number().over(Window.partitionBy("file", "block").orderBy("seq")) - 1
    return rows.withColumn("_own", own).join(shifts, ["file", "block"]).withColumn("position", (F.col("_own") + F.col("_before")).cast("long")).drop("_own", "_before")


def correctness(spark: SparkSession, path: str) -> DataFrame:
    """(position, correct) of a result file: JSON lines, an array of booleans, or an object of results or items."""
    if path.endswith(".jsonl"):
        rows = numbered(read(spark, path, "correct boolean, pass boolean"))
        return rows.select("position", F.coalesce("correct", "pass", F.lit(False)).alias("correct"))
    whole = spark.read.text(path, wholetext=True)
    item = "array<struct<correct:boolean,pass:boolean>>"
    of_object = F.from_json("value", f"results {item}, items {item}")
    listed = F.transform(F.from_json("value", F.lit("array<boolean>")), lambda b: F.coalesce(b, F.lit(False)))
    inner = F.transform(F.coalesce(of_object["results"], of_object["items"]), lambda r: F.coalesce(r["correct"], r["pass"], F.lit(False)))
    return whole.select(F.posexplode(F.when(F.ltrim("value").startswith("["), listed).otherwise(inner)).alias("position", "correct"))


def results(spark: SparkSession, path: str) -> DataFrame:
    """(id, correct) of one JSON object with ``results``: the last of an id, those without a verdict left out."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "results array<struct<id:string,correct:boolean>>")["results"]).alias("seq", "r"))
    return whole.where("r.correct is not null").groupBy(F.col("r.id").alias("id")).agg(F.max_by("r.correct", "seq").alias("correct"))


def evaluation_samples(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Harness samples as id, expected, predicted, correct and gen_text; rows without an id are dropped."""
    schema = "doc_id string, id string, sample_id string, doc struct<idx:string,answer:string>, target string, answer string, filtered_resps string, resps string, acc double, exact_match double"
    s = read(spark, paths, schema)
    filled = lambda c: F.when(~F.coalesce(c, F.lit("")).isin("", "0", "[]", "false"), c)
    expected = F.coalesce(filled(F.col("target")), filled(F.col("answer")), F.col("doc.answer"))
    resps = F.coalesce(filled(F.col("filtered_resps")), filled(F.col("resps")))
    gen = F.coalesce(F.get_json_object(resps, "$[0][0]"), F.get_json_object(resps, "$[0]"), F.lit(""))
    rows = s.select("seq", F.coalesce("doc_id", "id", "sample_id", "doc.idx").alias("id"), expected.alias("expected"), gen.alias("gen_text"), F.coalesce("acc", "exact_match").alias("_acc")).where("id is not null")
    guess = (F.col("expected") != "") & (F.col("gen_text") != "") & F.contains("gen_text", F.trim("expected"))
    return rows.select("seq", "id", "expected", answer(F.col("gen_text")).alias("predicted"), F.coalesce(F.col("_acc") != 0, guess, F.lit(False)).alias("correct"), "gen_text")


def union_files(spark: SparkSession, paths: list[str], schema: str, version: str | None = None) -> DataFrame:
    """Rows of several files in their order (``k``), of one schema version if given."""
    out = None
    for k, p in enumerate(paths):
        one = read(spark, p, schema).withColumn("k", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out if version is None else out.where(F.col("schema_version") == version)


def preference_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Preference rows of several files, the first of each (chosen, rejected) staying."""
    rows = union_files(spark, paths, "schema_version string, prompt_messages array<struct<role:string,content:string>>, chosen string, rejected string", "dpo/v1")
    key = F.sha2(F.concat_ws("||", "chosen", "rejected"), 256)
    cols = rows.columns
    return rows.groupBy(key.alias("_k")).agg(F.min_by(F.struct(*cols), F.struct("k", "seq")).alias("r")).select("r.*")


def write(df: DataFrame, path: str, append: bool = False) -> None:
    """One JSON object a line, nulls kept."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("append" if append else "overwrite").text(path)
