"""Ingestion: validation of evidence records, shards, and the counts of a run.

The bounded queue between router and validators is Spark's own: a source's ``maxFilesPerTrigger`` on a
stream, tasks in batch. A validator that fails gives a row that fails, not a failed task.
"""

from __future__ import annotations

import base64
import json
import os
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from loomtrace.operators import routing, trust

CAUSAL = ("parent_action_id", "causal_chain_id", "scope_lease_id", "input_taint_labels", "memory_read_refs")
RUN_FIELDS = ("recording_mode", "side_effect_class", "run_side_effect_class_max", "user_id", "subject_id")
#: (public key, signature, payload) -> whether the signature is the key's; the library that checks it is the caller's.
Verifier = Callable[[bytes, bytes, bytes], bool]


def key_variable(key_id: str, prefix: str) -> str:
    """The environment variable that holds a key."""
    return prefix + re.sub("[^A-Za-z0-9]", "_", key_id).upper()


def _decoded(text: str) -> bytes:
    """Standard or URL-safe base64, with or without padding."""
    text = text.strip()
    return base64.b64decode(text.translate(str.maketrans("-_", "+/")) + "=" * (-len(text) % 4), validate=True)


def keys_of(environment: dict[str, str] | None = None, prefix: str = "AEP_PUBKEY_") -> dict[str, str]:
    return {k: v for k, v in (os.environ if environment is None else environment).items() if k.startswith(prefix)}


def signature_errors(record: dict, keys: dict[str, str], verify: Verifier, prefix: str = "AEP_PUBKEY_") -> list[str]:
    """What is wrong with a record's signature over its canonical JSON without it; nothing if it holds."""
    block = record.get("signature")
    if block is None:
        return ["signature: no signature field"]
    if block.get("alg") != "ed25519":
        return [f"signature: unsupported algorithm {block.get('alg')!r}"]
    for part in ("key_id", "sig"):
        if not block.get(part):
            return [f"signature: no {part}"]
    text = keys.get(key_variable(block["key_id"], prefix))
    if text is None:
        return [f"signature: no public key for {block['key_id']!r}"]
    try:
        key = _decoded(text)
    except ValueError:
        return ["signature: the public key is no base64"]
    if len(key) != 32:
        return [f"signature: the public key has {len(key)} bytes, not 32"]
    try:
        signature = _decoded(block["sig"])
    except ValueError:
        return ["signature: sig is no base64"]
    payload = json.dumps({k: v for k, v in record.items() if k != "signature"}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return [] if verify(key, signature, payload.encode()) else ["signature: verification failed"]


def signatures(value: Column, verify: Verifier, keys: dict[str, str] | None = None, prefix: str = "AEP_PUBKEY_") -> Column:
    """Errors of each record's JSON text; a verifier that raises is an error of its row."""
    known = keys_of(prefix=prefix) if keys is None else keys

    def one(text: str | None) -> list[str]:
        try:
            return signature_errors(json.loads(text or "{}"), known, verify, prefix)
        except Exception as e:  # a failing check is a result
            return [f"signature: {type(e).__name__}: {e}"]

    @F.pandas_udf(ArrayType(StringType()))
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return run(value)


def _has(value: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(value), key), F.lit(False)).cast("int")


def validated(records: DataFrame, value: str | None = None, signature: Column | None = None) -> DataFrame:
    """Each record with valid_schema, errors, passed, its counts of evidence, and of the fields of later versions.

    ``value`` names the record's JSON text, from which the presence of fields without a column is read.
    """
    missing = [F.when(F.col(c).isNull(), F.lit(f"schema: {c} is a required property")) for c in ("schema_version", "run_id", "created_at_ms")]
    version = F.when(~F.col("schema_version").isin(*trust.VERSIONS), F.concat(F.lit("schema: unknown version "), F.col("schema_version")))
    parse = F.col("error") if "error" in records.columns else F.lit(None).cast("string")
    first = F.coalesce(parse, *missing, version)  # a schema check names its first error only
    errors = F.array_compact(F.array(first))
    if signature is not None:
        errors = F.concat(errors, signature)
    n, with_evidence = F.size(trust.changing()), F.size(trust.evidenced())
    size = lambda c: F.greatest(F.size(c), F.lit(0))
    out = records.withColumns({
        "valid_schema": first.isNull(), "errors": errors, "has_model_id": F.coalesce(F.col("model_id") != "", F.lit(False)), "has_actions": size("actions") > 0,
        "has_verifier_results": size("verifier_results") > 0, "n_changing": F.greatest(n, F.lit(0)), "n_evidenced": F.greatest(with_evidence, F.lit(0)),
        "evidence_completeness": F.when(n > 0, with_evidence / n).otherwise(1.0),
    })
    if value is not None:
        raw = F.from_json(F.get_json_object(value, "$.actions"), "array<string>")
        causal = F.aggregate(F.coalesce(raw, F.expr("cast(array() as array<string>)")), F.lit(0), lambda s, a: s + sum((_has(a, k) for k in CAUSAL), F.lit(0)))
        out = out.withColumns({"n_causal_fields": causal, "n_run_fields": sum((_has(F.col(value), k) for k in RUN_FIELDS), F.lit(0)), "has_run_context": _has(F.col(value), "run_context") == 1})
    return out.withColumn("passed", F.col("valid_schema") & (F.size("errors") == 0))


def ingest(records: DataFrame, shards: int = 16, value: str | None = None, signature: Column | None = None) -> DataFrame:
    """The validated records with their shard, as they may be written by shard."""
    return validated(records, value, signature).withColumn("shard", routing.shard_of(routing.routing_key().cast("string"), shards))


def ingested(rows: DataFrame) -> DataFrame:
    """Per shard: records, valid and invalid ones; the totals are sums of these rows."""
    return rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("n_valid"), F.count_if(~F.col("passed")).alias("n_invalid"))


def totals(counted: DataFrame) -> DataFrame:
    return counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_records"), F.count(F.lit(1)).alias("n_shards_used"), F.coalesce(F.sum("n_valid"), F.lit(0)).alias("valid_count"), F.coalesce(F.sum("n_invalid"), F.lit(0)).alias("invalid_count"))
