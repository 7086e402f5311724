"""Dataset digests, versions, receipts and cards."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.functions.jsontext import compact_json


def record_digests(rows: DataFrame, order: str) -> DataFrame:
    """order and the sha256 of each record's canonical JSON."""
    cols = [c for c in rows.columns if c != order]
    return rows.select(order, F.sha2(compact_json(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})), 256).alias("digest"))


def digest(rows: DataFrame, order: str, block: int = 10_000) -> str:
    """Order-sensitive digest of a dataset: sha256 over block digests, each over its records' digests.

    Blocks are runs of ``block`` consecutive values of ``order`` (a gapless sequence number), so no task
    holds more than a block and the driver gets 64 characters a block.
    """
    each = record_digests(rows, order).withColumn("b", F.floor(F.col(order) / block))
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "digest"))), lambda x: x["digest"]), "\n")
    blocks = each.groupBy("b").agg(F.sha2(lines, 256).alias("d")).orderBy("b")
    total = hashlib.sha256()
    for r in blocks.toLocalIterator():
        total.update(r["d"].encode() + b"\n")
    return total.hexdigest()


def version(rows: DataFrame, order: str, name: str, out_dir: str) -> dict:
    """Write a dataset under a path named by its digest; the same data give the same path."""
    d = digest(rows, order)
    path = f"{out_dir}/{name}-v-{d[:6]}"
    rows.write.mode("overwrite").parquet(path)
    return {"name": name, "version": f"v-{d[:6]}", "digest": d, "path": path, "n_records": rows.count()}


def receipt(run_id: str, inputs: dict[str, str], outputs: dict[str, str], models: list[str], operator: str = "", created_at_ms: int = 0) -> dict:
    """A run's receipt with the digest of its other fields."""
    body = {"run_id": run_id, "inputs": inputs, "outputs": outputs, "models": list(dict.fromkeys(models)), "operator": operator, "created_at_ms": created_at_ms}
    text = json.dumps(body, sort_keys=True, separators=(",", ":"))
    return body | {"receipt_digest": hashlib.sha256(text.encode()).hexdigest()}


def field_coverage(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Per field: records that have it, its share, and covered, partial or gap."""
    n = F.count(F.lit(1))
    counted = rows.agg(n.alias("n"), *[F.count_if(F.col(f).isNotNull()).alias(f) for f in fields])
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("present")) for f in fields])).alias("x")
    out = counted.select("n", pairs).select("x.field", "x.present", (F.col("x.present") / F.col("n")).alias("share"))
    return out.withColumn("status", F.when(F.col("share") >= 0.5, "covered").when(F.col("share") > 0, "partial").otherwise("gap"))


def card(name: str, counts: dict[str, int], date: str = "") -> str:
    """A dataset card in Markdown."""
    rows = "\n".join(f"| {k} | {v} |" for k, v in counts.items())
    return f"# {name}\n\n{date}\n\n| part | records |\n|-|-|\n{rows}\n"
