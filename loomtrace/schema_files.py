"""JSON Schema texts of the record shapes, their drift against files, and parse checks of samples."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtrace import schemas

SHAPES = {"rollout": schemas.ROLLOUT, "compliance": schemas.COMPLIANCE, "evaluation": schemas.EVAL, "evidence": schemas.AEP}
_NAMES = {T.StringType: "string", T.BooleanType: "boolean", T.DoubleType: "number", T.IntegerType: "integer", T.LongType: "integer"}


def _type(kind: T.DataType) -> dict:
    if isinstance(kind, T.StructType):
        return {"type": "object", "properties": {f.name: _type(f.dataType) for f in kind.fields}}
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": _type(kind.elementType)}
    return {"type": _NAMES[type(kind)]}


def generated(spark: SparkSession, base: str = "") -> dict[str, dict]:
    """Name -> JSON Schema of every record shape."""
    out = {}
    for name, ddl in SHAPES.items():
        kind = spark.createDataFrame([], ddl.replace("\n", " ")).schema
        out[name] = {"$schema": "https://json-schema.org/draft/2020-12/schema", "$id": f"{base}{name}.schema.json", **_type(kind)}
    return out


def drift(spark: SparkSession, files: DataFrame, base: str = "") -> DataFrame:
    """Each shape against files (name, text): same, drift or missing."""
    want = spark.createDataFrame([(k, json.dumps(v, sort_keys=True)) for k, v in generated(spark, base).items()], "name string, want string")
    same = F.parse_json("text").cast("string") == F.parse_json("want").cast("string")
    return want.join(files, "name", "left").select("name", F.when(F.col("text").isNull(), "missing").when(same, "same").otherwise("drift").alias("status"))


def parse_errors(lines: DataFrame, shape: str, required: tuple[str, ...] = ()) -> DataFrame:
    """Counts of texts (value) that are no such record, or lack a required field."""
    got = F.from_json("value", f"{SHAPES[shape]}, _bad string".replace("\n", " "), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    keys = F.json_object_keys("value")
    lacks = F.array_compact(F.array(*[F.when(~F.coalesce(F.array_contains(keys, r), F.lit(False)), F.lit(r)) for r in required])) if required else F.expr("cast(array() as array<string>)")
    rows = lines.select(got["_bad"].isNotNull().alias("bad"), lacks.alias("lacks"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("n_unparsed"), F.count_if(~F.col("bad") & (F.size("lacks") > 0)).alias("n_lacking"))
