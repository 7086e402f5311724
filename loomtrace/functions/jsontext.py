"""Canonical JSON texts with Python's number forms, for digests (Arrow functions: VARIANT rewrites numbers)."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def _mapped(one):
    @F.pandas_udf(StringType())
    def run(text: pd.Series) -> pd.Series:
        known = {t: one(json.loads(t)) for t in text.unique() if t is not None}  # a text that recurs in the batch is read once
        return text.map(lambda t: None if t is None else known[t])

    return run


#: Sorted keys, ", " and ": ".
spaced_json = _mapped(lambda x: json.dumps(x, sort_keys=True))
#: Sorted keys, compact, non-ASCII as it is.
compact_json = _mapped(lambda x: json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False))
#: Sorted keys, compact, non-ASCII escaped.
ascii_json = _mapped(lambda x: json.dumps(x, sort_keys=True, separators=(",", ":")))


def canonical_digest(text: Column) -> Column:
    return F.sha2(compact_json(text), 256)


@F.pandas_udf(StructType([StructField("stored", StringType()), StructField("computed", StringType())]))
def receipt_digests(text: pd.Series) -> pd.DataFrame:
    rows = []
    for t in text:
        body = json.loads(t)
        stored = body.pop("receipt_digest", None)
        rows.append({"stored": stored, "body": json.dumps(body, sort_keys=True, separators=(",", ":"))})


    return pd.DataFrame({"stored": [r["stored"] for r in rows], "computed": [hashlib.sha256(r["body"].encode()).hexdigest() for r in rows]})


def receipt_verified(text: Column) -> Column:
    """Whether a receipt's stored digest is that of its other fields."""
    pair = receipt_digests(text)
    return F.coalesce(pair["stored"] == pair["computed"], F.lit(False))
