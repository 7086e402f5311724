"""Scrubbing of free JSON: keys that name secrets lose their values, every other string is redacted."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loomtrace.functions.text import REDACTED, REDACTIONS, SENSITIVE_KEYS

#: Fields of a message that carry what has to be scrubbed.
FIELDS = ("tool_call", "model_response", "response", "content")


def _python(pattern: str) -> re.Pattern:
    """A pattern of Java syntax; its U flag is Python's way anyway."""
    flags = re.match(r"\(\?([a-zA-Z]+)\)", pattern)
    kept = "".join(c for c in flags[1] if c in "is") if flags else ""
    return re.compile((f"(?{kept})" if kept else "") + (pattern[flags.end() :] if flags else pattern))


def value(x, patterns: list[re.Pattern] | None = None):
    """A scrubbed copy of any JSON value."""
    patterns = patterns or [_python(p) for p in REDACTIONS]
    if isinstance(x, dict):
        return {k: REDACTED if k.lower().replace("-", "_") in SENSITIVE_KEYS else value(v, patterns) for k, v in x.items()}
    if isinstance(x, list):
        return [value(v, patterns) for v in x]
    if isinstance(x, str):
        for p in patterns:
            x = p.sub(REDACTED, x)
    return x


def _mapped(one):
    @F.pandas_udf(StringType())
    def run(text: pd.Series) -> pd.Series:
        patterns = [_python(p) for p in REDACTIONS]
        return text.map(lambda t: None if t is None else json.dumps(one(json.loads(t), patterns), ensure_ascii=False))

    return run


def _message(x, patterns):
    return {k: value(v, patterns) if k in FIELDS else v for k, v in x.items()} if isinstance(x, dict) else x


def json_text(c: Column) -> Column:
    """Each JSON text scrubbed, at any depth."""
    return _mapped(value)(c)


def message(c: Column) -> Column:
    """Each message's JSON text with only its carrying fields scrubbed."""
    return _mapped(_message)(c)


def field(record: Column, name: str) -> Column:
    """A record's field as text: its own if it has the key, even null, else its run context's."""
    own = F.coalesce(F.array_contains(F.json_object_keys(record), name), F.lit(False))
    return F.when(own, F.get_json_object(record, f"$.{name}")).otherwise(F.get_json_object(record, f"$.run_context.{name}"))
