"""Phrases and their tags as a table: all of them are found in one pass over a text.

The table (phrase, tag) is a dimension of up to ``MOST`` rows, checked; one automaton over its phrases is built
in each worker, so ten thousand phrases cost a text no more than one. Null and empty phrases match nothing; a
phrase may have several tags and a tag several phrases; null texts have no tags.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

MOST = 1_000_000


def rules(table: DataFrame) -> tuple[tuple[str, str], ...]:
    """The rows (phrase, tag) of a rule table, in order."""
    rows = table.where(F.col("phrase").isNotNull() & (F.col("phrase") != "") & F.col("tag").isNotNull()).select("phrase", F.col("tag").cast("string").alias("tag")).distinct().limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"a table of rules has at most {MOST} rows")
    return tuple(sorted((r["phrase"], r["tag"]) for r in rows))


@lru_cache(maxsize=4)
def automaton(pairs: tuple[tuple[str, str], ...]):
    import ahocorasick

    by: dict[str, set[str]] = {}
    for phrase, tag in pairs:
        by.setdefault(phrase, set()).add(tag)
    out = ahocorasick.Automaton()
    for phrase, tags in by.items():
        out.add_word(phrase, tags)
    out.make_automaton()
    return out


def tags(text: Column, pairs: tuple[tuple[str, str], ...], fold: bool = True) -> Column:
    """Sorted distinct tags of the phrases that the text holds, as strings anywhere in it; phrases are lower case if texts are folded."""
    if not pairs:
        return F.expr("cast(array() as array<string>)")

    @F.pandas_udf(ArrayType(StringType()))
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = automaton(pairs)
        for texts in parts:
            yield texts.map(lambda t: sorted(set().union(*(x for _, x in own.iter(t)))) if t else [])

    return found(F.lower(text) if fold else text)
