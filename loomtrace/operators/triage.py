"""Error channels of wrong answers: why an answer is not the expected one, the first channel that fits.

A_truncated: the text ran to its limit without a marked answer. A_extract_v2: the plain extraction missed an
answer that a reading of boxed, marked, grouped, decimal and percent forms finds. B_stepwise: the text's steps
(``expression = value``), executed again with each wrong value replaced wherever a later step uses it, end in
the expected one. B_selfcorrect_regress: the text corrects itself. C_token: the expected digits stand in the
text but for separators. Class2: none of these.

Rows are independent: a helper of plain arithmetic runs over Arrow batches, and counts are aggregates. A null
text is empty; a null expected answer fits no channel but truncation and Class2; a step that is no arithmetic
or divides by zero is passed over.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loomtrace.functions import text as T
from loomtrace.operators import telemetry

# The channels in the order in which they are tried.
CHANNELS = ("A_truncated", "A_extract_v2", "B_stepwise", "B_selfcorrect_regress", "C_token", "Class2")
#: Phrases, lower case, with which a text takes something back; a parameter.
CORRECTIONS = ("i made a mistake", "i made an error", "let me redo", "let me recalculate", "let me correct", "wait,", "that is wrong", "that's wrong")

_NUMBER = r"-?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?"
_VALUE = re.compile(_NUMBER)
_BOXED = re.compile(r"\\boxed\{([^{}]*)\}")
_MARKED = re.compile(rf"####[^\d\n-]*({_NUMBER}|\d+,\d+)\s*(%?)")
_STEP = re.compile(r"([-\d(][\d\s.,+\-*/×÷()%$]*?)=\s*\$?\s*(" + _NUMBER + ")")
_TOKEN = re.compile(r"\d+(?:\.\d+)?|[-+*/()%]")


def number(text: str | None) -> Fraction | None:
    """The value of a number's text: currency, grouping commas, a decimal comma and a final per cent sign or stop are understood."""
    t = (text or "").strip().strip("$€£ ").rstrip(".%\\ ").replace(" ", "")
    if re.fullmatch(r"-?\d+,\d{1,2}", t):  # no group has fewer than three digits
        t = t.replace(",", ".")
    t = t.replace(",", "")
    return Fraction(t) if re.fullmatch(r"-?(?:\d+\.?\d*|\.\d+)", t) else None


def emitted(text: str) -> Fraction | None:
    """The answer that a text gives: the last boxed one, else the last marked one, else the last number."""
    for pattern in (_BOXED, _MARKED, _VALUE):
        for m in reversed(pattern.findall(text)):
            if (v := number(m[0] if isinstance(m, tuple) else m)) is not None:
                return v
    return None


def evaluated(expression: str, replaced: dict[Fraction, Fraction]) -> Fraction | None:
    """The value of sums and products in brackets, with numbers replaced by what they should have been; None if it is no such thing."""
    clean = re.sub(r"[$\s]", "", expression.replace("×", "*").replace("÷", "/"))
    clean = re.sub(r"(?<=\d),(?=\d{3})", "", clean)
    tokens = _TOKEN.findall(clean)
    if "".join(tokens) != clean or not any(t in "+-*/" for t in tokens[1:]):
        return None
    at = 0

    def factor() -> Fraction:
        nonlocal at
        t = tokens[at]
        at += 1
        if t == "-":
            return -factor()
        if t == "(":
            v = total()
            if tokens[at] != ")":
                raise ValueError(t)
            at += 1
        else:
            v = replaced.get(Fraction(t), Fraction(t))
        if at < len(tokens) and tokens[at] == "%":
            at, v = at + 1, v / 100
        return v

    def product() -> Fraction:
        nonlocal at
        v = factor()
        while at < len(tokens) and tokens[at] in "*/":
            at += 1
            v = v * factor() if tokens[at - 1] == "*" else v / factor()
        return v

    def total() -> Fraction:
        nonlocal at
        v = product()
        while at < len(tokens) and tokens[at] in "+-":
            sign = 1 if tokens[at] == "+" else -1
            at += 1
            v += sign * product()
        return v

    try:
        v = total()
        return v if at == len(tokens) else None
    except (ValueError, IndexError, ZeroDivisionError, RecursionError):
        return None


def executed(text: str) -> Fraction | None:
    """The last step's value when all steps are executed again; None without a step."""
    replaced: dict[Fraction, Fraction] = {}
    last = None
    for left, stated in _STEP.findall(text):
        value, said = evaluated(left, replaced), number(stated)
        if value is not None and said is not None:
            last = value
            if said == value:
                replaced.pop(said, None)
            else:
                replaced[said] = value
    return last


def channel(expected: str | None, text: str | None, plain: str | None, truncated: bool, corrections: tuple[str, ...] = CORRECTIONS) -> str:
    """The first channel that fits a wrong answer; ``plain`` is what the plain extraction found."""
    text, want = text or "", number(expected)
    if truncated:
        return CHANNELS[0]
    if want is not None:
        given = emitted(text)
        if number(plain) != want and given == want:
            return CHANNELS[1]
        if given != want:
            if executed(text) == want:
                return CHANNELS[2]
            low = text.lower()
            if any(c in low for c in corrections):
                return CHANNELS[3]
            digits = re.sub(r"\D", "", expected or "")
            if digits and re.search(rf"(?<!\d){digits}(?!\d)", re.sub(r"(?<=\d)[\s,.'_](?=\d)", "", text)):
                return CHANNELS[4]
    return CHANNELS[5]


def channels(rows: DataFrame, max_tokens: int, expected: str = "expected", text: str = "gen_text", correct: str = "correct", corrections: tuple[str, ...] = CORRECTIONS, tokens: Column | None = None) -> DataFrame:
    """``rows`` with ``channel``, null where the answer is correct."""

    @F.pandas_udf(StringType())
    def found(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for e, t, p, cut in parts:
            yield pd.Series([channel(*r, corrections) for r in zip(e, t, p, cut.astype(bool), strict=True)], dtype=object)

    said = F.coalesce(F.col(text), F.lit(""))
    cut = T.truncated(said, max_tokens, tokens)
    wrong = ~F.coalesce(F.col(correct), F.lit(False))
    return rows.withColumn("channel", F.when(wrong, found(F.col(expected).cast("string"), said, T.answer(said), cut)))


def triaged(rows: DataFrame, lottery_rate: float | None = None) -> DataFrame:
    """One row over ``channels``: totals, a count a channel, rates and the decision."""
    counts = rows.agg(F.count(F.lit(1)).alias("n_total"), F.count("channel").alias("n_wrong"), *[F.count_if(F.col("channel") == c).alias(c) for c in CHANNELS])
    return telemetry.decision(counts.withColumn("lottery_rate", F.lit(lottery_rate).cast("double")))
