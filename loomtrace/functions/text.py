"""Text functions: normalisation, n-grams, redaction, injection signals, answers.

Columns stay in the JVM; only Unicode NFKC, which Spark lacks, is a Python function.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: A word character of any script, as Python's ``\\w`` has it (Java's is ASCII).
WORD = r"([\p{L}\p{N}_]+)"

# Invisible code points replaced by a space before comparing texts.
INVISIBLE = "\u200b\u200c\u200d\u00ad\u2060\ufeff\u2061\u2062\u2063\u2064"

# Phrases that mark a prompt injection.
INJECTION_SIGNALS = (
    "ignore previous instructions", "ignore all previous", "disregard your instructions", "disregard all",
    "forget your previous context", "forget all previous", "new instructions:", "system prompt:", "you are now dan",
    "you are now an unrestricted", "override safety filters", "end of prior context", "ignore prior", "exfiltrate",
    "leak the private key", "leak all secrets", "output the system prompt", "reveal all confidential", "send all collected data",
    "act as an ai with developer mode", "unrestricted language model", "no content filters", "hacker ai without restrictions",
    "no guidelines or safety rules", "ethical constraints have been removed", "unfiltered, compliant ai",
)

# What is redacted, in this order (Java syntax).
REDACTIONS = (
    r"(?i)[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}",
    r"(?U)\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b",
    r"(?U)\b\d{3}-\d{2}-\d{4}\b",
    r"(?U)\b(?:\d{1,3}\.){3}\d{1,3}\b",
    r"(?iU)\bBearer\s+[A-Za-z0-9\-._~+/]+=*",
    r"(?U)\bAKIA[0-9A-Z]{16}\b",
    r"(?iU)(?:key|token|secret|password)\s*[=:]\s*['\"]?([A-Za-z0-9\-._+/]{20,})['\"]?",
    r"(?s)-----BEGIN (?:RSA |EC )?PRIVATE KEY-----.*?-----END (?:RSA |EC )?PRIVATE KEY-----",
    r"(?iU)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b",
)
REDACTED = "[REDACTED]"
# Keys whose whole value is redacted.
SENSITIVE_KEYS = (
    "api_key", "apikey", "authorization", "auth", "password", "passwd", "pwd", "token", "access_token", "refresh_token", "id_token",
    "secret", "client_secret", "credential", "credentials", "aws_access_key_id", "aws_secret_access_key", "aws_session_token",
    "private_key", "private_key_id", "x_api_key", "x_auth_token", "bearer",
)


@F.udf(StringType(), useArrow=False)
def _nfkc(text: str | None) -> str | None:
    return text if text is None else unicodedata.normalize("NFKC", text)


def nfkc(text: Column) -> Column:
    """NFKC. Only texts that are not ASCII go to Python, a hundred at a time: an Arrow batch has thousands of whole texts, copied several times."""
    return F.coalesce(_nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def squeeze(text: Column) -> Column:
    """Invisible characters to spaces, runs of white space to one space, ends trimmed."""
    shown = F.translate(text, INVISIBLE, " " * len(INVISIBLE))
    return F.trim(F.regexp_replace(shown, r"[\s\u0085\u001c-\u001f\p{Z}]+", " "))


def normalize(text: Column) -> Column:
    return squeeze(nfkc(text))


_HIDDEN = re.compile(f"[{INVISIBLE}]")


def normalized(text: str | None) -> str | None:
    """``normalize`` of a text that is in Python already; ``split`` parts at the same white space."""
    return text if text is None else " ".join(_HIDDEN.sub(" ", text if text.isascii() else unicodedata.normalize("NFKC", text)).split())


def _grams(parts: Column, n: int, glue: str) -> Column:
    """Distinct runs of n parts. The parts are bound by a lambda, so that they are computed once, not for every run."""

    def runs(p: Column) -> Column:
        made = F.transform(F.sequence(F.lit(1), F.size(p) - (n - 1)), lambda i: F.array_join(F.slice(p, i, n), glue))
        return F.when(F.size(p) >= n, F.array_distinct(made)).otherwise(F.expr("cast(array() as array<string>)"))

    return F.element_at(F.transform(F.array(parts), runs), 1)


def word_ngrams(text: Column, n: int = 8) -> Column:
    """Distinct n-word sequences of the lower-cased text, joined by a space; empty below n words."""
    return _grams(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(1)), n, " ")


def char_ngrams(text: Column, n: int) -> Column:
    """Distinct substrings of n characters of the lower-cased text."""
    chars = F.when(text == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(F.lower(text), ""))
    return _grams(chars, n, "")


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements; 0 if a side is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def redact(text: Column) -> Column:
    for pattern in REDACTIONS:
        text = F.regexp_replace(text, pattern, F.lit(REDACTED.replace("$", r"\$")))
    return text


def sensitive_key(key: Column) -> Column:
    return F.replace(F.lower(key), F.lit("-"), F.lit("_")).isin(*SENSITIVE_KEYS)


def scrub_map(values: Column) -> Column:
    """A string map with sensitive keys' values replaced and the others redacted."""
    return F.transform_values(values, lambda k, v: F.when(sensitive_key(k), F.lit(REDACTED)).otherwise(redact(v)))


def injection_signal(text: Column, signals: tuple[str, ...] = INJECTION_SIGNALS, normalized: bool = False) -> Column:
    """The first signal phrase that the text holds, else null."""
    low = F.lower(text if normalized else nfkc(text))
    return F.coalesce(*[F.when(F.contains(low, F.lit(s)), F.lit(s)) for s in signals])


def answer(text: Column) -> Column:
    """The number after ####, commas removed, else the last number, else null."""
    marked = F.regexp_extract(text, r"####\s*(-?[0-9][0-9,]*\.?[0-9]*)", 1)
    numbers = F.regexp_extract_all(text, F.lit(r"(-?[0-9]+\.?[0-9]*)"), F.lit(1))
    return F.when(marked != "", F.replace(marked, F.lit(","), F.lit(""))).when(F.size(numbers) > 0, F.element_at(numbers, -1))


def truncated(text: Column, max_tokens: int, tokens: Column | None = None) -> Column:
    """No marked answer, and within eight tokens of the limit; tokens default to half the characters."""
    count = tokens if tokens is not None else F.floor(F.length(text) / 2)
    return ~text.rlike(r"####\s*-?[0-9]") & (count >= max(max_tokens - 8, 0))


def short_hash(text: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)
