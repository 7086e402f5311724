"""Quality rules by weak supervision: rules vote or abstain, EM weighs them, the posterior decides.

Method. Each of the ``RULES`` looks at counts of one text and votes good (+), bad (-) or abstains (0).
Texts with the same votes are alike to the model, so the whole corpus enters expectation-maximisation
as the counts of vote patterns: at most 3 ** len(RULES) numbers, whatever the input. EM estimates
the share of good texts and, for each rule and class, how often it votes good, bad or abstains; a
text is kept if its posterior probability of being good reaches ``KEEP``. A rule that disagrees with
the others loses weight instead of rejecting texts alone. A weak Dirichlet prior says that rules are
better than chance, which fixes the classes' names. Two base rules always reject (``base_failed``).

Defined results: null texts count as empty; a text without words has all counts 0 and fails the base
rules; very long texts cost time and memory in proportion to their length, at any number of distinct
words; repeated rows count as often as they occur; equal texts get equal verdicts, and a posterior of
exactly ``KEEP`` keeps; an empty table
gives an empty table; further columns are ignored (``rules``) or kept as they are (``keep``).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtrace.llm.common import checkpointed, free, map_slices, written

KEEP, ROUNDS = 0.5, 60
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SYMBOL, _RUN = re.compile(rb"[#*$%&|<>]"), re.compile(rb"[#*$%&|<>]{2}")
_SPACE, _SYMBOLS = [bytes([c]) for c in b"\x20\t\n\x0b\x0c\r"], [bytes([c]) for c in b"#*$%&|<>"]


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more."""
    n = len(words)
    index = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if n < 4 or len(index) == n:
        return 0
    x = np.fromiter(map(index.__getitem__, words), np.int64, n)
    size = len(index)
    # two steps, as three indices need not fit a key
    _, pair = np.unique(x[:-1] * size + x[1:], return_inverse=True)
    keys = pair[:-1] * size + x[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    often = np.zeros(n - 2, bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[k : n - 2 + k] |= often
    return int(inside.sum())


def counts(text: str | None) -> dict[str, int]:
    """The counts of the base rules and those that only the votes use."""
    text = text or ""
    data = text.encode()
    words = data.split()  # on \x20 and \x09-\x0D, as bytes know no other white space
    lines = [x for x in data.split(b"\n") if x.strip()]
    own = [w for w in words if _SYMBOL.search(w)]
    chars = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    return {
        "n_words": len(words),
        "word_chars": len(text) - int(sum(chars[c[0]] for c in _SPACE)),
        "n_symbols": int(sum(chars[c[0]] for c in _SYMBOLS)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeat_words(words),
        "lines": len(lines),
        "upper": int(chars[65:91].sum()),
        "lower": int(chars[97:123].sum()),
        "plain": int(chars[48:58].sum() + chars[65:91].sum() + chars[97:123].sum() + chars[128:].sum()),
        "word_bytes": len(data) - int(sum(chars[c[0]] for c in _SPACE)),
        "symbol_words": len(own),
        "symbol_runs": sum(_RUN.search(w) is not None for w in own),
        "shouts": int(chars[33]),
        "runs": sum(map(bytes.__eq__, words, words[1:])),
        "distinct": len(set(words)),
    }


def _ratio(top: str, base: str, good: float, bad: float, least: int = 10):
    """Good up to ``good``, bad from ``bad``, else no vote; none either below ``least`` of the base."""

    def vote(c: dict[str, int]) -> int:
        if c[base] < least:
            return 0
        r = c[top] / c[base]
        return 1 if r <= good else -1 if r >= bad else 0

    return vote


#: name -> vote: 1 good, -1 bad, 0 abstains.
RULES = {
    "length": lambda c: -1 if c["n_words"] < 20 else 1 if c["n_words"] >= 50 else 0,
    "symbols": _ratio("n_symbols", "n_words", 0.03, 0.15),
    "symbol_words": _ratio("symbol_words", "n_words", 0.05, 0.25),
    "symbol_runs": lambda c: 0 if c["n_words"] < 10 else -1 if 20 * c["symbol_runs"] >= c["n_words"] else 1 if c["symbol_words"] == 0 else 0,
    "marks": lambda c: 0 if c["word_bytes"] < 40 else -1 if 9 * (c["word_bytes"] - c["plain"]) > c["word_bytes"] else 1 if 14 * (c["word_bytes"] - c["plain"]) < c["word_bytes"] else 0,
    "repeats": _ratio("n_repeat_words", "n_words", 0.35, 0.75),
    "runs": _ratio("runs", "n_words", 0.05, 0.25),
    "duplicate_lines": _ratio("n_dup_lines", "lines", 0.2, 0.6, 3),
    "capitals": lambda c: 0 if c["upper"] + c["lower"] < 40 else -1 if c["upper"] > c["lower"] else 1 if 4 * c["upper"] < c["lower"] else 0,
    "shouts": _ratio("shouts", "n_words", 0.05, 0.3),
    "word_length": lambda c: 0 if c["n_words"] < 10 else 1 if 3 <= c["word_chars"] / c["n_words"] <= 12 else -1,
    "variety": lambda c: 0 if c["n_words"] < 40 else -1 if 20 * c["distinct"] < c["n_words"] else 1 if 6 * c["distinct"] >= c["n_words"] else 0,
}


def votes(c: dict[str, int]) -> str:
    return "".join("-0+"[rule(c) + 1] for rule in RULES.values())


def base_failed(c: dict[str, int]) -> bool:
    return c["n_words"] < 50 or 100 * c["n_repeat_words"] > 50 * c["n_words"]


def estimate(patterns: dict[str, int], rounds: int = ROUNDS) -> dict[str, float]:
    """EM over counts of vote patterns: each pattern's posterior probability of a good text."""
    if not patterns:
        return {}
    names = sorted(patterns)
    n = np.array([patterns[p] for p in names], np.float64)
    v = np.array([["-0+".index(c) for c in p] for p in names])  # 0 bad, 1 abstains, 2 good
    one = np.eye(3)[v]  # pattern x rule x vote
    # a prior's weight of 2 % of the texts: a good text gets eight good votes for one bad, and the reverse
    prior = 0.02 * n.sum() * np.array([[0.65, 0.25, 0.10], [0.10, 0.25, 0.65]])
    bad, good = (v == 0).sum(axis=1), (v == 2).sum(axis=1)
    post = (good + 1) / (good + 4 * bad + 2)
    for _ in range(rounds):
        share = ((post * n).sum() + 0.01 * n.sum()) / (1.02 * n.sum())  # a prior of the same weight, half of it good
        log = []
        for weight, first in ((n * (1 - post), prior[0]), (n * post, prior[1])):
            total = np.einsum("p,prv->rv", weight, one) + first
            log.append(np.einsum("prv,rv->p", one, np.log(total / total.sum(axis=1, keepdims=True))))
        z = np.log(share / (1 - share)) + log[1] - log[0]
        post = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    return dict(zip(names, post.tolist(), strict=True))


def _posteriors(voted: DataFrame, votes_col: str, pattern: str = "_pattern", posterior: str = "posterior") -> DataFrame:
    """One row a vote pattern, at most 3 ** len(RULES), under the given names."""
    patterns = {r["v"]: r["n"] for r in voted.groupBy(F.col(votes_col).alias("v")).agg(F.count(F.lit(1)).alias("n")).collect()}
    return F.broadcast(voted.sparkSession.createDataFrame(list(estimate(patterns).items()), f"{pattern} string, {posterior} double"))


def rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = KEEP) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, votes and posterior of every text."""

    def task():
        def each(p: pa.RecordBatch) -> pa.RecordBatch:
            found = [counts(t) for t in p.column("text").to_pylist()]
            out = [pa.array([c[k] for c in found], pa.int64()) for k in COUNTS]
            return pa.RecordBatch.from_arrays([p.column("doc_id"), *out, pa.array(map(base_failed, found), pa.bool_()), pa.array(map(votes, found), pa.string())], names=["doc_id", *COUNTS, "base_failed", "votes"])

        return each

    kind = df.schema[id_col].dataType.simpleString()
    rows = map_slices(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), task, f"doc_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, votes string")
    rows = checkpointed(rows)
    joined = rows.join(_posteriors(rows, "votes"), F.col("votes") == F.col("_pattern"))
    return joined.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & (F.col("posterior") >= threshold)).alias("kept"), "votes", "posterior")


def keep(df: DataFrame, text_col: str = "text", threshold: float = KEEP) -> DataFrame:
    """The rows of ``df``, with all their columns, that the rules keep."""
    name, pattern, posterior = (free(c, df) for c in ("_votes", "_pattern", "_posterior"))

    def task():
        def each(p: pa.RecordBatch) -> pa.RecordBatch:
            found = [counts(t) for t in p.column(text_col).to_pylist()]
            return p.append_column(name, pa.array([("!" if base_failed(c) else "") + votes(c) for c in found], pa.string()))

        return each

    rows = written(map_slices(df, task, T.StructType([*df.schema.fields, T.StructField(name, T.StringType())]), text_col), "quality")
    known = _posteriors(rows.select(F.ltrim(F.col(name), F.lit("!")).alias("v")), "v", pattern, posterior).where(F.col(posterior) >= threshold)
    # a failed base rule's mark keeps a row from meeting any pattern
    return rows.join(known, F.col(name) == F.col(pattern), "left_semi").select(*[F.col(f"`{c}`") for c in df.columns])
