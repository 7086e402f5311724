"""Secret scans over an incremental blob ledger, in DataFrame operations only.

Method. Every version of a text is a blob named by its SHA-256. The ledger (Parquet, one row a blob
and scan) says which rule versions a blob was scanned with and what each, by name and version, found; so
rules may be added, removed and put in another order between scans. A scan takes the
distinct blobs, leaves out the (blob, rule version) pairs that the ledger has, scans each remaining
blob once however many paths hold it, appends to the ledger, and joins findings back to all paths.

Positions. Java's ``split`` gives the gaps between the matches that ``regexp_extract_all`` gives, so
their lengths, added up, are the matches' code points; both find leftmost non-overlapping matches.
A cheap ``contains`` that every match must satisfy stands before the costlier patterns.

Defined results: null texts count as empty; an empty text is a blob without findings; equal texts are
one blob; very long texts cost time in proportion to their length for each rule; repeated rows repeat; findings of several rules may overlap and all stay; an empty table
gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.llm.common import checkpointed, forgotten, shared_dir


@dataclass(frozen=True)
class Rule:
    """pattern (Java); ``least`` characters of ``group``; ``needs``: one of them is in any text that matches."""

    name: str
    pattern: str
    version: int = 1
    group: int = 0
    least: int = 1
    needs: tuple[str, ...] = ()

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


#: The base rules, then those that the scan adds; their order settles ties of the start.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=8, needs=("=", ":")),
    # a run that fails for its length holds no shorter one that passes, so the length can stand in the pattern
    Rule("access", r"AKIA[A-Z0-9]{12,}", needs=("AKIA",)),
    Rule("hex", r"[0-9a-f]{32,}"),
)
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", needs=("PRIVATE KEY-----",)),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", needs=("eyJ",)),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", needs=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", needs=("xox",)),
)
RULES = BASE + ADDED
#: Findings as the ledger keeps them, under the rule's name and version, and in the order of the rules that are asked for.
FOUND = "array<struct<start:bigint,rule:string,end:bigint>>"
RANKED = "array<struct<start:bigint,rank:int,end:bigint>>"


def _none() -> Column:
    return F.expr(f"cast(array() as {FOUND})")


def matches(text: Column, rule: Rule) -> Column:
    """The rule's findings in a text: structs (start, rule, end)."""
    pattern = F.lit(rule.pattern)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    sized = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length) if rule.group else F.transform(whole, F.length)
    gaps = F.transform(F.split(text, rule.pattern, -1), F.length)
    steps = F.arrays_zip(gaps.alias("gap"), F.transform(whole, F.length).alias("own"), sized.alias("part"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), _none().alias("out"))

    def walk(state: Column, x: Column) -> Column:
        begin = state["at"] + x["gap"]
        end = begin + F.coalesce(x["own"], F.lit(0))
        one = F.array(F.struct(begin.cast("bigint").alias("start"), F.lit(rule.key).alias("rule"), end.cast("bigint").alias("end")))
        return F.struct(end.cast("bigint").alias("at"), F.when(x["part"] >= rule.least, F.concat(state["out"], one)).otherwise(state["out"]).alias("out"))

    found = F.aggregate(steps, start, walk, lambda state: state["out"])
    possible = F.lit(not rule.needs)
    for needed in rule.needs:
        possible = possible | F.contains(text, F.lit(needed))
    return F.when(possible & text.rlike(rule.pattern), found).otherwise(_none())


class Ledger:
    """Which blobs were scanned with which rule versions, and the findings; a Parquet folder."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or forgotten(spark, f"{shared_dir(spark).rstrip('/')}/ledger-{uuid.uuid4().hex}")

    schema = f"blob string, rules array<string>, found {FOUND}"

    def read(self) -> DataFrame | None:
        """The rows, or None before the first scan."""
        jvm = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not jvm.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(jvm):
            return None
        return self.spark.read.schema(self.schema).parquet(self.path)

    def append(self, rows: DataFrame) -> None:
        rows.select("blob", "rules", "found").write.mode("append").parquet(self.path)


def blob(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def unseen(versions: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, text, todo): each blob once, with the rule versions it was not scanned with."""
    keys = F.array(*[F.lit(r.key) for r in rules])
    blobs = versions.groupBy("blob").agg(F.first("text").alias("text"))
    known = ledger.read()
    if known is None:
        return blobs.withColumn("todo", keys)
    seen = known.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
    left = blobs.join(seen, "blob", "left").withColumn("todo", F.array_except(keys, F.coalesce("seen", F.expr("cast(array() as array<string>)"))))
    return left.where(F.size("todo") > 0).select("blob", "text", "todo")


def scan(df: DataFrame, ledger: Ledger, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> None:
    """Scan the unseen pairs of ``df``'s texts and add them to the ledger."""
    versions = df.select(blob(F.col(text_col)).alias("blob"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    each = [F.when(F.array_contains("todo", r.key), matches(F.col("text"), r)).otherwise(_none()) for r in rules]
    ledger.append(unseen(versions, ledger, rules).select("blob", F.col("todo").alias("rules"), F.concat(*each).alias("found")))


def findings(df: DataFrame, ledger: Ledger, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, blob and found (start, rank in ``rules``, end) of every row, from the ledger: the findings of these rule versions."""
    paths = df.select(F.col(id_col).alias("doc_id"), blob(F.col(text_col)).alias("blob"))
    wanted = F.array(*[F.lit(r.key) for r in rules])
    known = ledger.read().where(F.arrays_overlap("rules", wanted)).select(F.col("blob").alias("_b"), F.filter("found", lambda x: F.array_contains(wanted, x["rule"])).alias("found"))
    ranked = F.transform(F.flatten(F.collect_list("found")), lambda x: F.struct(x["start"].alias("start"), (F.array_position(wanted, x["rule"]) - 1).cast("int").alias("rank"), x["end"].alias("end")))
    per_blob = known.groupBy("_b").agg(F.array_sort(F.array_distinct(ranked)).alias("found"))
    # cut off, so that the join alone decides the exchange and AQE can split a blob with very many paths
    return paths.join(checkpointed(per_blob), F.col("blob") == F.col("_b")).select("doc_id", "blob", "found")


def joined(found: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    names = F.array(*[F.lit(r.name) for r in rules])
    return F.concat_ws(",", F.transform(found, lambda x: F.concat_ws(":", F.element_at(names, x["rank"] + 1), x["start"], x["end"])))


def _of(rank: int):
    return lambda x: x["rank"] == rank


def digests(df: DataFrame, ledger: Ledger | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scan what the ledger lacks, then counts, digest and spans of every row."""
    ledger = ledger or Ledger(df.sparkSession)
    scan(df, ledger, text_col)
    rows = findings(df, ledger, id_col, text_col)
    base = F.filter("found", lambda x: x["rank"] < len(BASE))
    counts = [F.size(F.filter("found", _of(k))).cast("long").alias(f"n_{r.name}") for k, r in enumerate(BASE)]
    return rows.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def oracle_sql() -> str:
    """The query in DuckDB, from the contract's words: each kind's matches by its plain pattern, then found again one after another."""
    token = "[A-Za-z0-9_-]{8,}"
    kinds = [  # name, pattern, group of the match, group that is measured, least length
        ("assign", r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 1, 2, 8),
        ("access", "(AKIA[A-Z0-9]+)", 1, 1, 16),
        ("hex", "([0-9a-f]+)", 1, 1, 32),
        ("pem", "(-----BEGIN [A-Z ]*PRIVATE KEY-----)", 1, 1, 1),
        ("jwt", rf"(?:^|[^A-Za-z0-9_-])(eyJ{token}[.]{token}[.]{token})", 1, 1, 1),
        ("forge", "(gh[pousr]_[A-Za-z0-9]+)", 1, 1, 40),
        ("chat", "(xox[abprs]-[A-Za-z0-9-]+)", 1, 1, 15),
    ]
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    parts = " UNION ALL ".join(
        f"SELECT doc_id, {k} AS kind, {quoted(name)} AS name, {least} AS least, regexp_extract_all(t, {quoted(p)}, {g}) AS own, list_transform(regexp_extract_all(t, {quoted(p)}, {m}), lambda x: length(x)) AS n FROM d WHERE regexp_matches(t, {quoted(p)})"
        for k, (name, p, g, m, least) in enumerate(kinds)
    )
    return f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), m AS MATERIALIZED (SELECT * FROM ({parts.replace('SELECT doc_id', 'SELECT r, doc_id')}) WHERE len(list_filter(n, lambda x: x >= least)) > 0),
w AS (SELECT r, kind, 0 AS i, CAST(0 AS BIGINT) AS start, CAST(0 AS BIGINT) AS stop FROM m
  UNION ALL SELECT w.r, w.kind, w.i + 1, w.stop + strpos(substr(d.t, w.stop + 1), m.own[w.i + 1]) - 1, w.stop + strpos(substr(d.t, w.stop + 1), m.own[w.i + 1]) - 1 + length(m.own[w.i + 1])
  FROM w JOIN m ON m.r = w.r AND m.kind = w.kind JOIN d ON d.r = w.r WHERE w.i < len(m.own)),
f AS (SELECT w.r, w.kind, w.start, concat(m.name, ':', w.start, ':', w.stop) AS span FROM w JOIN m ON m.r = w.r AND m.kind = w.kind WHERE w.i > 0 AND m.n[w.i] >= m.least),
a AS (SELECT r, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS b, count(*) FILTER (kind = 2) AS c, string_agg(span, ',' ORDER BY start, kind) FILTER (kind < 3) AS base, string_agg(span, ',' ORDER BY start, kind) AS spans FROM f GROUP BY r)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (r)"""
