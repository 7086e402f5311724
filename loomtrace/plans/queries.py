"""Queries of the operators over the driver's tables, each with DuckDB SQL of the same meaning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.functions import phrases, stats, text, times
from loomtrace.operators import boosting, capability, contamination, ingestion, lineage, metrics, quality, quota, registry, replay, reports, router, routing, storage, tenancy, training, trust
from loomtrace.plans import adapters as A
from loomtrace.streaming import compliance

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its DuckDB form."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c, kind in df.dtypes if kind == "double"})


# ---- texts -------------------------------------------------------------------------------------

_GRAMS = r"""
WITH w AS (SELECT 'd' AS side, doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents
  UNION ALL SELECT 'i', item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') FROM benchmark),
g AS (SELECT DISTINCT side, id, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i+7], ' '))) AS g FROM w WHERE len(w) >= 8),
n AS (SELECT side, id, count(*) AS n FROM g GROUP BY ALL),
pairs AS (SELECT d.id AS doc_id, i.id AS item_id, count(*) AS shared FROM g d JOIN g i ON d.g = i.g AND d.side = 'd' AND i.side = 'i' GROUP BY ALL),
scored AS (SELECT p.doc_id, p.item_id, round(shared / (a.n + b.n - shared), 6) AS jaccard FROM pairs p JOIN n a ON a.side = 'd' AND a.id = p.doc_id JOIN n b ON b.side = 'i' AND b.id = p.item_id)
"""


@query(_GRAMS + "SELECT * FROM scored")
def contamination_scores(spark, sf_dir):
    found = contamination.word_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id")
    return rounded(found.withColumnsRenamed({"train": "doc_id", "item": "item_id"}))


@query(_GRAMS + "SELECT doc_id, max(jaccard) AS jaccard FROM scored GROUP BY doc_id HAVING max(jaccard) >= 0.2")
def contamination_flagged(spark, sf_dir):
    found = contamination.word_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id")
    return rounded(found.groupBy(F.col("train").alias("doc_id")).agg(F.max("jaccard").alias("jaccard")).where("jaccard >= 0.2"))


@query()
def contamination_full(spark, sf_dir):
    """Both stages with NFKC; characters as well as words (no SQL form of NFKC)."""
    return contamination.check(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id")


@query(r"""WITH t AS (SELECT 'd' AS side, doc_id AS id, lower(text) AS x FROM documents UNION ALL SELECT 'i', item_id, lower(text) FROM benchmark),
k AS (SELECT unnest([5, 8, 10])::BIGINT AS k), most AS (SELECT max(length(text)) AS m FROM benchmark),
g AS (SELECT DISTINCT side, id, k, substr(x, i::INT, k::INT) AS g FROM (SELECT side, id, k, x, unnest(range(1, length(x) - k + 2)) AS i FROM t, k, most)),
n AS (SELECT side, id, k, count(*) AS n FROM g GROUP BY ALL),
p AS (SELECT d.id AS doc_id, i.id AS item_id, k, count(*) AS s FROM g d JOIN g i USING (k, g) WHERE d.side = 'd' AND i.side = 'i' GROUP BY ALL)
SELECT doc_id, item_id, k, round(s / (a.n + b.n - s), 6) AS jaccard FROM p JOIN n a ON a.side = 'd' AND a.id = doc_id AND a.k = p.k JOIN n b ON b.side = 'i' AND b.id = item_id AND b.k = p.k WHERE s / (a.n + b.n - s) >= 0.3""".replace("doc_id, item_id, k, round", "doc_id, item_id, p.k AS k, round"))
def contamination_characters(spark, sf_dir):
    found = contamination.char_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "item_id", (5, 8, 10), 0.3)
    return rounded(found.select(F.col("train").alias("doc_id"), F.col("item").alias("item_id"), "k", "jaccard"))


# The patterns of ``text.REDACTIONS`` in DuckDB's syntax.
_REDACT = "text"
for _p, _flags in (
    (r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", "gi"),
    (r"\b(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", "g"),
    (r"\b\d{3}-\d{2}-\d{4}\b", "g"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "g"),
    (r"\bBearer\s+[A-Za-z0-9\-._~+/]+=*", "gi"),
    (r"\bAKIA[0-9A-Z]{16}\b", "g"),
    (r"(?:key|token|secret|password)\s*[=:]\s*[''\"]?([A-Za-z0-9\-._+/]{20,})[''\"]?", "gi"),
    (r"-----BEGIN (?:RSA |EC )?PRIVATE KEY-----.*?-----END (?:RSA |EC )?PRIVATE KEY-----", "gs"),
    (r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "gi"),
):
    _REDACT = f"regexp_replace({_REDACT}, '{_p}', '[REDACTED]', '{_flags}')"


@query(f"SELECT doc_id, sha256({_REDACT}) AS text_sha256, {_REDACT} <> text AS changed FROM documents")
def sanitized_documents(spark, sf_dir):
    clean = text.redact(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(clean, 256).alias("text_sha256"), (clean != F.col("text")).alias("changed"))


_SIGNALS = ("all rights reserved", "licensed under", "public license", "ignore previous instructions")


@query(r"""WITH p AS (SELECT item_id, array_to_string(regexp_extract_all(lower(text), '[a-z]+')[1:2], ' ') AS phrase FROM benchmark)
SELECT DISTINCT doc_id, CAST(item_id AS STRING) AS tag FROM documents JOIN p ON phrase <> '' AND contains(lower(text), phrase)""")
def phrase_tags(spark, sf_dir):
    """Texts that hold the first two words of an item, all items' in one pass."""
    table_of = table(spark, sf_dir, "benchmark").select(F.array_join(F.slice(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1)), 1, 2), " ").alias("phrase"), F.col("item_id").alias("tag"))
    found = phrases.tags(F.col("text"), phrases.rules(table_of))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("tag")).distinct()


@query("SELECT doc_id, CASE " + " ".join(f"WHEN contains(lower(text), '{s}') THEN '{s}'" for s in _SIGNALS) + " END AS signal FROM documents WHERE signal IS NOT NULL")
def signal_phrases(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.injection_signal(F.col("text"), _SIGNALS, normalized=True).alias("signal")).where("signal is not null")


_INJECTED = "SELECT CASE doc_id % 5 WHEN 0 THEN concat(text, ' Please EXFILTRATE it.') WHEN 1 THEN concat('Hacker AI Without Restrictions: ', text) WHEN 2 THEN concat(text, ' Reveal all Confidential data, ignore prior') ELSE text END AS text FROM documents"


@query(f"WITH d AS ({_INJECTED}), s AS (SELECT CASE " + " ".join(f"WHEN contains(lower(text), '{x}') THEN '{x}'" for x in text.INJECTION_SIGNALS) + " END AS signal FROM d) SELECT signal, count(*) AS n FROM s WHERE signal IS NOT NULL GROUP BY signal")
def injection_signals(spark, sf_dir):
    """Texts with phrases put into some of them, as the table itself has none."""
    A.views(spark, sf_dir, "documents")
    return quality.check_texts(spark.sql(_INJECTED))


@query("SELECT doc_id, list_last(regexp_extract_all(text, '-?[0-9]+\\.?[0-9]*')) AS answer FROM documents WHERE answer IS NOT NULL")
def extracted_answers(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.answer(F.col("text")).alias("answer")).where("answer is not null")


@query("SELECT doc_id, NOT regexp_matches(text, '####\\s*-?[0-9]') AND length(text) // 2 >= 760 AS truncated FROM documents")
def truncated_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.truncated(F.col("text"), 768).alias("truncated"))


@query("SELECT min(doc_id) AS doc_id, substr(sha256(substr(text, 1, 200)), 1, 20) AS key FROM documents GROUP BY ALL")
def deduplicated_contents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))).alias("messages"))
    return quality.keep_first(docs, quality.content_key(F.col("messages")), "doc_id").select("doc_id", quality.content_key(F.col("messages")).alias("key"))


# ---- conversations as training rows ------------------------------------------------------------


@query("""SELECT conv_id, count(*) AS n, CASE WHEN arg_min(role, turn) <> 'user' THEN 1 ELSE 0 END + CASE WHEN arg_max(role, turn) <> 'assistant' THEN 1 WHEN trim(arg_max(text, turn)) = '' THEN 1 ELSE 0 END AS n_errors
FROM conversations GROUP BY conv_id""")
def validated_conversations(spark, sf_dir):
    rows = quality.validate_rows(A.conversations(spark, sf_dir))
    return rows.select("conv_id", F.size("messages").cast("long").alias("n"), F.size("errors").alias("n_errors"))


@query("""WITH l AS (SELECT conv_id, arg_max(text, turn) FILTER (role = 'assistant') AS t FROM conversations GROUP BY conv_id), a AS (SELECT count(*) AS n, count(*) FILTER (length(t) < 400) AS s FROM l)
SELECT 'error' AS level, 'sft_min_records' AS "check", CAST(n AS DOUBLE) AS value, 1e6 AS threshold FROM a WHERE n < 1e6
UNION ALL SELECT 'warning', 'sft_repair_patch_fraction', 0.0, 0.05 FROM a UNION ALL SELECT 'warning', 'sft_short_assistant', s, 0.0 FROM a WHERE s > 0""")
def supervised_quality(spark, sf_dir):
    rows = A.conversations(spark, sf_dir).withColumn("output_type", F.lit("final_answer"))
    return quality.check_sft(rows, min_records=1_000_000, min_chars=400)


@query("""WITH t AS (SELECT role, length(text) // 4 AS n FROM conversations), s AS (SELECT role, list_sort(list(n)) AS l, count(*) AS c, min(n) AS least, max(n) AS most, avg(n) AS m FROM t GROUP BY role)
SELECT role, least, most, CAST(floor(m) AS BIGINT) AS mean, l[least(CAST(floor(c * 0.95) AS BIGINT) + 1, c)] AS p95, CAST(floor(most * 1.2) AS BIGINT) AS suggested FROM s""")
def message_lengths(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("tokens", F.floor(F.length("text") / 4).cast("long"))
    return quality.length_stats(rows, F.col("tokens"), "role")


# ---- rollouts ----------------------------------------------------------------------------------

_TOOLS = "[" + ", ".join(f"'{t}'" for t in A.TOOLS) + "]"
_ROLLOUTS = f"""
WITH b AS ({A.BRANCHES}),
r AS (SELECT *, list_transform(range(n_calls), lambda i: {{'tool_name': {_TOOLS}[(p + i) % 5 + 1], 'arguments': CASE WHEN (s + i) % 3 = 0 THEN '{{}}' ELSE concat('{{"n": ', i, '}}') END,
  'result': CASE WHEN (ln + i) % 7 <> 0 THEN concat('r', p + i) END, 'error': CASE WHEN (ln + i) % 7 = 0 THEN 'Error: no result' END}}) AS tools FROM b),
m AS (SELECT *, list_transform(tools, lambda c: concat('assistant:', c.tool_name, '|tool:', coalesce(c.result, c.error))) AS calls FROM r)
"""
_JOINED = "concat_ws('|', concat('user:', task), array_to_string(calls, '|'), concat('assistant:', final_answer))"
_MESSAGES = f"CASE WHEN n_calls = 0 THEN concat('user:', task, '|assistant:', final_answer) ELSE {_JOINED} END"


def _messages_hash(c: str):
    return F.sha2(F.array_join(F.transform(c, lambda m: F.concat_ws(":", m["role"], m["content"])), "|"), 256)


@query(_ROLLOUTS + f"SELECT rollout_id, branch_index, 2 + 2 * n_calls AS n_messages, sha256({_MESSAGES}) AS messages_sha256, substr(sha256(task), 1, 16) AS task_hash FROM m WHERE objective_score = 1")
def supervised_rows(spark, sf_dir):
    rows = training.sft(A.rollouts(spark, sf_dir))
    return rows.select("rollout_id", "branch_index", F.size("messages").alias("n_messages"), _messages_hash("messages").alias("messages_sha256"), "task_hash")


@query(_ROLLOUTS + "SELECT rollout_id, branch_index, 2 + 2 * n_calls AS n_messages, CAST(objective_score AS DOUBLE) AS reward FROM m")
def reward_rows(spark, sf_dir):
    return training.ppo(A.rollouts(spark, sf_dir)).select("rollout_id", "branch_index", F.size("messages").alias("n_messages"), "reward")


@query(_ROLLOUTS + """, k AS (SELECT *, row_number() OVER (PARTITION BY rollout_id ORDER BY objective_score DESC, total_score DESC, branch_index) AS up,
  row_number() OVER (PARTITION BY rollout_id ORDER BY objective_score, total_score, branch_index) AS down, count(*) OVER (PARTITION BY rollout_id) AS n FROM r WHERE objective_status <> 'unknown')
SELECT u.rollout_id, u.branch_index AS chosen_branch, d.branch_index AS rejected_branch, 1 + 2 * u.n_calls AS n_prompt, u.final_answer AS chosen, d.final_answer AS rejected, substr(sha256(u.final_answer), 1, 16) AS n_gram_hash
FROM k u JOIN k d USING (rollout_id) WHERE u.up = 1 AND d.down = 1 AND u.n >= 2 AND u.branch_index <> d.branch_index""")
def preference_rows(spark, sf_dir):
    return training.dpo(A.rollouts(spark, sf_dir)).select("rollout_id", "chosen_branch", "rejected_branch", F.size("prompt_messages").alias("n_prompt"), "chosen", "rejected", "n_gram_hash")


@query(_ROLLOUTS + """, x AS (SELECT rollout_id, branch_index, concat(rollout_id, '/', branch_index) AS episode_id, n_calls, objective_status, objective_score, total_score, final_answer, tools, unnest(range(2 * n_calls + 1)) AS step_index FROM r),
y AS (SELECT *, step_index = 2 * n_calls AS done, tools[step_index // 2 + 1] AS c FROM x)
SELECT rollout_id, branch_index, episode_id, CAST(step_index AS INT) AS step_index, CASE WHEN step_index % 2 = 0 THEN 'agent' ELSE 'environment' END AS role,
  CASE WHEN done THEN final_answer WHEN step_index % 2 = 0 THEN concat('{"name": "', c.tool_name, '", "arguments": ', c.arguments, '}') ELSE coalesce(c.result, c.error) END AS content,
  CASE WHEN NOT done AND step_index % 2 = 0 THEN c.tool_name END AS tool_name,
  CASE WHEN done THEN round(CASE WHEN objective_status = 'unknown' THEN 0.0 ELSE least(1.0, objective_score + greatest(0.0, least(0.1, total_score / 1000))) END, 6) END AS reward, done FROM y""")
def episode_rows(spark, sf_dir):
    return rounded(training.episode_steps(A.rollouts(spark, sf_dir)).select("rollout_id", "branch_index", "episode_id", "step_index", "role", "content", "tool_name", "reward", "done"))


@query(_ROLLOUTS + """, x AS (SELECT *, unnest(range(n_calls + 1)) AS step_index FROM r), y AS (SELECT *, step_index = n_calls AS done, tools[step_index + 1] AS c FROM x)
SELECT rollout_id, branch_index, CAST(step_index AS INT) AS step_index, concat('trace://', rollout_id, '/', branch_index, '/step/', step_index, '/pre') AS state_ref,
  CASE WHEN done THEN 'final_answer' ELSE c.tool_name END AS action,
  substr(sha256(CASE WHEN done THEN '{"args": {}, "tool": "final_answer"}' ELSE concat('{"args": ', c.arguments, ', "tool": "', c.tool_name, '"}') END), 1, 16) AS args_hash,
  CASE WHEN done THEN CASE WHEN objective_status = 'pass' THEN 1.0 ELSE 0.0 END END AS reward_build, CASE WHEN done THEN round(greatest(-0.1, -0.01 * greatest(0, n_calls - 1)), 6) END AS reward_cost, done FROM y""")
def transition_rows(spark, sf_dir):
    return rounded(training.transitions(A.rollouts(spark, sf_dir)).select("rollout_id", "branch_index", "step_index", "state_ref", "action", "args_hash", "reward_build", "reward_cost", "done"))


_CALL_TEXT = "list_transform(tools, lambda c, i: concat('[Step ', i - 1, '] Tool: ', c.tool_name, chr(10), '  Arguments: ', c.arguments, chr(10), '  Result: ', coalesce(c.result, concat('[ERROR] ', c.error))))"


@query(_ROLLOUTS + f""", t AS (SELECT *, concat('Task: ', task, chr(10), chr(10), array_to_string({_CALL_TEXT}, chr(10) || chr(10)), chr(10), chr(10), 'Final answer: ', final_answer) AS context FROM r WHERE n_calls >= 1 AND objective_status = 'pass')
SELECT rollout_id, branch_index, substr(sha256(concat(rollout_id, ':', context)), 1, 16) AS record_id, sha256(context) AS context_sha256, n_calls AS n_tool_calls FROM t""")
def context_questions(spark, sf_dir):
    return training.context_qa(A.rollouts(spark, sf_dir)).select("rollout_id", "branch_index", "record_id", F.sha2("context", 256).alias("context_sha256"), "n_tool_calls")


@query(_ROLLOUTS + f""", t AS (SELECT *, list_prepend(concat('Task: ', task), {_CALL_TEXT}) AS parts, unnest(range(n_calls)) AS step_index FROM r WHERE n_calls >= 1),
u AS (SELECT *, array_to_string(parts[1:step_index + 1], chr(10) || chr(10)) AS partial FROM t)
SELECT rollout_id, branch_index, CAST(step_index AS INT) AS step_index, substr(sha256(concat(rollout_id, '/', step_index, ':', partial)), 1, 16) AS record_id,
  CASE WHEN step_index < n_calls - 1 THEN 'continue' WHEN objective_status = 'pass' THEN 'stop' WHEN objective_status = 'fail' THEN 'ask' ELSE 'continue' END AS decision,
  sha256(parts[step_index + 2]) AS evidence_sha256, CAST(n_calls - step_index - 1 AS INT) AS n_remaining_steps FROM u""")
def critic_rows(spark, sf_dir):
    rows = training.router_critic(A.rollouts(spark, sf_dir))
    return rows.select("rollout_id", "branch_index", "step_index", "record_id", "decision", F.sha2("evidence", 256).alias("evidence_sha256"), "n_remaining_steps")


def _contains(text: str, parts) -> str:
    return "(" + " OR ".join(f"contains({text}, '{x}')" for x in parts) + ")"


_TAGS = ", ".join(
    [f"CASE WHEN contains(tool, '{k}') THEN '{v}' END" for k, v in capability.TOOL_TAGS.items()]
    + [
        "CASE WHEN tool <> '' THEN 'tool_selection' END",
        """CASE WHEN tool <> '' AND NOT ends_with(content, '"arguments": {}}') THEN 'argument_generation' END""",
        f"CASE WHEN role = 'agent' AND tool = '' AND {_contains('lower(content)', capability.PLANNING)} THEN 'planning' END",
        f"CASE WHEN role = 'agent' AND tool = '' AND {_contains('lower(content)', capability.INSUFFICIENT)} THEN 'insufficient_context_detection' END",
        f"CASE WHEN role = 'environment' AND {_contains('content', capability.ERRORS)} THEN 'recovery_after_error' END",
        "CASE WHEN role = 'agent' AND step_index > 0 THEN 'state_tracking' END",
    ]
)
_GAPS = _ROLLOUTS + f""", steps AS (SELECT rollout_id, branch_index, n_calls, final_answer, tools, unnest(range(2 * n_calls + 1)) AS step_index FROM r),
of_step AS (SELECT rollout_id, branch_index, step_index, CASE WHEN step_index % 2 = 0 THEN 'agent' ELSE 'environment' END AS role, step_index = 2 * n_calls AS done, final_answer, tools[step_index // 2 + 1] AS c FROM steps),
shown AS (SELECT *, CASE WHEN NOT done AND role = 'agent' THEN lower(c.tool_name) ELSE '' END AS tool,
  CASE WHEN done THEN final_answer WHEN role = 'agent' THEN concat('{{"name": "', c.tool_name, '", "arguments": ', c.arguments, '}}') ELSE coalesce(c.result, c.error) END AS content FROM of_step),
tagged AS (SELECT rollout_id, branch_index, step_index, list_filter([{_TAGS}], lambda v: v IS NOT NULL) AS tags FROM shown),
of_branch AS (SELECT rollout_id, branch_index, list_distinct(flatten(list(tags))) AS tags FROM tagged GROUP BY ALL),
placed AS (SELECT rollout_id, branch_index, objective_score, objective_status, n_calls, tags, row_number() OVER (PARTITION BY rollout_id, objective_score ORDER BY total_score DESC, branch_index) AS place FROM r JOIN of_branch USING (rollout_id, branch_index)),
diffs AS (SELECT f.rollout_id, p.branch_index AS passing_branch, f.branch_index AS failing_branch, f.objective_status, f.n_calls, list_sort(list_filter(p.tags, lambda v: NOT list_contains(f.tags, v))) AS diff
  FROM placed p JOIN placed f ON p.rollout_id = f.rollout_id AND p.objective_score = 1 AND p.place = 1 AND f.objective_score = 0),
hits AS (SELECT g.rollout_id, failing_branch, arg_min(concat(g.rollout_id, '/', passing_branch, '/', step_index), step_index) AS ref FROM diffs g JOIN tagged t ON t.rollout_id = g.rollout_id AND t.branch_index = passing_branch AND list_has_any(t.tags, diff) GROUP BY ALL),
gaps AS (SELECT rollout_id, passing_branch, failing_branch, array_to_string(diff, ',') AS tag_diff, coalesce(list_filter({list(capability.FAILURES)}, lambda v: list_contains(diff, v))[1], 'unknown') AS failure_class,
  CASE WHEN objective_status IN ('pass', 'fail') THEN 'dpo_pair' ELSE 'sft_targeted' END AS suggested_training_type, ref AS positive_step_ref, round(greatest(-0.1, -0.01 * greatest(0, n_calls - 1)), 6)::DOUBLE AS reward_cost
  FROM diffs g JOIN hits USING (rollout_id, failing_branch) WHERE len(diff) > 0)
"""


@query(_GAPS + "SELECT * FROM gaps")
def capability_gaps(spark, sf_dir):
    return rounded(capability.gaps(A.rollouts(spark, sf_dir)))


@query(_GAPS + "SELECT failure_class, suggested_training_type, count(*) AS n FROM gaps GROUP BY ALL")
def capability_gap_summary(spark, sf_dir):
    return capability.gap_summary(A.rollouts(spark, sf_dir))


# ---- compliance runs ---------------------------------------------------------------------------

_RUNS = f"WITH r AS ({A.RUNS}), l AS (SELECT task_id, model, mode, arg_max(final_pass, seq) AS p, arg_max(artifact, seq) AS artifact, arg_max(repair_rounds, seq) AS repair_rounds FROM r GROUP BY ALL)"


@query(_RUNS + """, w AS (SELECT task_id, model, bool_or(p) FILTER (mode = 'direct') AS d, bool_or(p) FILTER (mode = 'prompt_retry') AS r, bool_or(p) FILTER (mode = 'full_pcl') AS f FROM l GROUP BY ALL HAVING count(*) = 3)
SELECT count(*) AS tasks_with_all_3_modes, count(*) FILTER (WHERE f AND NOT d) AS pcl_beats_direct, count(*) FILTER (WHERE f AND NOT r) AS pcl_beats_retry, count(*) FILTER (WHERE r AND NOT f) AS retry_beats_pcl, count(*) FILTER (WHERE d AND NOT r AND NOT f) AS direct_beats_retry,
  count(*) FILTER (WHERE d AND r AND f) AS all_pass_no_signal, count(*) FILTER (WHERE NOT d AND NOT r AND NOT f) AS all_fail_no_signal, count(*) FILTER (WHERE f AND NOT d AND NOT r) AS only_pcl_passes FROM w""")
def mode_summary(spark, sf_dir):
    return training.cross_mode_summary(A.compliance(spark, sf_dir), "seq")


@query(_RUNS + """SELECT w.task_id, w.model, w.mode AS chosen_mode, x.mode AS rejected_mode, w.artifact AS chosen, x.artifact AS rejected, CASE WHEN w.repair_rounds > 0 THEN 'recovery' ELSE 'default' END AS loss_weight_tokens, substr(sha256(w.artifact), 1, 16) AS n_gram_hash
FROM l w JOIN l x USING (task_id, model) WHERE w.p AND NOT x.p""")
def mode_preferences(spark, sf_dir):
    return training.cross_mode_dpo(A.compliance(spark, sf_dir), "seq").select("task_id", "model", "chosen_mode", "rejected_mode", "chosen", "rejected", "loss_weight_tokens", "n_gram_hash")


# ---- evaluation --------------------------------------------------------------------------------

_WILSON = "CASE WHEN {n} > 0 THEN round({f}, 6) ELSE {e} END"


def _bound(k: str, n: str, sign: str, z: float = 1.96) -> str:
    p, edge = f"({k} / {n})", "greatest(0.0, " if sign == "-" else "least(1.0, "
    body = f"{edge}(({p} + {z * z} / (2 * {n})) {sign} {z} * sqrt({p} * (1 - {p}) / {n} + {z * z} / (4.0 * {n} * {n}))) / (1 + {z * z} / {n}))"
    return _WILSON.format(n=n, f=body, e="0.0" if sign == "-" else "1.0")


@query(f"""WITH e AS ({A.EVALS}), g AS (SELECT "group", count(*) AS n, count(*) FILTER (WHERE final_pass) AS k, sum(tool_calls_total) AS t, sum(tool_calls_valid) AS v, sum(repair_rounds) AS rr, sum(repair_rounds_ok) AS ro, count(*) FILTER (WHERE has_evidence) AS ev, count(*) FILTER (WHERE escalated) AS es,
  avg(prompt_tokens + generation_tokens + repair_tokens) FILTER (final_pass) AS cost, avg(latency_ms) FILTER (final_pass) AS lat, avg(general_score) AS gs FROM e GROUP BY ALL)
SELECT "group", n, round(k / n, 6) AS taskspec_pass_rate, {_bound('k', 'n', '-')} AS pass_lo, {_bound('k', 'n', '+')} AS pass_hi, round(v / t, 6) AS tool_call_validity, {_bound('v', 't', '-')} AS tool_lo, {_bound('v', 't', '+')} AS tool_hi,
  round(ro / rr, 6) AS repair_success_rate, round(ev / n, 6) AS evidence_sufficiency, round(es / n, 6) AS fallback_rate, round(rr / n, 6) AS avg_repair_rounds, round(cost, 6) AS cost_per_accepted_task, round(lat, 6) AS latency_per_accepted_ms, round(gs, 6) AS general_ability_score FROM g""")
def group_metrics(spark, sf_dir):
    m = metrics.group_metrics(A.evaluations(spark, sf_dir))
    flat = m.withColumns({"pass_lo": F.col("taskspec_pass_ci.lo"), "pass_hi": F.col("taskspec_pass_ci.hi"), "tool_lo": F.col("tool_call_validity_ci.lo"), "tool_hi": F.col("tool_call_validity_ci.hi")})
    return rounded(flat.drop("taskspec_pass_ci", "tool_call_validity_ci"))


_P = "round(least(1.0, 2 * list_sum(list_transform(range(CAST(least(b, c) + 1 AS BIGINT)), lambda k: exp(lgamma(b + c + 1) - lgamma(k + 1) - lgamma(b + c - k + 1) - (b + c) * ln(2))))), 6) AS p"
_Z = stats.quantile_of_normal(0.95)
_PAIRED = f"n, n_a, n_b, b, c, round((n_a - n_b) / n, 6) AS delta, {_bound('n_a', 'n', '-', _Z)} AS a_lo, {_bound('n_a', 'n', '+', _Z)} AS a_hi, {_bound('n_b', 'n', '-', _Z)} AS b_lo, {_bound('n_b', 'n', '+', _Z)} AS b_hi, {_P}"
_COUNTS = "count(*) AS n, count(*) FILTER (WHERE x) AS n_a, count(*) FILTER (WHERE y) AS n_b, count(*) FILTER (WHERE x AND NOT y) AS b, count(*) FILTER (WHERE NOT x AND y) AS c"


@query(f"WITH g AS (SELECT {_COUNTS} FROM (SELECT quality = 1 AS x, toxic = 0 AS y FROM labels)) SELECT {_PAIRED} FROM g")
def paired_labels(spark, sf_dir):
    rows = table(spark, sf_dir, "labels")
    return rounded(metrics.discordance(rows, F.col("quality") == 1, F.col("toxic") == 0))


_LAST = f"""WITH e AS ({A.EVALS}), l AS (SELECT "group", task_id, arg_max(final_pass, seq) AS p FROM e GROUP BY ALL)"""


@query(_LAST + f""", g AS (SELECT o."group", {_COUNTS.replace('x', 'r.p').replace('y', 'o.p')} FROM l o JOIN l r USING (task_id) WHERE r."group" = '1' AND o."group" <> '1' GROUP BY o."group") SELECT "group", {_PAIRED} FROM g""")
def against_reference(spark, sf_dir):
    e = A.evaluations(spark, sf_dir)
    last = e.groupBy("group", "task_id").agg(F.max_by("final_pass", "seq").alias("final_pass"))
    return rounded(metrics.against_reference(last, "1"))


@query(f"""WITH e AS ({A.EVALS}) SELECT "group", count(*) FILTER (WHERE final_pass) AS n_pass, count(*) AS n FROM e GROUP BY ALL""")
def pass_rates(spark, sf_dir):
    return metrics.pass_rates(A.evaluations(spark, sf_dir), "group")


_FEATURES = f"""WITH e AS ({A.EVALS}), s AS ({A.SPECS}), f AS (SELECT *, CASE WHEN tool_calls_total > 0 THEN tool_calls_valid / tool_calls_total ELSE 1.0 END AS rate,
  CASE WHEN escalated OR repair_rounds > 3 THEN 'need_large_model' WHEN final_pass AND repair_rounds = 0 THEN 'small_model_can_handle' WHEN final_pass OR repair_rounds < 2 THEN 'need_repair' ELSE 'need_large_model' END AS label,
  FROM e JOIN s USING (task_id)), d AS (SELECT *, CASE WHEN escalated THEN 'need_large_model' WHEN repair_rounds > 3 THEN 'need_large_model' WHEN tool_calls_total > 0 AND rate < 0.8 THEN 'need_repair' WHEN n_hard > 10 THEN 'need_large_model'
  WHEN latency_ms > 30000 THEN 'need_large_model' WHEN repair_rounds > 0 THEN 'need_repair' ELSE 'small_model_can_handle' END AS predicted FROM f)"""


def _routed(spark, sf_dir):
    rows = router.features(A.evaluations(spark, sf_dir), A.specs(spark, sf_dir))
    decided = router.decide()
    return rows.withColumn("predicted", decided["label"]).withColumn("reason", decided["reason"])


@query(_FEATURES + " SELECT seq, task_id, label, predicted, n_hard AS taskspec_n_hard, round(rate, 6) AS eval_tool_validity_rate, CAST(n_allowed_tools > 0 AS INT) AS taskspec_has_tools FROM d")
def routed_records(spark, sf_dir):
    return rounded(_routed(spark, sf_dir).select("seq", "task_id", "label", "predicted", "taskspec_n_hard", "eval_tool_validity_rate", "taskspec_has_tools"))


@query(_FEATURES + ", l AS (SELECT unnest(['small_model_can_handle', 'need_repair', 'need_large_model', 'need_human_review']) AS label) SELECT l.label, " + ", ".join(f"count(*) FILTER (WHERE predicted = '{x}') AS {x}" for x in ("small_model_can_handle", "need_repair", "need_large_model", "need_human_review")) + " FROM l LEFT JOIN d USING (label) GROUP BY l.label")
def routing_confusion(spark, sf_dir):
    return router.confusion(_routed(spark, sf_dir))


@query(_FEATURES + ", l AS (SELECT unnest(['small_model_can_handle', 'need_repair', 'need_large_model', 'need_human_review']) AS name) SELECT name, count(*) FILTER (WHERE label = name AND predicted = name) AS tp, count(*) FILTER (WHERE label <> name AND predicted = name) AS fp, count(*) FILTER (WHERE label = name AND predicted <> name) AS fn FROM l, d GROUP BY name")
def routing_by_label(spark, sf_dir):
    return router.per_label(_routed(spark, sf_dir))


# ---- evidence ----------------------------------------------------------------------------------

_EVIDENCE = f"""WITH a AS ({A.ACTIONS}), c AS (SELECT run, count(*) AS n, count(*) FILTER (WHERE state_changing) AS sc, count(*) FILTER (WHERE state_changing AND has_digest) AS sd, count(*) FILTER (WHERE state_changing AND (has_digest OR has_refs)) AS se, count(*) FILTER (WHERE denied) AS dn, count(*) FILTER (WHERE passed) AS ps FROM a GROUP BY run),
e AS (SELECT CAST(o_orderkey AS STRING) AS run_id, o_orderkey AS o, o_custkey AS subject_id, coalesce(n, 0) AS n, coalesce(sc, 0) AS sc, coalesce(sd, 0) AS sd, coalesce(se, 0) AS se, coalesce(dn, 0) AS dn, coalesce(ps, 0) AS ps FROM orders LEFT JOIN c ON run = o_orderkey),
ad AS (SELECT *, CASE WHEN sc > 0 THEN sd / sc ELSE 1.0 END AS ec, CASE WHEN n > 0 OR sc = 0 THEN 1.0 ELSE 0.5 END AS pc, least(1.0, n * 0.5) AS vs, CASE WHEN o % 3 <> 0 AND o % 5 <> 0 THEN 1.0 ELSE 0.5 END AS pr, CASE WHEN o % 4 <> 0 THEN 1.0 ELSE 0.7 END AS cr FROM e),
sc AS (SELECT *, least(1.0, 0.2 + ec * 0.25 + pc * 0.2 + vs * 0.15 + pr * 0.1 + cr * 0.1 + CASE o % 6 WHEN 0 THEN 0.05 WHEN 1 THEN 0.02 ELSE 0 END) AS score FROM ad),
adm AS (SELECT *, CASE WHEN score < 0.4 THEN 'reject' WHEN score < 0.6 THEN 'audit_only' WHEN ps > 0 AND ec >= 0.8 THEN 'train_sft' ELSE 'train_router' END AS category FROM sc),
td AS (SELECT *, CASE WHEN sc > 0 THEN se / sc END AS d1, CASE WHEN n > 0 THEN 1 - dn / n END AS d2, CASE WHEN n > 0 THEN ps / n END AS d3,
  1 - (CASE WHEN o % 2 = 0 AND o % 150 > 100 THEN 1 ELSE 0 END + CASE WHEN o % 5 > 3 THEN 1 ELSE 0 END) / (CASE WHEN o % 2 = 0 THEN 2 ELSE 1 END) AS d4 FROM e),
tr AS (SELECT *, list_filter([d1, d2, d3, d4, 0.5], lambda x: x IS NOT NULL) AS ds FROM td),
ts AS (SELECT *, CASE WHEN list_min(ds) <= 0 THEN 0.0 ELSE exp(list_sum(list_transform(ds, lambda x: ln(x))) / len(ds)) END AS overall FROM tr)"""


@query(_EVIDENCE + " SELECT run_id, round(score, 4) AS score, category, round(ec, 6) AS evidence_completeness, pr AS provenance FROM adm")
def admission_scores(spark, sf_dir):
    rows = trust.admission(A.evidence(spark, sf_dir))
    return rows.select("run_id", "score", "category", F.round("evidence_completeness", 6).alias("evidence_completeness"), "provenance")


@query(_EVIDENCE + ", l AS (SELECT unnest(['train_sft', 'train_dpo', 'train_repair', 'train_router', 'audit_only', 'reject']) AS category) SELECT category, count(run_id) AS n FROM l LEFT JOIN adm USING (category) GROUP BY category")
def admission_categories(spark, sf_dir):
    return trust.admission_summary(A.evidence(spark, sf_dir)).select("category", "n")


@query(_EVIDENCE + """ SELECT run_id, round(d1, 6) AS evidence_completeness, round(d2, 6) AS policy_compliance, round(d3, 6) AS verifier_agreement, round(d4, 6) AS budget_compliance, round(overall, 6) AS overall, len(ds) AS known,
  CASE WHEN overall >= 0.75 AND len(ds) >= 4 THEN 'B' WHEN overall >= 0.6 THEN 'C' WHEN overall >= 0.4 THEN 'D' ELSE 'F' END AS grade FROM ts""")
def trust_scores(spark, sf_dir):
    return rounded(trust.trust(A.evidence(spark, sf_dir)).drop("supply_chain_integrity"))


@query(_EVIDENCE + """, k AS (SELECT subject_id, overall, row_number() OVER w AS k, count(*) OVER (PARTITION BY subject_id) AS m FROM ts WINDOW w AS (PARTITION BY subject_id ORDER BY o))
SELECT subject_id, count(*) AS n_records, round(CASE WHEN min(overall) > 0 THEN exp(avg(ln(CASE WHEN overall > 0 THEN overall END))) ELSE 0.0 END, 6) AS overall, round(avg(overall), 6) AS mean, round(stddev_samp(overall), 6) AS std_dev, round(min(overall), 6) AS min_score, round(max(overall), 6) AS max_score,
  CASE WHEN count(*) >= 4 THEN round(abs(avg(overall) FILTER (k > m // 2) - avg(overall) FILTER (k <= m // 2)), 6) END AS drift FROM k GROUP BY subject_id""")
def subject_trust(spark, sf_dir):
    return rounded(trust.by_subject(A.evidence(spark, sf_dir), "subject_id", "seq"))


@query(_EVIDENCE + """, q AS (SELECT *, CASE WHEN sc > 0 THEN se / sc ELSE 1.0 END AS cov, 9 - CASE WHEN o % 5 = 0 THEN 1 ELSE 0 END - CASE WHEN o % 3 = 0 THEN 1 ELSE 0 END - CASE WHEN o % 4 = 0 THEN 1 ELSE 0 END AS present FROM e),
h AS (SELECT run_id, present / 9 * 0.4 + CASE WHEN n > 0 THEN 0.3 ELSE 0 END + cov * 0.3 AS health, greatest(0.0, 1 - (CASE WHEN n > 0 THEN dn / n ELSE 0 END * 0.6 + (1 - cov) * 0.4)) AS risk,
  CASE WHEN n > 0 THEN ps / n ELSE 0.5 END * 0.45 + cov * 0.3 + (CASE WHEN o % 3 <> 0 THEN 0.5 ELSE 0 END + CASE WHEN o % 4 <> 0 THEN 0.5 ELSE 0 END) * 0.25 AS eligible FROM q)
SELECT run_id, round(health, 6) AS evidence_health, round(risk, 6) AS policy_risk, round(eligible, 6) AS training_eligibility, round(health * 0.35 + risk * 0.35 + eligible * 0.3, 6) AS composite FROM h""")
def calibrated_scores(spark, sf_dir):
    return rounded(trust.calibrated(A.evidence(spark, sf_dir)).drop("label"))


@query(f"""WITH a AS ({A.ACTIONS}), v AS (SELECT concat('v', verifier) AS verifier_id, count(*) AS total, count(*) FILTER (WHERE passed) / count(*) AS rate, count(*) FILTER (WHERE NOT has_refs) AS bare, verifier FROM a WHERE run IN (SELECT o_orderkey FROM orders) GROUP BY ALL)
SELECT verifier_id, total, round(rate, 6) AS pass_rate, concat_ws(',', CASE WHEN rate > 0.95 AND total >= 10 THEN 'high_pass_rate' END, CASE WHEN verifier = 1 THEN 'no_score_signal' ELSE 'binary_score_only' END, CASE WHEN rate < 0.05 AND total >= 10 THEN 'low_pass_rate' END, CASE WHEN bare > total * 0.5 THEN 'missing_claim_ids' END) AS findings,
  CASE WHEN rate > 0.95 AND total >= 10 THEN 0.85 ELSE 1.0 END AS strength FROM v""")
def verifier_audit(spark, sf_dir):
    return rounded(quality.verifier_audit(A.evidence(spark, sf_dir)))


@query(f"""WITH a AS ({A.ACTIONS}), n AS (SELECT run, count(*) AS n, count(*) FILTER (state_changing) AS calls, count(*) FILTER (denied) AS m, count(DISTINCT CASE WHEN denied THEN verifier END) AS bad FROM a GROUP BY run)
SELECT CAST(o_orderkey AS STRING) AS run_id, CAST(coalesce(n, 0) AS INT) AS n_actions, CAST(coalesce(m, 0) AS INT) AS n_mismatches, CAST(coalesce(n - bad, 0) AS INT) AS n_matched, CAST(coalesce(calls, 0) AS INT) AS side_effect_calls, CASE WHEN n > 0 THEN round((n - bad) / n, 6) ELSE 1.0 END AS determinism_score
FROM orders LEFT JOIN n ON run = o_orderkey""")
def replayed_runs(spark, sf_dir):
    """Runs some of whose actions record a state that no replay reaches; an id that recurs is mismatched once."""
    rows = replay.replay(A.replayable(spark, sf_dir))
    return rounded(rows.select("run_id", "n_actions", F.size("mismatches").alias("n_mismatches"), "n_matched", "side_effect_calls", "determinism_score"))


@query(f"""WITH a AS ({A.ACTIONS}), d AS (SELECT run, count(*) AS n, count(*) FILTER (state_changing) AS ok, count(*) FILTER (denied) AS dn, count(*) FILTER (NOT passed) AS f FROM a GROUP BY run)
SELECT CAST(o_orderkey AS STRING) AS run_id, coalesce(CAST(n AS INT), 0) AS eval_tool_calls_total, coalesce(CAST(ok AS INT), 0) AS eval_tool_calls_valid, coalesce(CAST(f AS INT), 0) AS eval_violation_count, CASE WHEN n > 0 THEN round(ok / n, 6) ELSE 1.0 END AS eval_tool_validity_rate,
  CASE WHEN dn >= 2 THEN 'need_human_review' WHEN dn = 1 THEN 'need_large_model' WHEN f > 0 THEN 'need_repair' ELSE 'small_model_can_handle' END AS label FROM orders LEFT JOIN d ON run = o_orderkey""")
def evidence_labels(spark, sf_dir):
    rows = router.evidence_features(A.evidence(spark, sf_dir))
    return rounded(rows.select("run_id", "eval_tool_calls_total", "eval_tool_calls_valid", "eval_violation_count", "eval_tool_validity_rate", "label"))


@query("""WITH l AS (SELECT CAST(o_orderkey AS STRING) AS id, substr(o_orderpriority, 1, 1) AS label FROM orders),
f AS (SELECT label, (row_number() OVER (PARTITION BY label ORDER BY md5(id), id) - 1) % 5 AS fold FROM l) SELECT label, CAST(fold AS INT) AS fold, count(*) AS n FROM f GROUP BY ALL""")
def router_folds(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("task_id"), F.substring("o_orderpriority", 1, 1).alias("label"))
    return boosting.dealt(rows, "label", "task_id").groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n"))


@query()
def router_confusion(spark, sf_dir):
    """Boosted routers of five folds and of all rows over what is known of evidence records, by true and predicted label (tests/test_boosting.py has the plain loop)."""
    rows = router.evidence_features(A.evidence(spark, sf_dir)).withColumnRenamed("run_id", "task_id")
    model, binned = boosting.fit(boosting.dealt(rows, "label", "task_id"), ["eval_tool_calls_total", "eval_tool_calls_valid", "eval_tool_validity_rate"], settings=boosting.Settings(rounds=10, depth=3, rate=0.3))
    return boosting.confusion(model, binned)


@query("""WITH r AS (SELECT md5(concat('shard-', s, '-vnode-', v)) AS h, CAST(s AS INT) AS s FROM range(16) a(s), range(150) b(v)), k AS (SELECT o_custkey, md5(CAST(o_custkey AS STRING)) AS h, count(*) AS n, count(*) FILTER (o_orderkey % 11 = 0 OR o_orderkey % 13 = 0) AS bad FROM orders GROUP BY ALL),
f AS (SELECT coalesce((SELECT arg_min(r.s, r.h) FROM r WHERE r.h >= k.h), (SELECT arg_min(s, h) FROM r)) AS shard, n, bad FROM k) SELECT shard, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n - bad) AS BIGINT) AS n_valid, CAST(sum(bad) AS BIGINT) AS n_invalid FROM f GROUP BY shard""")
def ingested_shards(spark, sf_dir):
    """Every eleventh record is of an unknown version, and every thirteenth has no time."""
    rows = A.evidence(spark, sf_dir).withColumns({"user_id": F.lit(None).cast("string"), "run_context": F.expr("cast(null as struct<user_id:string,subject_id:string,run_id:string>)")})
    o = F.col("seq")
    broken = rows.withColumns({"schema_version": F.when(o % 11 == 0, "aep/v9").otherwise(F.col("schema_version")), "created_at_ms": F.when(o % 13 != 0, F.col("created_at_ms"))})
    return ingestion.ingested(ingestion.ingest(broken))


@query(f"""WITH a AS ({A.ACTIONS}), p AS (SELECT run, bool_or(has_digest) AS x FROM a GROUP BY run), t AS (SELECT count(*) AS n, count(*) FILTER (o_orderkey % 4 <> 0) AS m, count(*) FILTER (o_orderkey % 3 <> 0) AS c, count(run) AS d, count(*) FILTER (x) AS x FROM orders LEFT JOIN p ON run = o_orderkey),
u AS (SELECT n, unnest([{', '.join(f"{{'control': '{c}', 'present': {v}}}" for c, v in (('OWASP-MCP-01', 'm'), ('OWASP-MCP-02', 'd'), ('OWASP-MCP-03', 'm'), ('OWASP-MCP-05', '0'), ('OWASP-MCP-07', 'c'), ('OTel-GenAI', '0'), ('AEP-Provenance', 'x')))}]) AS y FROM t)
SELECT y.control AS control, y.present AS present, n, round(y.present / n * 100, 6) AS percent, CASE WHEN y.present / n >= 0.5 THEN 'covered' WHEN y.present > 0 THEN 'partial' ELSE 'gap' END AS status FROM u""")
def standards_coverage(spark, sf_dir):
    return rounded(reports.standards(A.evidence(spark, sf_dir)).select("control", "present", "n", "percent", "status"))


@query("""WITH b AS (SELECT event_type AS t, count(*) AS n, CAST(sum(length(props)) AS BIGINT) AS y, count(DISTINCT user_id) AS u FROM events WHERE event_id % 2 = 0 GROUP BY ALL),
h AS (SELECT event_type AS t, count(*) FILTER (CAST(ts AS DATE) = DATE '2024-01-03') AS n, CAST(sum(length(props)) AS BIGINT) AS y, count(DISTINCT user_id) AS u FROM events WHERE event_id % 2 = 1 GROUP BY ALL),
f AS (SELECT event_type AS t, count(DISTINCT user_id) AS u FROM events e WHERE event_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM events o WHERE o.event_id % 2 = 1 AND o.event_type = e.event_type AND o.user_id = e.user_id) GROUP BY ALL)
SELECT b.t AS tenant_id, b.n AS n_records, b.y AS n_bytes, coalesce(f.u, 0) AS n_new, coalesce(h.n, 0) AS has_records, coalesce(h.y, 0) AS has_bytes, coalesce(h.u, 0) AS has_subjects,
  CASE WHEN b.t = 'click' AND coalesce(h.n, 0) + b.n > 10 THEN 'records_per_day' WHEN b.t = 'view' AND coalesce(h.y, 0) + b.y > 100 THEN 'storage_bytes' END AS breach FROM b LEFT JOIN h USING (t) LEFT JOIN f USING (t)""")
def tenant_admission(spark, sf_dir):
    rows = A.events(spark, sf_dir).select(F.col("event_type").alias("tenant_id"), F.col("user_id").cast("string").alias("subject_id"), F.length("props").cast("long").alias("n_bytes"), F.to_date("ts").alias("day"), "event_id")
    quotas = spark.createDataFrame([("click", 10, None, None), ("view", None, 100, None)], "tenant_id string, max_records_per_day long, max_storage_bytes long, max_subjects long")
    out = tenancy.admit(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), quotas, F.lit("2024-01-03").cast("date"))
    return out.select("tenant_id", "n_records", "n_bytes", "n_new", "has_records", "has_bytes", "has_subjects", "breach")


@query("SELECT arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS checkpoint_id, substr(o_orderpriority, 1, 1) AS mode FROM orders WHERE substr(o_orderpriority, 1, 1) = '2' GROUP BY ALL")
def latest_checkpoint(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("checkpoint_id"), F.substring("o_orderpriority", 1, 1).alias("mode"), F.col("o_totalprice").alias("created_at_ms"))
    return registry.latest(rows, "2").select("checkpoint_id", "mode")


@query(f"""WITH e AS ({A.EVALS}), g AS (SELECT "group" AS model_id, count(*) FILTER (WHERE final_pass) AS pass_count, count(*) AS n_trials FROM e GROUP BY ALL) SELECT model_id, pass_count, n_trials, round(pass_count / n_trials, 6) AS pass_rate, {_bound('pass_count', 'n_trials', '-', _Z)} AS ci_lower, {_bound('pass_count', 'n_trials', '+', _Z)} AS ci_upper FROM g""")
def benchmark_intervals(spark, sf_dir):
    counts = metrics.pass_rates(A.evaluations(spark, sf_dir), "group").select(F.col("group").alias("model_id"), F.col("n_pass").alias("pass_count"), F.col("n").alias("n_trials"))
    return rounded(reports.benchmark_intervals(counts).select("model_id", "pass_count", "n_trials", "pass_rate", "ci_lower", "ci_upper"))


# ---- events: streams, tenants, storage ---------------------------------------------------------


def checked_events(rows: DataFrame) -> DataFrame:
    """Events as the stateless part of compliance feedback."""
    return rows.select(
        F.col("user_id").cast("string").alias("subject"),
        F.col("event_id").cast("string").alias("run_id"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", "objective_score_in_range").alias("hard"),
        F.when((F.col("event_type") != "error") & (F.col("value") > 150), "evidence_complete").alias("soft"),
    )


@query("""WITH e AS (SELECT CAST(user_id AS STRING) AS subject, CAST(event_id AS STRING) AS run_id, event_id AS seq, CASE WHEN event_type = 'error' THEN 'objective_score_in_range' END AS hard, CASE WHEN event_type <> 'error' AND value > 150 THEN 'evidence_complete' END AS soft FROM events),
w AS (SELECT *, CAST(sum(CASE WHEN hard IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY subject ORDER BY seq) AS BIGINT) AS n_hard FROM e)
SELECT *, CASE WHEN hard IS NOT NULL THEN 'reject' WHEN soft IS NOT NULL OR n_hard > 3 THEN 'quarantine' ELSE 'pass' END AS verdict FROM w""")
def compliance_feedback(spark, sf_dir):
    return compliance.batch(checked_events(A.events(spark, sf_dir)), 3)


@query("SELECT event_type, list_sort(list(value))[CAST(round_even(0.99 * (count(*) - 1), 0) AS BIGINT) + 1] AS p99, list_sort(list(value))[CAST(round_even(0.5 * (count(*) - 1), 0) AS BIGINT) + 1] AS p50 FROM events GROUP BY event_type")
def latency_quantiles(spark, sf_dir):
    return metrics.nearest_rank(A.events(spark, sf_dir), ["event_type"], "value", {"p99": 0.99, "p50": 0.5}).select("event_type", "p99", "p50")


@query("""WITH q AS (SELECT event_type, list_sort(list(value)) AS v, count(*) AS n, least(ceil((count(*) + 1) * 0.9) / count(*), 1.0) * (count(*) - 1) AS h FROM events GROUP BY event_type)
SELECT event_type, n, round(v[CAST(floor(h) AS BIGINT) + 1] + (v[CAST(ceil(h) AS BIGINT) + 1] - v[CAST(floor(h) AS BIGINT) + 1]) * (h - floor(h)), 6) AS quantile FROM q""")
def conformal_widths(spark, sf_dir):
    return rounded(stats.conformal(A.events(spark, sf_dir), "event_type", "value").select("event_type", "n", "quantile"))


@query("""WITH r AS (SELECT md5(concat('shard-', s, '-vnode-', v)) AS h, CAST(s AS INT) AS s FROM range(16) a(s), range(150) b(v)), k AS (SELECT user_id, md5(CAST(user_id AS STRING)) AS h, count(*) AS n FROM events GROUP BY ALL),
f AS (SELECT user_id, n, (SELECT arg_min(r.s, r.h) FROM r WHERE r.h >= k.h) AS s FROM k) SELECT user_id, coalesce(s, (SELECT arg_min(s, h) FROM r)) AS shard, n FROM f""")
def sharded_users(spark, sf_dir):
    rows = A.events(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", routing.shard_of(F.col("user_id").cast("string")).alias("shard"), "n")


@query("""WITH RECURSIVE e AS (SELECT event_id, event_type, CAST(ts AS DATE) AS day, CAST(floor(value) AS BIGINT) + length(props) AS size, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS k FROM events),
w AS (SELECT event_type, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS DATE) AS day, CAST(0 AS BIGINT) AS records_today, CAST(0 AS BIGINT) AS storage_bytes, CAST(NULL AS STRING) AS breach FROM (SELECT DISTINCT event_type FROM e)
UNION ALL SELECT event_type, k, event_id, day, r + (b IS NULL)::INT, s + CASE WHEN b IS NULL THEN size ELSE 0 END, b FROM (
  SELECT *, CASE WHEN r + 1 > 20 THEN 'records_per_day' WHEN s + size > 12000 THEN 'storage_bytes' END AS b FROM (
    SELECT e.event_type, e.k, e.event_id, e.day, e.size, CASE WHEN w.day = e.day THEN w.records_today ELSE 0 END AS r, w.storage_bytes AS s FROM w JOIN e ON e.event_type = w.event_type AND e.k = w.k + 1)))
SELECT event_id, event_type, records_today, storage_bytes, breach FROM w WHERE k > 0""")
def tenant_quota(spark, sf_dir):
    rows = A.events(spark, sf_dir)
    out = quota.within_quota(rows, "event_type", F.to_date("ts"), "event_id", F.floor("value") + F.length("props"), 20, 12_000)
    return out.select("event_id", "event_type", "records_today", "storage_bytes", "breach")


@query("SELECT CAST(user_id AS STRING) AS p_key, strftime(ts, '%Y-%m-%d') AS dt, count(*) AS n FROM events GROUP BY ALL")
def storage_partitions(spark, sf_dir):
    rows = storage.partitioned(A.events(spark, sf_dir), F.col("ts"), "day", "user_id")
    return rows.groupBy("p_key", "dt").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH p AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') AS dt FROM events), a AS (SELECT dt, CAST(date_diff('day', CAST(dt AS DATE), DATE '2024-02-01') AS DOUBLE) AS age_days FROM p)
SELECT dt, age_days, CASE WHEN age_days >= 25 THEN 'delete' WHEN age_days >= 10 THEN 'migrate' ELSE 'keep' END AS action FROM a""")
def retention_plan(spark, sf_dir):
    days = A.events(spark, sf_dir).select(times.bucket(F.col("ts")).alias("dt")).distinct()
    return routing.retention(days, "dt", F.lit("2024-02-01").cast("timestamp"), 10, 25).select("dt", "age_days", "action")


@query("""WITH l AS (SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS seq FROM events GROUP BY user_id) SELECT user_id, event_type, seq FROM l WHERE event_type <> 'error'""")
def registry_entries(spark, sf_dir):
    log = A.events(spark, sf_dir).select("user_id", F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "remove").otherwise("register").alias("event"), "event_type")
    return lineage.current(log, "user_id").select("user_id", "event_type", "seq")


@query("""WITH RECURSIVE n AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey // 2 END AS p FROM customer), w AS (SELECT id, id AS cur, 0 AS depth FROM n
UNION ALL SELECT w.id, n.p, w.depth + 1 FROM w JOIN n ON n.id = w.cur WHERE n.p IS NOT NULL AND n.p IN (SELECT id FROM n))
SELECT id, arg_max(cur, depth) AS root, max(depth) AS depth FROM w GROUP BY id""")
def checkpoint_lineage(spark, sf_dir):
    nodes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 7 != 0, F.floor(F.col("c_custkey") / 2)).alias("parent"))
    return lineage.roots(nodes, "id", "parent").select("id", "root", "depth")


@query()
def bootstrap_labels(spark, sf_dir):
    """Seeded resampling of a bounded comparison, 10,000 draws: the labels of each five hundred document ids."""
    rows = table(spark, sf_dir, "labels").select(F.floor(F.col("doc_id") / 500).alias("block"), "doc_id", (F.col("quality") == 1).alias("a"), (F.col("toxic") == 0).alias("b"))
    return stats.paired_bootstrap(rows, "block", "doc_id", "a", "b")


@query("SELECT event_id AS id, CAST(0 AS BIGINT) AS root, CAST(event_id AS INT) AS depth FROM events")
def long_lineage(spark, sf_dir):
    """A chain of all events, each the child of the one before."""
    nodes = A.events(spark, sf_dir).select(F.col("event_id").alias("id"), F.when(F.col("event_id") > 0, F.col("event_id") - 1).alias("parent"))
    return lineage.roots(nodes, "id", "parent").select("id", "root", F.col("depth").cast("int").alias("depth"))
