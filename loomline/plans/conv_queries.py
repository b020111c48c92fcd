"""Queries over conversations: forms, fingerprints, identities, texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import conv, identity
from loomline.functions import text as X
from loomline.functions.session import table
from loomline.operators import dedup, prompts
from loomline.sources import parquet

ROW = ("source_file", "source_row_index")


def _sources(spark: SparkSession, d: str, **cols) -> DataFrame:
    """One row per physical source row: its coordinates and the given expressions; whole conversations are not shuffled."""
    return table(spark, d, "source_trajectories").select(*ROW, *[c.alias(n) for n, c in cols.items()]).distinct()


def conv_structural_filter(spark, d):
    rows = _sources(spark, d, n_turns=F.size(F.col("conversations")), n_chars=F.length(conv.joined(F.col("conversations"), by=" ")), ok=conv.is_structural(F.col("conversations")))
    return rows.where("ok").drop("ok")


def conv_problem_counts(spark, d):
    rows = _sources(spark, d, strict=F.coalesce(conv.problem(F.col("conversations")), F.lit("none")), lenient=F.coalesce(conv.problem(F.col("conversations"), blank_ok=True, any_final=True, least=1, most=None), F.lit("none")))
    return rows.groupBy("strict", "lenient").agg(F.count("*").alias("n"))


def conv_canonical_fingerprint(spark, d):
    return _sources(spark, d, fingerprint=conv.fingerprint(F.col("conversations")))


def conv_refined_fingerprint_check(spark, d):
    rows = table(spark, d, "refined_rows").select("run_id", conv.fingerprint(F.col("conversations")).alias("fingerprint"), F.lower("refined_conversation_fingerprint").alias("stored"))
    return rows.distinct().select("run_id", "fingerprint", F.coalesce(F.col("fingerprint") == F.col("stored"), F.lit(False)).alias("matches"))


def conv_legacy_fingerprint_dedup(spark, d):
    rows = _sources(spark, d, task=F.col("task"), fingerprint=conv.legacy_fingerprint(F.col("conversations")), ok=conv.is_structural(F.col("conversations"))).where("ok").drop("ok")
    return dedup.keep_first(rows, ["task", "fingerprint"], list(ROW))


def conv_role_profile(spark, d):
    rows = _sources(spark, d, letters=conv.role_letters(F.col("conversations")))
    return rows.groupBy("letters").agg(F.count("*").alias("n"))


def conv_instruction_extract(spark, d):
    return _sources(spark, d, instruction=conv.instruction(F.col("conversations")))


def task_table(spark, d):
    """The first row of each task in file order, with the instruction after the agent."""
    cols = ["agent", "traj_date", "episode", "model", "model_provider", "result", "run_id", "task", "trace_source", "trial_name"]
    rows = table(spark, d, "source_trajectories").select("agent", conv.instruction(F.col("conversations")).alias("instruction"), *cols[1:], *ROW)
    return dedup.keep_first(rows, ["task"], list(ROW)).drop(*ROW)


def source_identity(spark, d):
    rid = identity.source_record_id(F.col("source_file"), F.col("source_row_index"), F.col("trial_name"), F.col("run_id"), F.col("task"), F.col("fingerprint"))
    rows = _sources(spark, d, trial_name=F.col("trial_name"), run_id=F.col("run_id"), task=F.col("task"), fingerprint=conv.fingerprint(F.col("conversations")))
    return rows.select(*ROW, rid.alias("source_record_id"))


def source_coordinates(spark, d):
    """Rows per file as physically read: count and highest row index."""
    rows = parquet.with_coordinates(spark.read.parquet(f"{d}/source_trajectories.parquet").select("run_id", "_metadata"))
    return rows.groupBy("source_file").agg(F.count("*").alias("n"), F.max("source_row_index").alias("last"))


def doc_degenerate_filter(spark, d):
    text = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", text.rlike(X.DEGENERATE).alias("degenerate"), text.rlike(X.REFUSAL).alias("refusal"), text.rlike(X.VAGUE).alias("vague"), text.rlike(X.TRANSIENT).alias("transient"))


def doc_tokens(spark, d):
    text = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", F.size(X.tokens(text)).cast("bigint").alias("n_tokens"), F.size(X.token_sequence(text)).cast("bigint").alias("n_sequence"), F.sha2(F.array_join(F.array_sort(X.tokens(text)), " "), 256).alias("token_hash"))


def doc_anchors(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(X.anchors(F.coalesce("text", F.lit("")))).alias("n_anchors"))


def prompt_refinement(spark, d):
    slots = table(spark, d, "refinement_slots").select("synthetic_id", *ROW, "source_task_id", "refinement_index").distinct()
    src = dedup.keep_first(table(spark, d, "source_trajectories").select(*ROW, "conversations"), list(ROW), [*ROW])
    text = prompts.refinement(F.col("source_task_id"), F.col("refinement_index"), F.col("conversations"))
    return slots.join(src, list(ROW)).select("synthetic_id", F.length(text).alias("n_chars"), F.sha2(text, 256).alias("prompt_hash"))


def prompt_synthesis(spark, d):
    tasks = task_table(spark, d).select("task", "instruction", "model_provider", "agent")
    framing = F.when(F.length("task") % 2 == 0, "Solve this task step by step.")
    place = F.when(F.length("task") % 3 == 0, prompts.first_text(F.lit(" "), F.col("model_provider"), F.col("agent")))
    text = prompts.synthesis(F.col("instruction"), place, framing)
    return tasks.select("task", F.length(text).alias("n_chars"), F.sha2(text, 256).alias("prompt_hash"))


def chat_samples(spark, d):
    from loomline.operators.graph import chat_text

    text = chat_text(F.col("messages"))
    return table(spark, d, "mitre_sft").select("sample_id", F.length(text).alias("n_chars"), F.sha2(text, 256).alias("text_hash")).distinct()


def _esc(x: str) -> str:
    for raw, out in ((r"chr(92)", r"chr(92)||chr(92)"), ("chr(34)", "chr(92)||chr(34)"), ("chr(10)", "'\\n'"), ("chr(13)", "'\\r'"), ("chr(9)", "'\\t'"), ("chr(8)", "'\\b'"), ("chr(12)", "'\\f'")):
        x = f"replace({x}, {raw}, {out})"
    for k in (*range(1, 8), 11, *range(14, 32)):
        x = f"replace({x}, chr({k}), '\\u{k:04x}')"
    return x


_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_STRIP = lambda x: f"regexp_replace(regexp_replace({x}, '^{_WS}+', ''), '{_WS}+$', '')"
_TURN = "'{\"content\":\"' || " + _esc("coalesce(t.content, '')") + " || '\",\"role\":\"' || coalesce(t.role, '') || '\"}'"
FP = f"sha256('[' || array_to_string(list_transform(conversations, lambda t: {_TURN}), ',') || ']')"
_JOIN = "array_to_string(list_transform(conversations, lambda t: coalesce(t.content, '')), ' ')"
_RE = lambda p: p.replace("'", "''")
_OK = f"(len(conversations) BETWEEN 2 AND 40 AND NOT regexp_matches({_JOIN}, '{_RE(X.DEGENERATE)}') AND length({_STRIP(_JOIN)}) >= 50)"
_LEGACY = f"sha256(regexp_replace(array_to_string(list_transform(conversations, lambda t: lower({_STRIP('coalesce(t.content, chr(32))')})), ' '), '{_WS}+', ' ', 'g'))"
_LETTERS = "array_to_string(list_transform(conversations, lambda t: substr(coalesce(t.role, '?'), 1, 1)), '')"
_FIRST = "coalesce(conversations[1].content, '')"
_AT = f"strpos({_FIRST}, 'Task Description:' || chr(10))"
_REST = f"substr({_FIRST}, {_AT} + {len(conv.TASK_MARK)})"
_END = f"strpos({_REST}, chr(10) || chr(10) || 'Current terminal state:')"
_INSTR = f"CASE WHEN len(conversations) > 0 AND conversations[1].role = 'user' AND {_AT} > 0 THEN " + _STRIP(f"(CASE WHEN {_END} > 0 THEN substr({_REST}, 1, {_END} - 1) ELSE {_REST} END)") + " ELSE '' END"
_SRC = lambda cols: f"SELECT DISTINCT source_file, source_row_index, {cols} FROM source_trajectories"
_STOPS = "[" + ",".join(f"'{w}'" for w in X.STOP_WORDS) + "]"
_SEQ = lambda t: f"list_filter(list_transform(regexp_extract_all({t}, '{X.TOKEN}'), lambda x: trim(lower(x), '.,:;')), lambda x: length(x) >= 2)"
_TOKENS = lambda t: f"list_filter(list_distinct(list_transform(regexp_extract_all({t}, '{X.TOKEN}'), lambda x: trim(lower(x), '.,:;'))), lambda x: length(x) >= 3 AND NOT list_contains({_STOPS}, x))"
_BLANK = f"{_STRIP('t.content')} = ''"
_PROBLEM = lambda least, most, blank, final: (
    f"CASE WHEN conversations IS NULL OR len(conversations) < {least}" + (f" OR len(conversations) > {most}" if most else "") + " THEN 'turns' "
    "WHEN len(list_filter(conversations, lambda t: t.role IS NULL OR t.role NOT IN ('system','user','assistant','tool'))) > 0 THEN 'role' "
    "WHEN len(list_filter(conversations, lambda t: t.content IS NULL)) > 0 THEN 'content' "
    + (f"WHEN len(list_filter(conversations, lambda t: {_BLANK})) > 0 THEN 'blank' " if blank else "") + ("WHEN conversations[-1].role != 'assistant' THEN 'final' " if final else "") + "ELSE 'none' END"
)

QUERIES = {f.__name__: f for f in (conv_structural_filter, conv_problem_counts, conv_canonical_fingerprint, conv_refined_fingerprint_check, conv_legacy_fingerprint_dedup, conv_role_profile, conv_instruction_extract, task_table, source_identity, source_coordinates, doc_degenerate_filter, doc_tokens, doc_anchors, prompt_refinement, prompt_synthesis, chat_samples)}
SQL = {
    "conv_structural_filter": f"SELECT source_file, source_row_index, len(conversations) AS n_turns, length({_JOIN}) AS n_chars FROM (SELECT DISTINCT * FROM source_trajectories) WHERE {_OK}",
    "conv_problem_counts": f"SELECT strict, lenient, count(*) AS n FROM ({_SRC(_PROBLEM(2, 40, True, True) + ' AS strict, ' + _PROBLEM(1, None, False, False) + ' AS lenient')}) GROUP BY ALL",
    "conv_canonical_fingerprint": _SRC(f"{FP} AS fingerprint"),
    "conv_refined_fingerprint_check": f"SELECT DISTINCT run_id, {FP} AS fingerprint, coalesce({FP} = lower(refined_conversation_fingerprint), false) AS matches FROM refined_rows",
    "conv_legacy_fingerprint_dedup": f"SELECT source_file, source_row_index, task, fingerprint FROM ({_SRC(f'task, {_LEGACY} AS fingerprint, {_OK} AS ok')}) WHERE ok QUALIFY row_number() OVER (PARTITION BY task, fingerprint ORDER BY source_file, source_row_index) = 1",
    "conv_role_profile": f"SELECT letters, count(*) AS n FROM ({_SRC(f'{_LETTERS} AS letters')}) GROUP BY letters",
    "conv_instruction_extract": _SRC(f"{_INSTR} AS instruction"),
    "task_table": f"SELECT agent, {_INSTR} AS instruction, traj_date, episode, model, model_provider, result, run_id, task, trace_source, trial_name FROM source_trajectories QUALIFY row_number() OVER (PARTITION BY task ORDER BY source_file, source_row_index) = 1",
    "source_identity": "SELECT source_file, source_row_index, 'source-' || substr(sha256('source-row' || chr(0) || source_file || chr(0) || source_row_index || chr(0) || trial_name || chr(0) || run_id || chr(0) || task || chr(0) || fingerprint), 1, 24) AS source_record_id FROM (" + _SRC(f"trial_name, run_id, task, {FP} AS fingerprint") + ")",
    "doc_degenerate_filter": "SELECT doc_id, " + ", ".join(f"regexp_matches(coalesce(text, ''), '{_RE(p)}') AS {n}" for n, p in (("degenerate", X.DEGENERATE), ("refusal", X.REFUSAL), ("vague", X.VAGUE), ("transient", X.TRANSIENT))) + " FROM documents",
    "doc_tokens": f"SELECT doc_id, len({_TOKENS('text')}) AS n_tokens, len({_SEQ('text')}) AS n_sequence, sha256(array_to_string(list_sort({_TOKENS('text')}), ' ')) AS token_hash FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)",
    "prompt_refinement": f"SELECT synthetic_id, length(p) AS n_chars, sha256(p) AS prompt_hash FROM (SELECT synthetic_id, 'Task identifier: ' || source_task_id || chr(10) || 'Refinement index: ' || refinement_index || chr(10) || chr(10) || 'Original conversation JSON:' || chr(10) || ('[' || array_to_string(list_transform(conversations, lambda t: {_TURN}), ',') || ']') || chr(10) || chr(10) || 'Return a refined conversation for the same task.' AS p FROM (SELECT DISTINCT synthetic_id, source_file, source_row_index, source_task_id, refinement_index FROM refinement_slots) JOIN (SELECT DISTINCT source_file, source_row_index, conversations FROM source_trajectories) USING (source_file, source_row_index))",
    "prompt_synthesis": f"SELECT task, length(p) AS n_chars, sha256(p) AS prompt_hash FROM (SELECT task, '## Task' || chr(10) || CASE WHEN length(task) % 2 = 0 THEN 'Solve this task step by step.' || chr(10) || chr(10) ELSE '' END || {_INSTR} || chr(10) || chr(10) || '## Environment' || chr(10) || coalesce(CASE WHEN length(task) % 3 = 0 THEN coalesce(nullif(" + _STRIP("model_provider") + ", ''), nullif(" + _STRIP("agent") + f", '')) END, 'Generic Ubuntu 22.04 container.') || chr(10) || chr(10) || 'Synthesize a complete, realistic agent trajectory that solves this task.' AS p FROM source_trajectories QUALIFY row_number() OVER (PARTITION BY task ORDER BY source_file, source_row_index) = 1)",
    "chat_samples": "SELECT DISTINCT sample_id, length(p) AS n_chars, sha256(p) AS text_hash FROM (SELECT sample_id, array_to_string(list_transform(messages, lambda m: '<|' || coalesce(m.role, '') || '|>' || chr(10) || coalesce(m.content, '')), chr(10)) AS p FROM mitre_sft)",
}
