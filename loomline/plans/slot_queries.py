"""Queries over slots, plans, samples, splits and quality codes."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.functions import conv, identity
from loomline.functions import text as X
from loomline.functions.session import cut, table
from loomline.operators import dedup, quality, slots
from loomline.plans import conv_queries as Q



def _ids(spark, d):
    return cut(Q.source_identity(spark, d).select("source_record_id").distinct())


def _slots(spark, d):
    return table(spark, d, "refinement_slots").select("synthetic_id", "source_record_id", "source_task_id", F.col("refinement_index").cast("int").alias("refinement_index")).distinct()


def slot_secondary_choice(spark, d):
    ids = _ids(spark, d)
    return slots.secondary(ids, "source_record_id", ids.count() * 3 // 2)


def slot_assignment(spark, d):
    ids = _ids(spark, d)
    return slots.assign(ids, "source_record_id", ids.count() * 3 // 2)


def slot_id_check(spark, d):
    want = identity.synthetic_id(F.col("source_record_id"), F.col("refinement_index"))
    return _slots(spark, d).groupBy("refinement_index").agg(F.count("*").alias("n"), F.count_if(want == F.col("synthetic_id")).alias("n_matching"))


def slot_pending_antijoin(spark, d):
    return slots.pending(_slots(spark, d), table(spark, d, "refined_rows").select(F.col("run_id").alias("synthetic_id"))).select("synthetic_id", "source_task_id")


def slot_microbatches(spark, d):
    return slots.micro_batches(_slots(spark, d), ["synthetic_id"], 4).select("synthetic_id", F.col("batch_id").cast("bigint").alias("batch_id"))


def slot_within_budget(spark, d):
    return slots.within_budget(slot_pending_antijoin(spark, d), ["synthetic_id"], 25)


def slot_attempt_seed(spark, d):
    rows = table(spark, d, "attempts").where("synthetic_id IS NOT NULL AND attempt_number IS NOT NULL").select("synthetic_id", "attempt_number").distinct()
    return rows.withColumn("seed", identity.attempt_seed(F.col("synthetic_id"), F.col("attempt_number")))


def batch_prompt_sources(spark, d):
    from loomline.operators.prompts import batch_sources

    rows = table(spark, d, "refinement_slots").select("synthetic_id", "source_record_id", "refinement_index", F.lower("source_conversation_fingerprint").alias("fingerprint")).distinct()
    batches = slots.micro_batches(rows, ["source_record_id", "synthetic_id"], 4)
    return batch_sources(batches).select(F.col("batch_id").cast("bigint").alias("batch_id"), "source_record_id", "fingerprint", "n_requests")


def _tasks(spark, d):
    return table(spark, d, "source_trajectories").select("task").where("task IS NOT NULL").distinct()


def plan_variant_quota(spark, d):
    return slots.quotas(_tasks(spark, d), "task", 1000)


def plan_variants(spark, d):
    plan = slots.variants(slots.quotas(_tasks(spark, d), "task", 1000), "task")
    return plan.select("variant_id", "temperature", "framing", identity.variant_seed(F.col("variant_id")).alias("seed"), identity.task_of_variant(F.col("variant_id")).alias("task"))


def plan_temperatures(spark, d):
    return slots.variants(slots.quotas(_tasks(spark, d), "task", 1000), "task").groupBy("temperature").agg(F.count("*").alias("n"))


def pilot_topk_sample(spark, d):
    return slots.pilot(_ids(spark, d), "source_record_id", 17, 10)


def split_exact_holdout(spark, d):
    return slots.holdout(_ids(spark, d), "source_record_id", 100)


def shuffle_by_hash(spark, d):
    rows = table(spark, d, "mitre_sft").select("sample_id").distinct()
    return slots.numbered(rows.withColumn("h", F.sha2(F.concat_ws("\x00", F.lit("shuffle42"), "sample_id"), 256)), ["h", "sample_id"]).select("sample_id", F.col("position").cast("bigint").alias("position"))


def _both(spark, d):
    """Refined conversations with their source's, one row a run_id."""
    src = dedup.keep_first(table(spark, d, "source_trajectories").select("source_file", "source_row_index", "conversations"), ["source_file", "source_row_index"], ["source_file"])
    ref = table(spark, d, "refined_rows").select("run_id", "source_file", "source_row_index", F.col("conversations").alias("candidate"))
    return ref.join(src.withColumnRenamed("conversations", "source"), ["source_file", "source_row_index"])


def _broken(source, candidate, bucket):
    """Candidates made to raise each code: what is done to one depends on the last character of its id."""
    turn = lambda c, r: F.struct(F.lit(c).alias("content"), F.lit(r).alias("role"))
    swap = lambda role, text: F.transform(candidate, lambda t: F.struct(F.when(t["role"] == role, F.lit(text)).otherwise(t["content"]).alias("content"), t["role"].alias("role")))
    made = {
        "0": source,
        "1": F.concat(candidate, F.array(turn("And what comes after that, in your view?", "user"))),
        "2": F.concat(F.array(turn("stray output", "tool")), candidate),
        "3": F.concat(F.slice(candidate, F.lit(1), F.greatest(F.size(candidate) - 1, F.lit(0))), F.array(turn("I'm sorry, I cannot help with that.", "assistant"))),
        "4": F.concat(candidate, F.slice(candidate, -1, 1)),
        "5": swap("user", "Paint the kitchen walls blue tomorrow."),
        "6": F.filter(candidate, lambda t: t["role"] == "user"),
        "7": F.transform(candidate, lambda t: F.struct(F.lit(None).cast("string").alias("content"), t["role"].alias("role"))),
        "9": F.concat(F.slice(candidate, F.lit(1), F.greatest(F.size(candidate) - 1, F.lit(0))), F.array(turn("The review is complete and the key points are known", "assistant"))),
        "8": F.transform(candidate, lambda t: F.struct(F.lit("ok then").alias("content"), t["role"].alias("role"))),
    }
    out = F.when(F.lit(False), candidate)
    for b, c in made.items():
        out = out.when(bucket == b, c)
    return out.otherwise(candidate)


def quality_derived_codes(spark, d):
    """Codes of candidates of which most were broken on purpose, so that every code occurs."""
    rows = _both(spark, d).withColumn("candidate", _broken(F.col("source"), F.col("candidate"), F.right("run_id", F.lit(1))))
    rows, p = quality.prepared(rows, "source", "candidate")
    return rows.select("run_id", F.array_join(quality.codes_of(p), ",").alias("codes")).distinct()


def policy_derived_codes(spark, d):
    """Codes of the second policy for the same candidates."""
    rows = _both(spark, d).withColumn("candidate", _broken(F.col("source"), F.col("candidate"), F.right("run_id", F.lit(1))))
    return rows.select("run_id", F.array_join(quality.secondary_codes(F.col("source"), F.col("candidate")), ",").alias("codes")).distinct()


def _codes(spark, d, with_anchors):
    rows, p = quality.prepared(_both(spark, d), "source", "candidate", with_anchors)
    return rows.select("run_id", F.array_join(quality.codes_of(p), ",").alias("codes")).distinct()


def quality_codes(spark, d):
    return _codes(spark, d, True)


def quality_codes_plain(spark, d):
    """All codes but the loss of every anchor."""
    return _codes(spark, d, False)


def quality_issue_details(spark, d):
    """Codes with all that speaks for them, as the text of an attempt's error."""
    rows, p = quality.prepared(_both(spark, d), "source", "candidate")
    return rows.select("run_id", quality.error_text(quality.issues_of(p)).alias("error")).distinct()


def quality_code_histogram(spark, d):
    return quality_codes(spark, d).select(F.explode(F.split("codes", ",")).alias("code")).where("code != ''").groupBy("code").agg(F.count("*").alias("n"))


def policy_secondary_codes(spark, d):
    codes = F.array_join(quality.secondary_codes(F.col("source"), F.col("candidate")), ",")
    return _both(spark, d).select("run_id", codes.alias("codes")).distinct()


def token_retention(spark, d):
    """Share of the source task's tokens that the refined user turns and the rest keep."""
    want = X.tokens(conv.joined(F.col("source"), ("user",)))
    rows = _both(spark, d).select("run_id", F.size(want).cast("bigint").alias("n_tokens"), F.round(X.share_kept(want, X.tokens(conv.joined(F.col("candidate"), ("user",)))), 6).alias("user_share"), F.round(X.share_kept(want, X.tokens(conv.joined(F.col("candidate"), ("assistant", "tool")))), 6).alias("execution_share"))
    return rows.distinct()


_IDS = "ids AS (SELECT DISTINCT source_record_id FROM (" + Q.SQL["source_identity"] + "))"
_SL = "SELECT DISTINCT synthetic_id, source_record_id, source_task_id, refinement_index FROM refinement_slots"
_SECOND = "second AS (SELECT source_record_id FROM ids ORDER BY sha256('secondary' || chr(0) || source_record_id), source_record_id LIMIT (SELECT count(*) * 3 // 2 - count(*) FROM ids))"
_SEED = lambda x: f"(('0x' || substr({x}, 1, 8))::BIGINT & 2147483647)"
_VID = "task || '-v' || i || '-' || substr(sha256(task || '::' || i), 1, 16)"
_QUOTA = "t AS (SELECT task, row_number() OVER (ORDER BY task) - 1 AS p, count(*) OVER () AS n FROM (SELECT DISTINCT task FROM source_trajectories WHERE task IS NOT NULL)), q AS (SELECT task, (1000 // n + CASE WHEN p < 1000 % n THEN 1 ELSE 0 END)::BIGINT AS n_variants FROM t)"
_DRAW = lambda s: _SEED(f"sha256('{s}42' || chr(0) || variant_id)") + " / 2147483648.0"
_PLAN = f"v AS (SELECT task, {_VID} AS variant_id FROM (SELECT task, unnest(range(0, n_variants)) AS i FROM q)), plan AS (SELECT task, variant_id, CASE WHEN {_DRAW('temperature')} < 0.3 THEN 0.7 WHEN {_DRAW('temperature')} < 0.8 THEN 0.85 ELSE 1.0 END::DOUBLE AS temperature, floor({_DRAW('framing')} * 3)::INT AS framing FROM v)"
_ROLES = lambda c, r: f"list_filter({c}, lambda t: t.role IN ({r}))"
_TEXT = lambda c, r, by="chr(10)": f"coalesce(array_to_string(list_transform({_ROLES(c, r)}, lambda t: coalesce(t.content, '')), {by}), '')"
_LET = lambda c: f"array_to_string(list_transform({c}, lambda t: substr(coalesce(t.role, '?'), 1, 1)), '')"
_KEYS = f"list_transform(candidate, lambda t: trim(regexp_replace(lower(coalesce(t.content, '')), '{Q._WS}+', ' ', 'g')))"
_BAD = "(" + Q._PROBLEM(1, None, False, False).replace("conversations", "source") + " != 'none' OR " + Q._PROBLEM(2, 40, True, False).replace("conversations", "candidate") + " != 'none')"
_PAIRS = f"""
WITH src AS (SELECT DISTINCT source_file, source_row_index, conversations AS source FROM source_trajectories),
b AS (SELECT DISTINCT run_id, source, r.conversations AS candidate FROM refined_rows r JOIN src USING (source_file, source_row_index)),
f AS (SELECT *, {_LET('candidate')} AS letters, {_LET('source')} AS source_letters, coalesce({_ROLES('candidate', "'assistant'")}[-1].content, '') AS final, {_KEYS} AS keys,
  {_TEXT('candidate', "'user','assistant'")} AS participants, {_TEXT('source', "'user'")} AS asked, {_TEXT('candidate', "'user'")} AS ask, {_TEXT('candidate', "'assistant','tool'")} AS done FROM b),
g AS (SELECT *, {Q._SEQ('participants')} AS seq, {Q._TOKENS('asked')} AS want, {Q._TOKENS('ask')} AS got, {Q._TOKENS('done')} AS executed FROM f),
h AS (SELECT *, len(list_intersect(want, got)) AS both_n, CASE WHEN len(want) = 0 THEN 1.0 ELSE len(list_intersect(want, got)) / len(want) END AS kept, CASE WHEN len(want) = 0 THEN 1.0 ELSE len(list_intersect(want, executed)) / len(want) END AS ran FROM g)
"""
_RE = lambda p: p.replace("'", "''")
_DEGEN = f"""(len(list_filter(range(1, len(keys)), lambda i: keys[i] = keys[i + 1])) > 0
  OR list_max(list_transform(list_distinct(keys), lambda k: len(list_filter(keys, lambda x: x = k)))) >= 3
  OR (len(keys) >= 6 AND len(list_distinct(keys)) / len(keys) < 0.5)
  OR len(seq) < 4 OR length({Q._STRIP('participants')}) < 24 OR (len(seq) >= 8 AND len(list_distinct(seq)) / len(seq) < 0.25))"""
_LIST = lambda *codes: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in codes) + "], lambda x: x IS NOT NULL), ',')"
# Anchors without lookbehind: the character before is matched and left out of the group; before numbers, separators are doubled so that
# the one between two numbers can end the first and precede the second.
_WORDCH = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]"
_NOWORD = r"[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]"
_CUT = lambda x: f"rtrim(lower({x}), '.,:;')"
_SQUEEZE = lambda x: f"trim(regexp_replace(lower({x}), '{Q._WS}+', ' ', 'g'))"


def _anchors(t: str) -> str:
    get = lambda p, group=1, text=t: f"regexp_extract_all({text}, '{_RE(p)}', {group})"
    plain = [get(r"(?i)https?://[^\s`\"'<>]+", 0), get(rf"(?:^|{_NOWORD})((?:~?/|\./|\.\./)[^\s`\"'<>(),;]+)"), get(rf"(?:^|{_NOWORD})(--[A-Za-z0-9][A-Za-z0-9-]*)")]
    doubled = f"regexp_replace({t}, '({_NOWORD[:-1]}.])', '\\1\\1', 'g')"
    plain.append(get(rf"(?:^|{_NOWORD})(\p{{Nd}}+(?:\.\p{{Nd}}+)*)(?:$|{_NOWORD})", 1, doubled))
    quoted = [get(X.BACKTICK), get(r"(?:^|[^A-Za-z])[\"']([^\"'\n]{2,120})[\"']")]
    parts = [f"list_transform({x}, lambda a: {_CUT('a')})" for x in plain]
    parts += [f"list_filter(list_transform({x}, lambda a: rtrim({_SQUEEZE('a')}, '.,:;')), lambda a: length(a) BETWEEN 2 AND 120)" for x in quoted]
    parts.append(f"list_transform(list_filter(list_transform(regexp_extract_all({t}, '{X.TOKEN}'), lambda x: trim(x, '.,:;')), lambda x: regexp_matches(x, '[_./:@+\\-]|[0-9]') OR (length(x) >= 4 AND regexp_matches(substr(x, 2), '[A-Z]'))), lambda x: lower(x))")
    return "list_filter(list_distinct(flatten([" + ", ".join(parts) + "])), lambda a: a != '')"


_ANCHORED = _PAIRS + f", i AS (SELECT *, {_anchors('asked')} AS exact, {_anchors('(ask || chr(10) || done)')} AS found FROM h) "
_CODES = _LIST(
    ("missing_participant", "NOT contains(letters, 'u') OR NOT contains(letters, 'a')"),
    ("invalid_turn_order", "letters[-1] != 'a'"),
    ("orphan_tool", "regexp_matches(letters, '(^|[su])t|t($|[su])')"),
    ("refusal_only", f"len({Q._SEQ('final')}) <= 80 AND regexp_matches(final, '{_RE(X.REFUSAL)}')"),
    ("degenerate_content", _DEGEN),
    ("task_drift", "(len(want) > 0 AND (both_n = 0 OR (len(want) >= 20 AND kept < 0.05))) OR (len(want) >= 5 AND ran < 0.15)"),
    ("unchanged_conversation", Q.FP.replace("conversations", "source") + " = " + Q.FP.replace("conversations", "candidate")),
)
_LOST = "(len(exact) > 0 AND len(list_intersect(exact, found)) = 0 AND (len(exact) >= 2 OR kept < 0.25))"
_QUALITY = _ANCHORED + f", c AS (SELECT run_id, CASE WHEN {_BAD} THEN 'invalid_conversation' ELSE {_CODES.replace('ran < 0.15)', 'ran < 0.15) OR ' + _LOST)} END AS codes FROM i) "
_PLAIN = _PAIRS + f", c AS (SELECT run_id, CASE WHEN {_BAD} THEN 'invalid_conversation' ELSE {_CODES} END AS codes FROM h) "
_ADDED = " OR ".join(
    f"(regexp_matches(lower(ask_), '\\b(?:{'|'.join(forms)})\\w*\\b') AND NOT regexp_matches(lower(asked_), '\\b(?:{'|'.join(forms)})\\w*\\b'))" for forms in X.DELIVERABLES.values()
)
_SECONDARY = _LIST(
    ("adjacent_same_role", "regexp_matches(letters, 'ss|uu|aa')"),
    ("missing_tool_evidence", "contains(source_letters, 't') AND NOT contains(letters, 't')"),
    ("added_deliverable", _ADDED),
    ("vague_completion", f"regexp_matches(final, '{_RE(X.VAGUE)}') AND NOT regexp_matches(final, '{_RE(X.CONCRETE)}')"),
)

_T = "struct_pack(content := {}, role := {})".format
_MAKE = {
    "0": "source",
    "1": f"list_append(conversations, {_T(chr(39) + 'And what comes after that, in your view?' + chr(39), chr(39) + 'user' + chr(39))})",
    "2": f"list_prepend({_T(chr(39) + 'stray output' + chr(39), chr(39) + 'tool' + chr(39))}, conversations)",
    "3": f"list_append(conversations[:-2], {_T(chr(39) + 'I' + chr(39) * 2 + 'm sorry, I cannot help with that.' + chr(39), chr(39) + 'assistant' + chr(39))})",
    "4": "list_concat(conversations, conversations[-1:])",
    "5": f"list_transform(conversations, lambda t: {_T('CASE WHEN t.role = ' + chr(39) + 'user' + chr(39) + ' THEN ' + chr(39) + 'Paint the kitchen walls blue tomorrow.' + chr(39) + ' ELSE t.content END', 't.role')})",
    "6": "list_filter(conversations, lambda t: t.role = 'user')",
    "7": f"list_transform(conversations, lambda t: {_T('NULL::VARCHAR', 't.role')})",
    "9": f"list_append(conversations[:-2], {_T(chr(39) + 'The review is complete and the key points are known' + chr(39), chr(39) + 'assistant' + chr(39))})",
    "8": f"list_transform(conversations, lambda t: {_T(chr(39) + 'ok then' + chr(39), 't.role')})",
}
_CASES = "CASE right(run_id, 1) " + " ".join(f"WHEN '{b}' THEN {x}" for b, x in _MAKE.items()) + " ELSE conversations END"
_DERIVE = lambda sql: sql.replace("r.conversations AS candidate", _CASES.replace("conversations", "r.conversations") + " AS candidate")

QUERIES = {f.__name__: f for f in (slot_secondary_choice, slot_assignment, slot_id_check, slot_pending_antijoin, slot_microbatches, slot_within_budget, slot_attempt_seed, batch_prompt_sources, plan_variant_quota, plan_variants, plan_temperatures, pilot_topk_sample, split_exact_holdout, shuffle_by_hash, quality_codes, quality_codes_plain, quality_derived_codes, policy_derived_codes, quality_issue_details, quality_code_histogram, policy_secondary_codes, token_retention)}
_PENDING = f"SELECT synthetic_id, source_task_id FROM ({_SL}) s WHERE NOT EXISTS (SELECT 1 FROM refined_rows r WHERE r.run_id = s.synthetic_id)"
SQL = {
    "slot_secondary_choice": f"WITH {_IDS}, {_SECOND} SELECT source_record_id FROM second",
    "slot_assignment": f"WITH {_IDS}, {_SECOND}, s AS (SELECT source_record_id, 0 AS refinement_index FROM ids UNION ALL SELECT source_record_id, 1 FROM second) SELECT source_record_id, refinement_index::TINYINT AS refinement_index, 'refined-' || substr(sha256('refinement' || chr(0) || source_record_id || chr(0) || refinement_index), 1, 24) AS synthetic_id FROM s",
    "slot_id_check": f"SELECT refinement_index::INT AS refinement_index, count(*) AS n, count(*) FILTER (synthetic_id = 'refined-' || substr(sha256('refinement' || chr(0) || source_record_id || chr(0) || refinement_index), 1, 24)) AS n_matching FROM ({_SL}) GROUP BY 1",
    "slot_pending_antijoin": _PENDING,
    "slot_microbatches": f"SELECT synthetic_id, (row_number() OVER (ORDER BY synthetic_id) - 1) // 4 AS batch_id FROM ({_SL})",
    "slot_within_budget": _PENDING + " ORDER BY synthetic_id LIMIT 25",
    "slot_attempt_seed": f"SELECT DISTINCT synthetic_id, attempt_number, {_SEED('sha256(synthetic_id || chr(0) || ' + chr(39) + 'attempt' + chr(39) + ' || chr(0) || attempt_number)')} AS seed FROM attempts WHERE synthetic_id IS NOT NULL AND attempt_number IS NOT NULL",
    "batch_prompt_sources": "SELECT batch_id, source_record_id, min(f) AS fingerprint, count(*) AS n_requests FROM (SELECT source_record_id, f, (row_number() OVER (ORDER BY source_record_id, synthetic_id) - 1) // 4 AS batch_id FROM (SELECT DISTINCT synthetic_id, source_record_id, refinement_index, lower(source_conversation_fingerprint) AS f FROM refinement_slots)) GROUP BY batch_id, source_record_id",
    "plan_variant_quota": f"WITH {_QUOTA} SELECT task, n_variants FROM q",
    "plan_variants": f"WITH {_QUOTA}, {_PLAN} SELECT variant_id, temperature, framing, {_SEED('sha256(variant_id)')} AS seed, regexp_extract(variant_id, '^(.*)-v[0-9]+-', 1) AS task FROM plan",
    "plan_temperatures": f"WITH {_QUOTA}, {_PLAN} SELECT temperature, count(*) AS n FROM plan GROUP BY temperature",
    "pilot_topk_sample": f"WITH {_IDS} SELECT source_record_id FROM ids ORDER BY sha256('pilot-v1' || chr(0) || '17' || chr(0) || source_record_id), source_record_id LIMIT 10",
    "split_exact_holdout": f"WITH {_IDS} SELECT source_record_id, CASE WHEN row_number() OVER (ORDER BY sha256('split42' || chr(0) || source_record_id), source_record_id) <= 100 THEN 'test' ELSE 'train' END AS split FROM ids",
    "shuffle_by_hash": "SELECT sample_id, row_number() OVER (ORDER BY sha256('shuffle42' || chr(0) || sample_id), sample_id) - 1 AS position FROM (SELECT DISTINCT sample_id FROM mitre_sft)",
    "quality_codes": _QUALITY + "SELECT DISTINCT run_id, codes FROM c",
    "quality_derived_codes": _DERIVE(_QUALITY) + "SELECT DISTINCT run_id, codes FROM c",
    "policy_derived_codes": _DERIVE(_PAIRS) + f", i AS (SELECT *, {_TEXT('candidate', chr(39) + 'user' + chr(39), chr(39) + ' ' + chr(39))} AS ask_, {_TEXT('source', chr(39) + 'user' + chr(39), chr(39) + ' ' + chr(39))} AS asked_ FROM h) SELECT DISTINCT run_id, {_SECONDARY} AS codes FROM i",
    "quality_codes_plain": _PLAIN + "SELECT DISTINCT run_id, codes FROM c",
    "quality_code_histogram": _QUALITY + "SELECT code, count(*) AS n FROM (SELECT run_id, unnest(string_split(codes, ',')) AS code FROM (SELECT DISTINCT run_id, codes FROM c)) WHERE code != '' GROUP BY code",
    "policy_secondary_codes": _PAIRS + f", i AS (SELECT *, {_TEXT('candidate', chr(39) + 'user' + chr(39), chr(39) + ' ' + chr(39))} AS ask_, {_TEXT('source', chr(39) + 'user' + chr(39), chr(39) + ' ' + chr(39))} AS asked_ FROM h) SELECT DISTINCT run_id, {_SECONDARY} AS codes FROM i",
    "token_retention": _PAIRS + "SELECT DISTINCT run_id, len(want) AS n_tokens, round(kept, 6) AS user_share, round(ran, 6) AS execution_share FROM h",
}
