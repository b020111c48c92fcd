"""Queries over attempts, deduplication, publication and checkpoints."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomline.functions import conv
from loomline.functions.session import cut, table
from loomline.operators import attempts as A
from loomline.operators import dedup, publish
from loomline.plans import conv_queries as Q
from loomline.streaming import checkpoints



def _attempts(spark, d):
    """Each logged attempt once: whole rows delivered again are dropped."""
    cols = ["synthetic_id", "attempt_number", "status", "error", "error_code", "conversation_fingerprint", "provider_request_number", "rejection_codes", "logged_at", "source_task_id"]
    return table(spark, d, "attempts").select(*cols, "interaction_id").distinct()


def attempts_per_slot(spark, d):
    return A.per_slot(_attempts(spark, d))


def attempts_error_histogram(spark, d):
    return A.error_histogram(_attempts(spark, d))


def attempts_rejection_histogram(spark, d):
    return A.rejection_histogram(_attempts(spark, d))


def attempts_first_success(spark, d):
    return A.first_success(_attempts(spark, d))


def attempts_report(spark, d):
    target = table(spark, d, "refinement_slots").select("synthetic_id").distinct().count()
    return A.report(_attempts(spark, d), target)


def attempts_totals_by_task(spark, d):
    return A.totals(_attempts(spark, d), "source_task_id")


def attempts_stop_rule(spark, d):
    """Batches of 16 requests, from the first to the last, empty ones too."""
    rows = _attempts(spark, d).where("provider_request_number IS NOT NULL").withColumn("batch", F.floor(F.col("provider_request_number") / 16).cast("bigint"))
    ends = rows.agg(F.min("batch").alias("a"), F.max("batch").alias("b")).where("a IS NOT NULL")
    return A.stops(rows, "batch", ends.select(F.explode(F.sequence("a", "b")).alias("batch")))


def attempts_safe_errors(spark, d):
    rows = _attempts(spark, d).where("error IS NOT NULL")
    return rows.groupBy(A.safe_error(F.col("error"), secret="upstream").alias("message")).agg(F.count("*").alias("n"))


def attempts_hourly(spark, d):
    """Attempts per hour and status."""
    return _attempts(spark, d).where("logged_at IS NOT NULL").groupBy(F.date_trunc("hour", "logged_at").cast("string").alias("hour"), "status").agg(F.count("*").alias("n"))


def dedup_keep_first_documents(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_hash"))
    return dedup.keep_first(rows, ["text_hash"], ["doc_id"])


def dedup_collision_winner(spark, d):
    """Accepted attempts, resolved against the fingerprints of all published rows of other slots."""
    rows = _attempts(spark, d).where("status = 'accepted' AND conversation_fingerprint IS NOT NULL AND synthetic_id IS NOT NULL").select("synthetic_id", F.lower("conversation_fingerprint").alias("fingerprint")).distinct()
    have = table(spark, d, "refined_rows").select(F.col("run_id").alias("synthetic_id"), F.lower("refined_conversation_fingerprint").alias("fingerprint"))
    return dedup.collision_winners(rows, have, "fingerprint", "synthetic_id")


def uniqueness_violations(spark, d):
    ref = table(spark, d, "refined_rows").select("run_id", F.lower("refined_conversation_fingerprint").alias("fingerprint")).distinct()
    src = table(spark, d, "source_trajectories").select("run_id", "source_file", "source_row_index").distinct()
    return dedup.repeated(ref, F.col("run_id"), "run_id").union(dedup.repeated(ref, F.col("fingerprint"), "fingerprint")).union(dedup.repeated(src, F.col("run_id"), "source_run_id"))


def expected_versus_accepted(spark, d):
    want = table(spark, d, "refinement_slots").select("synthetic_id")
    return dedup.differences(want, table(spark, d, "refined_rows").select(F.col("run_id").alias("synthetic_id")), "synthetic_id")


_SOURCE = ["agent", "conversations", "traj_date", "episode", "model", "model_provider", "result", "run_id", "task", "trace_source", "trial_name"]


def _published(spark, d):
    src = table(spark, d, "source_trajectories")
    first = dedup.keep_first(src.select(*_SOURCE, F.col("source_file").alias("_f"), F.col("source_row_index").alias("_i")), ["_f", "_i"], ["run_id"]).drop("_f", "_i")
    ref = dedup.keep_first(table(spark, d, "refined_rows"), ["run_id"], ["source_file"])
    return publish.union_published(first, ref)


def publish_union_counts(spark, d):
    rows = _published(spark, d)
    return rows.groupBy("is_synthetic_augmentation").agg(F.count("*").alias("n"), F.count("source_record_id").alias("n_lineage"), F.sum(F.size("conversations")).alias("n_turns"))


def publish_exact_shards(spark, d):
    """All rows of the union, originals by their place and refined ones by their id, in shards of 100."""
    src = table(spark, d, "source_trajectories").select(F.concat_ws("#", "source_file", F.lpad(F.col("source_row_index").cast("string"), 12, "0")).alias("row_key"))
    ids = src.union(table(spark, d, "refined_rows").select("run_id")).distinct()
    return publish.with_shards(ids, ["row_key"], 100).select("row_key", F.col("shard").cast("bigint").alias("shard"))


def publish_shard_sizes(spark, d):
    return publish_exact_shards(spark, d).groupBy("shard").agg(F.count("*").alias("n"))


def publish_lineage_violations(spark, d):
    slots = table(spark, d, "refinement_slots").select("source_record_id", "source_file", "source_row_index", "source_trial_name", "source_conversation_fingerprint", "source_run_id", "source_task_id")
    src = dedup.keep_first(slots.distinct(), ["source_record_id"], ["source_conversation_fingerprint", "source_file"])
    return publish.lineage_violations(table(spark, d, "refined_rows"), src).distinct()


def publish_identity_drift(spark, d):
    """Source identities computed now against those of the slots, both ways."""
    from loomline.plans.conv_queries import source_identity

    now = cut(source_identity(spark, d))
    then = table(spark, d, "refinement_slots").select("source_file", "source_row_index", "source_record_id").distinct()
    return now.exceptAll(then).withColumn("side", F.lit("only_source")).union(then.exceptAll(now).withColumn("side", F.lit("only_slots")))


def publish_identity_changes(spark, d):
    """The same with every twentieth source row under another task name: both ids of each such row."""
    from loomline.functions import identity

    rows = table(spark, d, "source_trajectories").select("source_file", "source_row_index", "trial_name", "run_id", "task", conv.fingerprint(F.col("conversations")).alias("fingerprint")).distinct()
    task = F.when(F.col("source_row_index") % 20 == 0, F.concat("task", F.lit("-renamed"))).otherwise(F.col("task"))
    rid = identity.source_record_id(*[F.col(c) if c != "task" else task for c in ("source_file", "source_row_index", "trial_name", "run_id", "task", "fingerprint")])
    now = cut(rows.select("source_file", "source_row_index", rid.alias("source_record_id")))
    then = table(spark, d, "refinement_slots").select("source_file", "source_row_index", "source_record_id").distinct()
    return now.exceptAll(then).withColumn("side", F.lit("only_source")).union(then.exceptAll(now).withColumn("side", F.lit("only_slots")))


def checkpoint_thresholds(spark, d):
    rows = table(spark, d, "sidecar_state").where("synced_completed_rows IS NOT NULL").select("run_instance_id", "state_seq", "synced_completed_rows", "checkpoint_rows").distinct()
    return checkpoints.advances(rows, "run_instance_id", "state_seq", "synced_completed_rows", F.col("checkpoint_rows"))


def run_progress(spark, d):
    """Sealed shards and rows per run, each shard in its last state."""
    inv = table(spark, d, "sealed_inventory").select("run_instance_id", "snapshot_seq", F.regexp_extract("path", "accepted-([0-9a-f]{20})", 1).alias("shard"), "row_count", F.lower("sha256").alias("sha256")).distinct()
    last = inv.groupBy("run_instance_id", "shard").agg(F.max_by("row_count", F.struct("snapshot_seq", "sha256")).alias("row_count"))
    return last.groupBy("run_instance_id").agg(F.count("*").alias("n_shards"), F.sum("row_count").alias("n_rows"))


_ATT = "a AS (SELECT DISTINCT synthetic_id, attempt_number, status, error, error_code, conversation_fingerprint, provider_request_number, rejection_codes, logged_at, source_task_id, interaction_id FROM attempts)"
_REF = "(SELECT DISTINCT run_id, lower(refined_conversation_fingerprint) AS fingerprint FROM refined_rows)"
_CHECKS = {
    "unknown_source": "s.source_record_id IS NULL",
    **{f"differs:{n}": f"s.source_record_id IS NOT NULL AND {f'lower(r.{n})' if n.endswith('fingerprint') else f'r.{n}'} IS DISTINCT FROM {f'lower(s.{n})' if n.endswith('fingerprint') else f's.{n}'}" for n in ("source_file", "source_row_index", "source_trial_name", "source_conversation_fingerprint", "source_run_id", "source_task_id")},
    "task": "r.task IS DISTINCT FROM r.source_task_id",
    "refinement_index": "coalesce(r.refinement_index NOT IN (0, 1), true)",
    "synthetic_id": "r.run_id IS DISTINCT FROM 'refined-' || substr(sha256('refinement' || chr(0) || r.source_record_id || chr(0) || r.refinement_index), 1, 24)",
    "trial_name": "r.trial_name IS DISTINCT FROM r.run_id",
    "flag": "NOT coalesce(r.is_synthetic_augmentation, false)",
    "fingerprint": "lower(r.refined_conversation_fingerprint) IS DISTINCT FROM " + Q.FP.replace("conversations", "r.conversations"),
}
QUERIES = {f.__name__: f for f in (attempts_per_slot, attempts_error_histogram, attempts_rejection_histogram, attempts_first_success, attempts_report, attempts_totals_by_task, attempts_stop_rule, attempts_safe_errors, attempts_hourly, dedup_keep_first_documents, dedup_collision_winner, uniqueness_violations, expected_versus_accepted, publish_union_counts, publish_exact_shards, publish_shard_sizes, publish_lineage_violations, publish_identity_drift, publish_identity_changes, checkpoint_thresholds, run_progress)}
_FATAL = "error_code IN (400, 401, 403, 404)"
SQL = {
    "attempts_per_slot": f"WITH {_ATT} SELECT synthetic_id, count(*) AS n_attempts, max(attempt_number)::BIGINT AS last_attempt FROM a WHERE synthetic_id IS NOT NULL GROUP BY synthetic_id",
    "attempts_error_histogram": f"WITH {_ATT} SELECT CASE WHEN coalesce(error_code, 0) = 0 THEN 'unknown' ELSE error_code::VARCHAR END AS code, count(*) AS n FROM a WHERE status = 'provider_error' GROUP BY 1",
    "attempts_rejection_histogram": f"WITH {_ATT} SELECT code, count(*) AS n FROM (SELECT unnest(rejection_codes) AS code FROM a) WHERE code IS NOT NULL GROUP BY code",
    "attempts_first_success": f"WITH {_ATT} SELECT synthetic_id, min(attempt_number) FILTER (status = 'accepted')::BIGINT AS accepted_attempt, count(*) FILTER (status IS DISTINCT FROM 'accepted') AS n_failed FROM a WHERE synthetic_id IS NOT NULL GROUP BY synthetic_id",
    "attempts_report": f"WITH {_ATT} SELECT count(DISTINCT synthetic_id) FILTER (status = 'accepted') AS accepted_slots, round(count(DISTINCT synthetic_id) FILTER (status = 'accepted') / (SELECT count(DISTINCT synthetic_id) FROM refinement_slots), 6) AS acceptance_rate, count(*) AS n_attempts, count(*) FILTER (list_contains(rejection_codes, 'duplicate_conversation')) AS n_collisions, count(*) FILTER ({_FATAL}) AS n_fatal, count(*) FILTER (regexp_matches(coalesce(error, ''), '(?i)429|500|503|rate_limit|too many|throttling')) AS n_transient FROM a",
    "attempts_totals_by_task": f"WITH {_ATT} SELECT source_task_id, count(*) FILTER (status = 'accepted') AS n_ok, count(*) FILTER (status IN ('provider_error', 'agent_error')) AS n_err, count(*) AS n, round(count(*) FILTER (status IN ('provider_error', 'agent_error')) / count(*), 6) AS error_rate FROM a GROUP BY source_task_id",
    "attempts_stop_rule": f"WITH {_ATT}, b AS (SELECT provider_request_number // 16 AS batch, status, error_code FROM a WHERE provider_request_number IS NOT NULL), k AS (SELECT unnest(range((SELECT min(batch) FROM b), (SELECT max(batch) + 1 FROM b))) AS batch) SELECT k.batch, count(*) FILTER (status = 'accepted') AS n_ok, count(*) FILTER ({_FATAL}) AS n_fatal, CASE WHEN count(b.batch) = 0 THEN 'empty' WHEN count(*) FILTER ({_FATAL}) > 0 THEN 'fatal' WHEN count(*) FILTER (status = 'accepted') = 0 THEN 'none_accepted' END AS reason FROM k LEFT JOIN b ON b.batch = k.batch GROUP BY k.batch",
    "attempts_safe_errors": f"WITH {_ATT} SELECT replace(left(trim(regexp_replace(error, '{Q._WS}+', ' ', 'g')), 500), 'upstream', '[REDACTED]') AS message, count(*) AS n FROM a WHERE error IS NOT NULL GROUP BY 1",
    "attempts_hourly": f"WITH {_ATT} SELECT strftime(date_trunc('hour', logged_at), '%Y-%m-%d %H:%M:%S') AS hour, status, count(*) AS n FROM a WHERE logged_at IS NOT NULL GROUP BY 1, 2",
    "dedup_keep_first_documents": "SELECT doc_id, source, sha256(coalesce(text, '')) AS text_hash FROM documents QUALIFY row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id) = 1",
    "dedup_collision_winner": f"WITH {_ATT}, c AS (SELECT DISTINCT synthetic_id, lower(conversation_fingerprint) AS fingerprint FROM a WHERE status = 'accepted' AND conversation_fingerprint IS NOT NULL AND synthetic_id IS NOT NULL), h AS (SELECT lower(refined_conversation_fingerprint) AS f, min(run_id) AS low, max(run_id) AS high FROM refined_rows WHERE refined_conversation_fingerprint IS NOT NULL GROUP BY 1) SELECT synthetic_id, fingerprint, ((h.f IS NULL OR (low = synthetic_id AND high = synthetic_id)) AND synthetic_id = min(synthetic_id) OVER (PARTITION BY fingerprint)) AS won FROM c LEFT JOIN h ON h.f = c.fingerprint",
    "uniqueness_violations": f"SELECT 'run_id' AS reason, run_id AS value, count(*) AS n FROM {_REF} WHERE run_id IS NOT NULL GROUP BY run_id HAVING count(*) > 1 UNION ALL SELECT 'fingerprint', fingerprint, count(*) FROM {_REF} WHERE fingerprint IS NOT NULL GROUP BY fingerprint HAVING count(*) > 1 UNION ALL SELECT 'source_run_id', run_id, count(*) FROM (SELECT DISTINCT run_id, source_file, source_row_index FROM source_trajectories) WHERE run_id IS NOT NULL GROUP BY run_id HAVING count(*) > 1",
    "expected_versus_accepted": "SELECT DISTINCT synthetic_id, 'missing' AS side FROM refinement_slots WHERE synthetic_id NOT IN (SELECT run_id FROM refined_rows) UNION ALL SELECT DISTINCT run_id, 'unknown' FROM refined_rows WHERE run_id NOT IN (SELECT synthetic_id FROM refinement_slots)",
    "publish_union_counts": "SELECT false AS is_synthetic_augmentation, count(*) AS n, 0::BIGINT AS n_lineage, sum(len(conversations))::BIGINT AS n_turns FROM (SELECT DISTINCT source_file, source_row_index, conversations FROM source_trajectories) UNION ALL SELECT is_synthetic_augmentation, count(*), count(source_record_id), sum(len(conversations))::BIGINT FROM (SELECT DISTINCT run_id, is_synthetic_augmentation, source_record_id, conversations FROM refined_rows) GROUP BY is_synthetic_augmentation",
    "publish_exact_shards": "SELECT row_key, (row_number() OVER (ORDER BY row_key) - 1) // 100 AS shard FROM (SELECT source_file || '#' || lpad(source_row_index::VARCHAR, 12, '0') AS row_key FROM source_trajectories UNION SELECT run_id FROM refined_rows)",
    "publish_shard_sizes": "SELECT (k - 1) // 100 AS shard, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY row_key) AS k FROM (SELECT source_file || '#' || lpad(source_row_index::VARCHAR, 12, '0') AS row_key FROM source_trajectories UNION SELECT run_id FROM refined_rows)) GROUP BY 1",
    "publish_lineage_violations": "WITH s AS (SELECT DISTINCT source_record_id, source_file, source_row_index, source_trial_name, source_conversation_fingerprint, source_run_id, source_task_id FROM refinement_slots QUALIFY row_number() OVER (PARTITION BY source_record_id ORDER BY source_conversation_fingerprint NULLS FIRST, source_file) = 1), r AS (SELECT DISTINCT * FROM refined_rows) "
    + " UNION ALL ".join(f"SELECT DISTINCT r.run_id, '{n}' AS reason FROM r LEFT JOIN s ON s.source_record_id = r.source_record_id WHERE {c}" for n, c in _CHECKS.items()),
    "publish_identity_drift": f"WITH n AS ({Q.SQL['source_identity']}), t AS (SELECT DISTINCT source_file, source_row_index, source_record_id FROM refinement_slots) SELECT *, 'only_source' AS side FROM (SELECT source_file, source_row_index, source_record_id FROM n EXCEPT SELECT * FROM t) UNION ALL SELECT *, 'only_slots' FROM (SELECT * FROM t EXCEPT SELECT source_file, source_row_index, source_record_id FROM n)",
    "publish_identity_changes": f"WITH n AS ({Q.SQL['source_identity'].replace('task || chr(0)', '(CASE WHEN source_row_index % 20 = 0 THEN task || ' + chr(39) + '-renamed' + chr(39) + ' ELSE task END) || chr(0)')}), t AS (SELECT DISTINCT source_file, source_row_index, source_record_id FROM refinement_slots) SELECT *, 'only_source' AS side FROM (SELECT source_file, source_row_index, source_record_id FROM n EXCEPT SELECT * FROM t) UNION ALL SELECT *, 'only_slots' FROM (SELECT * FROM t EXCEPT SELECT source_file, source_row_index, source_record_id FROM n)",
    "checkpoint_thresholds": "WITH s AS (SELECT DISTINCT run_instance_id, state_seq, synced_completed_rows, checkpoint_rows FROM sidecar_state WHERE synced_completed_rows IS NOT NULL), r AS (SELECT *, (synced_completed_rows // checkpoint_rows * checkpoint_rows)::BIGINT AS reached FROM s) SELECT * FROM r QUALIFY reached > coalesce(max(reached) OVER (PARTITION BY run_instance_id ORDER BY state_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)",
    "run_progress": "SELECT run_instance_id, count(*) AS n_shards, sum(row_count)::BIGINT AS n_rows FROM (SELECT DISTINCT run_instance_id, snapshot_seq, regexp_extract(path, 'accepted-([0-9a-f]{20})', 1) AS shard, row_count, lower(sha256) AS sha256 FROM sealed_inventory QUALIFY row_number() OVER (PARTITION BY run_instance_id, shard ORDER BY snapshot_seq DESC, lower(sha256) DESC) = 1) GROUP BY run_instance_id",
}
