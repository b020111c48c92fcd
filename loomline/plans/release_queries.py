"""Queries over releases: preflight, publication and reuse, restore, rounds of generation, logs of the older pipeline."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import conv, identity
from loomline.functions.session import cut, shared_dir, table
from loomline.functions.storage import digests
from loomline.operators import dedup, manifests, publish, rounds
from loomline.plans import attempt_queries, conv_queries as Q, slot_queries
from loomline.sources import generations, jsonl

_LINEAGE = ["source_file", "source_row_index", "source_trial_name", "source_conversation_fingerprint", "source_run_id", "source_task_id"]


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _identities(spark, d) -> DataFrame:
    """Every source row once, with its record id and lineage."""
    rows = table(spark, d, "source_trajectories").select("source_file", "source_row_index", F.col("trial_name").alias("source_trial_name"), conv.fingerprint(F.col("conversations")).alias("source_conversation_fingerprint"), F.col("run_id").alias("source_run_id"), F.col("task").alias("source_task_id"))
    rid = identity.source_record_id(*[F.col(c) for c in ("source_file", "source_row_index", "source_trial_name", "source_run_id", "source_task_id", "source_conversation_fingerprint")])
    return rows.distinct().select(rid.alias("source_record_id"), *_LINEAGE)


def _accepted(spark, d) -> DataFrame:
    return dedup.keep_first(table(spark, d, "refined_rows"), ["run_id"], ["source_file"])


def publish_preflight(spark, d):
    """What stands against publishing the refined rows as they are: (check, n)."""
    sources = cut(_identities(spark, d))
    target = table(spark, d, "refinement_slots").select("synthetic_id").distinct().count()
    return publish.preflight(sources, _accepted(spark, d), target)


def publish_reuse(spark, d):
    """Publishes all rows, the same again, and fewer rows under the same name: shards, rows, whether the second call kept and the third was refused."""
    root = _folder(spark, "release")
    sources, accepted = cut(_identities(spark, d)), cut(_accepted(spark, d))
    rows = cut(attempt_queries._published(spark, d).withColumn("_key", F.coalesce("source_record_id", F.lit(""))))
    none = spark.createDataFrame([], "name string, bytes bigint, sha256 string")
    name = publish.publication_id(sources, accepted, none, rows.count(), {}, "pilot", "v1")
    first = publish.write_publication(rows, ["run_id", "_key"], 200, root, name)
    kept = publish.write_publication(rows, ["run_id", "_key"], 200, root, name) == first
    try:
        publish.write_publication(rows.where("NOT is_synthetic_augmentation"), ["run_id", "_key"], 200, root, name)
        refused = False
    except ValueError:
        refused = True
    again = publish.publication_id(sources, accepted.where("refinement_index = 0"), none, first["rows"], {}, "pilot", "v1")
    body = [(len(first["shards"]), first["rows"], min(e["rows"] for e in first["shards"][:-1]) if len(first["shards"]) > 1 else 200, kept, refused, again != name)]
    return spark.createDataFrame(body, "n_shards bigint, n_rows bigint, least_full bigint, kept boolean, refused boolean, other_name boolean")


def publish_file_digests(spark, d):
    """Of a publication on disk: rows by shard as counted from the files, and whether all digests are those of the manifest."""
    root = _folder(spark, "release")
    rows = cut(attempt_queries._published(spark, d).withColumn("_key", F.coalesce("source_record_id", F.lit(""))))
    publish.write_publication(rows, ["run_id", "_key"], 500, root, "one")
    manifest = publish.verify_publication(spark, f"{root}/publications/one")
    want = spark.createDataFrame([(k, e["path"], e["rows"], e["sha256"]) for k, e in enumerate(manifest["shards"])], "shard bigint, name string, n bigint, want string")
    return want.join(digests(spark, f"{root}/publications/one/data"), "name").select("shard", "n", (F.col("want") == F.col("sha256")).alias("same"))


def restore_status(spark, d):
    """A run's state with a shard a trace_source, sealed, copied away and restored: what the copy says."""
    state, rows = _folder(spark, "state"), cut(_accepted(spark, d).withColumn("_s", F.coalesce("trace_source", F.lit("none"))))
    kinds = [r["_s"] for r in rows.select("_s").distinct().orderBy("_s").limit(1000).collect()]
    for k in kinds:
        publish.write_shard(rows.where(F.col("_s") == k).drop("_s"), "run_id", f"{state}/accepted")
    n = _identities(spark, d).count()
    source = {"rows": n, "source_content_sha256": "c", "source_schema_sha256": "s", "source_identity_sha256": "i"}
    manifests.ensure_run(spark, state, source, n * 3 // 2, "v1", "pilot")
    manifests.seal_state(spark, state)
    got = manifests.restore(spark, state, _folder(spark, "restored"))
    return spark.createDataFrame([tuple(got[k] for k in ("run_instance_id", "accepted_rows", "target_rows", "shards"))], "run_instance_id string, accepted_rows bigint, target_rows bigint, n_shards bigint")


def retry_rounds(spark, d):
    """Slots asked for until accepted or three attempts: the generator fails the first time for ids that end in 0 to 4, and else gives the refined row.

    Per slot: its attempts and whether it was accepted. Rounds take all that is due, so ties go by round and then by id.
    """
    talks = _accepted(spark, d).select(F.col("run_id").alias("synthetic_id"), F.col("conversations").alias("_talk"))
    slots = cut(dedup.keep_first(table(spark, d, "refinement_slots").select(*rounds.SLOT), ["synthetic_id"], ["source_record_id", "source_file"]))
    fails = (F.col("attempt_number") == 1) & F.right("synthetic_id", F.lit(1)).between("0", "4")

    def generate(asked: DataFrame) -> DataFrame:
        answers = asked.join(talks, "synthetic_id", "left")
        return answers.withColumns({"conversations": F.when(~fails, F.col("_talk")), "error": F.when(fails, "busy"), "error_code": F.when(fails, 503), "interaction_id": F.lit(None).cast("string")}).drop("_talk")

    judge = lambda rows: F.array_compact(F.array(conv.problem(F.col("conversations"))))
    run = rounds.Run(spark, _folder(spark, "rounds"), slots)
    run.until(generate, judge, 1 << 30, most_attempts=3, idle=4)
    out = run.attempts().groupBy("synthetic_id").agg(F.count("*").alias("n_attempts"), F.max(F.col("status") == "accepted").alias("accepted"))
    return out.join(run.accepted().select("synthetic_id", F.lit(True).alias("stored")), "synthetic_id", "left").fillna(False, ["stored"])


def pilot_sample_pairs(spark, d):
    """The first five accepted rows by id with their source's conversation."""
    sources = _identities(spark, d).join(table(spark, d, "source_trajectories").select("source_file", "source_row_index", "conversations").distinct(), ["source_file", "source_row_index"]).select("source_record_id", "conversations")
    pairs = rounds.sample_pairs(_accepted(spark, d), sources)
    return pairs.select("synthetic_id", "source_record_id", F.size("source_conversations").alias("n_source"), F.size("refined_conversations").alias("n_refined"))


def _log(spark, d) -> str:
    """A log of raw generations made from the sources, two bad lines added."""
    path = _folder(spark, "generations")
    rows = table(spark, d, "source_trajectories").where("task IS NOT NULL").select("source_file", "source_row_index", "task", "conversations").distinct()
    vid = identity.variant_id(F.col("task"), F.col("source_row_index"))
    said = F.when(F.col("source_row_index") % 10 == 0, "error:quota").otherwise("ok")
    good = rows.select(F.to_json(F.struct(F.concat(vid, F.lit("@"), F.col("source_file")).alias("variant_id"), said.alias("status"), "conversations"), {"ignoreNullFields": "false"}).alias("value"))
    good.union(spark.createDataFrame([("[]",), ("not-json",)], "value string")).write.text(path)
    return path


def legacy_statuses(spark, d):
    """Lines of the log by status."""
    return generations.read(spark, _log(spark, d)).groupBy("status").agg(F.count("*").alias("n"))


def legacy_resume(spark, d):
    return jsonl.resume_counts(spark, _log(spark, d))


def legacy_augmented(spark, d):
    """Validated rows of the log in the shape of their task's row: kept conversations by task."""
    new = cut(generations.validated(generations.read(spark, _log(spark, d))))
    out = generations.augmented(new, Q.task_table(spark, d).drop("instruction"))
    return out.groupBy("task", "agent", "is_synthetic_augmentation", "source_task_id").agg(F.count("*").alias("n"), F.sum(F.size("conversations")).alias("n_turns"), F.count_if(F.col("run_id") == F.col("trial_name")).alias("n_named"))


def plan_missing_tasks(spark, d):
    """Planned variants with their inputs, every second task taken out of the task table: how many are pending or lack their task."""
    plan = slot_queries.plan_variants(spark, d).select("variant_id", "task")
    tasks = Q.task_table(spark, d).where(F.length("task") % 2 == 0).select("task", "instruction")
    return generations.planned_inputs(plan, tasks).groupBy("task", "status").agg(F.count("*").alias("n"))


def log_signatures(spark, d):
    """Errors of the attempts as a log: lines that hold a signature."""
    path = _folder(spark, "signatures")
    attempt_queries._attempts(spark, d).where("error IS NOT NULL").select(F.regexp_replace("error", "\\s+", " ").alias("value")).where("trim(value) != ''").write.text(path)
    return generations.signature_lines(spark, path).groupBy("value").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (publish_preflight, publish_reuse, publish_file_digests, restore_status, retry_rounds, pilot_sample_pairs, legacy_statuses, legacy_resume, legacy_augmented, plan_missing_tasks, log_signatures)}

_IDENT = f"ident AS (SELECT DISTINCT source_file, source_row_index, source_record_id FROM ({Q.SQL['source_identity']}))"
_SRC = f"src AS (SELECT i.source_record_id, s.* FROM ident i JOIN (SELECT DISTINCT source_file, source_row_index, trial_name AS source_trial_name, {Q.FP} AS source_conversation_fingerprint, run_id AS source_run_id, task AS source_task_id FROM source_trajectories) s USING (source_file, source_row_index))"
_N_SLOTS = "(SELECT count(DISTINCT synthetic_id) FROM refinement_slots)"
_ASSIGNED = f"ids AS (SELECT source_record_id FROM ident), second AS (SELECT source_record_id FROM ids ORDER BY sha256('secondary' || chr(0) || source_record_id), source_record_id LIMIT (SELECT {_N_SLOTS} - count(*) FROM ids)), want AS (SELECT 'refined-' || substr(sha256('refinement' || chr(0) || source_record_id || chr(0) || i), 1, 24) AS id FROM (SELECT source_record_id, 0 AS i FROM ids UNION ALL SELECT source_record_id, 1 FROM second))"
_REF = "r AS (SELECT DISTINCT * FROM refined_rows)"
_LINES = " UNION ALL ".join(f"SELECT 'lineage:{n}' AS c, r.run_id FROM r LEFT JOIN src s ON s.source_record_id = r.source_record_id WHERE {c}" for n, c in attempt_queries._CHECKS.items())
_ALL = "(SELECT count(*) FROM ident) + (SELECT count(DISTINCT run_id) FROM refined_rows)"
_LOG = f"log AS (SELECT source_file, source_row_index, task, conversations, {Q._OK} AS sound, list_transform(conversations, lambda t: struct_pack(content := {Q._STRIP('coalesce(t.content, chr(32))')}, role := t.role)) AS talk, CASE WHEN source_row_index % 10 = 0 THEN 'error:quota' ELSE 'ok' END AS said FROM (SELECT DISTINCT source_file, source_row_index, task, conversations FROM source_trajectories WHERE task IS NOT NULL))"
_TALK = lambda x: x.replace("conversations", "talk")
_ROUND = f"""
t AS (SELECT run_id, {Q._PROBLEM(2, 40, True, True)} AS problem, {Q.FP} AS fp FROM (SELECT DISTINCT run_id, conversations FROM refined_rows)),
s AS (SELECT DISTINCT synthetic_id, right(synthetic_id, 1) BETWEEN '0' AND '4' AS fails FROM refinement_slots),
a AS (SELECT s.synthetic_id, fails, CASE WHEN problem = 'none' THEN row_number() OVER (PARTITION BY fp, problem ORDER BY fails, s.synthetic_id) = 1 ELSE false END AS won FROM s LEFT JOIN t ON t.run_id = s.synthetic_id)
"""
SQL = {
    "publish_preflight": f"WITH {_IDENT}, {_SRC}, {_ASSIGNED}, {_REF}, lines AS ({_LINES}), have AS (SELECT DISTINCT run_id AS id FROM refined_rows), f AS (SELECT lower(refined_conversation_fingerprint) AS v FROM r WHERE refined_conversation_fingerprint IS NOT NULL GROUP BY 1 HAVING count(*) > 1) "
    f"SELECT c AS \"check\", count(*) AS n FROM lines GROUP BY c UNION ALL SELECT 'synthetic_rows', abs((SELECT count(*) FROM have) - {_N_SLOTS}) WHERE (SELECT count(*) FROM have) != {_N_SLOTS} UNION ALL SELECT 'total_rows', abs((SELECT count(*) FROM have) - {_N_SLOTS}) WHERE (SELECT count(*) FROM have) != {_N_SLOTS} "
    "UNION ALL SELECT 'repeated_fingerprint', count(*) FROM f HAVING count(*) > 0 UNION ALL SELECT 'missing_slots', count(*) FROM want WHERE id NOT IN (SELECT id FROM have) HAVING count(*) > 0 UNION ALL SELECT 'unknown_slots', count(*) FROM have WHERE id NOT IN (SELECT id FROM want) HAVING count(*) > 0",
    "publish_reuse": f"WITH {_IDENT}, n AS (SELECT ({_ALL})::BIGINT AS n) SELECT ceil(n / 200)::BIGINT AS n_shards, n AS n_rows, 200::BIGINT AS least_full, true AS kept, true AS refused, true AS other_name FROM n",
    "publish_file_digests": f"WITH {_IDENT}, n AS (SELECT ({_ALL})::BIGINT AS n), k AS (SELECT unnest(range(0, ceil(n / 500)::BIGINT)) AS shard, n FROM n) SELECT shard, least(500, n - shard * 500) AS n, true AS same FROM k",
    "restore_status": f"WITH {_IDENT} SELECT 'pilot' AS run_instance_id, (SELECT count(DISTINCT run_id) FROM refined_rows) AS accepted_rows, (SELECT count(*) * 3 // 2 FROM ident) AS target_rows, (SELECT count(DISTINCT coalesce(trace_source, 'none')) FROM refined_rows) AS n_shards",
    "retry_rounds": f"WITH {_ROUND} SELECT synthetic_id, CASE WHEN won THEN 1 + fails::INT ELSE 3 END AS n_attempts, won AS accepted, won AS stored FROM a",
    "pilot_sample_pairs": f"WITH {_IDENT} SELECT r.run_id AS synthetic_id, r.source_record_id, s.n AS n_source, r.n AS n_refined FROM (SELECT DISTINCT run_id, source_record_id, len(conversations) AS n FROM refined_rows ORDER BY run_id LIMIT 5) r JOIN ident i ON i.source_record_id = r.source_record_id JOIN (SELECT DISTINCT source_file, source_row_index, len(conversations) AS n FROM source_trajectories) s USING (source_file, source_row_index)",
    "legacy_statuses": f"WITH {_LOG} SELECT CASE WHEN said = 'ok' THEN CASE WHEN len(list_filter(conversations, lambda t: t.role IS NULL OR t.role NOT IN ('system','user','assistant','tool'))) > 0 THEN 'bad_turns' ELSE 'parsed' END ELSE said END AS status, count(*) AS n FROM log GROUP BY 1 UNION ALL SELECT 'json_error', 2",
    "legacy_resume": f"WITH {_LOG} SELECT count(*) AS n_records, 2::BIGINT AS n_malformed, count(*) FILTER (said = 'ok') AS n_completed FROM log",
    "legacy_augmented": f"WITH {_LOG}, v AS (SELECT DISTINCT task, {_TALK(Q._LEGACY)} AS fp, talk, source_file, source_row_index FROM log WHERE said = 'ok' AND {_TALK(Q._OK)}), k AS (SELECT task, fp, min(len(talk)) AS turns FROM v GROUP BY task, fp), tasks AS (SELECT task, agent FROM source_trajectories QUALIFY row_number() OVER (PARTITION BY task ORDER BY source_file, source_row_index) = 1) SELECT k.task, agent, true AS is_synthetic_augmentation, k.task AS source_task_id, count(*) AS n, sum(turns)::BIGINT AS n_turns, count(*) AS n_named FROM k JOIN tasks ON tasks.task = k.task GROUP BY k.task, agent",
    "plan_missing_tasks": f"WITH {slot_queries._QUOTA} SELECT task, CASE WHEN length(task) % 2 = 0 THEN 'pending' ELSE 'error:MissingTask' END AS status, n_variants AS n FROM q WHERE n_variants > 0",
    "log_signatures": f"WITH {attempt_queries._ATT}, l AS (SELECT regexp_replace(error, '\\s+', ' ', 'g') AS value FROM a WHERE error IS NOT NULL) SELECT value, count(*) AS n FROM l WHERE regexp_matches(value, '{generations.SIGNATURES}') GROUP BY value",
}
