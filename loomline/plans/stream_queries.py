"""Queries that run a stream over the tables until it has caught up."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions.session import shared_dir, table
from loomline.operators.incremental import VersionedTarget
from loomline.sources import jsonl
from loomline.streaming import acceptor, attempts


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    path = f"{d}/{name}.parquet"
    if os.path.isdir(path):
        d, name = path, "*"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option("maxFilesPerTrigger", 8).parquet(d)


def _drained(df: DataFrame, spark: SparkSession, name: str, mode: str) -> DataFrame:
    """The sink's rows once the stream has read all there is."""
    out = _folder(spark, name)
    last: list[DataFrame] = []

    def keep(batch: DataFrame, n: int) -> None:
        path = f"{out}/rows/{n:06d}"
        batch.write.mode("overwrite").parquet(path)
        last.append(path)

    df.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{out}/check").trigger(availableNow=True).start().awaitTermination()
    schema = df.schema
    paths = last[-1:] if mode == "complete" else last
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def stream_attempt_counts(spark, d):
    rows = _stream(spark, d, "attempts")
    return _drained(attempts.counts(rows), spark, "counts", "complete").select("synthetic_id", "n_attempts", F.col("last_attempt").cast("bigint").alias("last_attempt"))


def stream_first_success(spark, d):
    rows = _stream(spark, d, "attempts")
    return _drained(attempts.first_success(rows), spark, "first", "append").select("synthetic_id")


def stream_accept_first_wins(spark, d):
    """Refined rows as a stream of candidates: accepted slots, fingerprints and repeats among them."""
    folder = _folder(spark, "accepted")
    rows = _stream(spark, d, "refined_rows").select(F.col("run_id").alias("synthetic_id"), "conversations")
    acceptor.run(rows, f"{folder}/rows", f"{folder}/check")
    have = acceptor.accepted(spark, f"{folder}/rows")
    return have.agg(F.count("*").alias("n"), F.countDistinct("synthetic_id").alias("n_ids"), F.countDistinct("fingerprint").alias("n_fingerprints"))


def attempts_malformed_counts(spark, d):
    """The attempts as a JSON log with two bad lines per source file added: lines, malformed lines, the largest call number, ids."""
    folder = _folder(spark, "log")
    good = table(spark, d, "attempts").select(F.to_json(F.struct("synthetic_id", "status", "attempt_number", F.col("provider_request_number").alias("agent_call_number"))).alias("value"))
    bad = spark.createDataFrame([("[]",), ("not-json",)], "value string")
    good.union(bad).write.text(f"{folder}/lines")
    counts, totals = jsonl.id_counts(spark, f"{folder}/lines")
    return totals.select("n_lines", "n_malformed", "last_call").crossJoin(F.broadcast(counts.agg(F.count("*").alias("n_ids"))))  # one row each


def incremental_target(spark, d):
    """Two runs over the slots, the first of which fails after writing: rows, keys and the version at the end."""
    target = VersionedTarget(spark, _folder(spark, "target"))
    slots = table(spark, d, "refinement_slots").select("synthetic_id", "refinement_index", F.lower(F.coalesce("source_conversation_fingerprint", F.lit(""))).alias("f")).distinct()

    def fail(step: str) -> None:
        if step == "written":
            raise RuntimeError("lost")

    try:
        target.run(slots, F.col("synthetic_id"), F.col("f"), lambda x: x, fail)
    except RuntimeError:
        pass
    target.run(slots.where("refinement_index = 0"), F.col("synthetic_id"), F.col("f"), lambda x: x)
    version = target.run(slots, F.col("synthetic_id"), F.col("f"), lambda x: x)
    # new versions of the second slots, then a source that lost the first ones
    due = target.due(slots.where("refinement_index = 1").withColumn("f", F.concat("f", F.lit("+"))), F.col("synthetic_id"), F.col("f")).count()
    same = target.run(slots.where("refinement_index = 1"), F.col("synthetic_id"), F.col("f"), lambda x: x) == version
    compacted = target.compact()
    out = target.read().agg(F.count("*").alias("n_rows"), F.countDistinct("_source_key").alias("n_keys"))
    return out.withColumns({"version": F.lit(version).cast("bigint"), "n_due": F.lit(due).cast("bigint"), "idle": F.lit(same), "compacted": F.lit(compacted).cast("bigint")})


QUERIES = {f.__name__: f for f in (stream_attempt_counts, stream_first_success, stream_accept_first_wins, attempts_malformed_counts, incremental_target)}
SQL = {
    "stream_attempt_counts": "SELECT synthetic_id, count(*) AS n_attempts, max(attempt_number)::BIGINT AS last_attempt FROM attempts WHERE synthetic_id IS NOT NULL GROUP BY synthetic_id",
    "stream_first_success": "SELECT DISTINCT synthetic_id FROM attempts WHERE status = 'accepted' AND synthetic_id IS NOT NULL",
    "attempts_malformed_counts": "SELECT count(*) + 2 AS n_lines, count(*) FILTER (synthetic_id IS NULL OR synthetic_id = '') + 2 AS n_malformed, max(provider_request_number) AS last_call, count(DISTINCT synthetic_id) AS n_ids FROM attempts",
    "incremental_target": "SELECT count(*) AS n_rows, count(DISTINCT synthetic_id) AS n_keys, CASE WHEN count(*) FILTER (refinement_index = 1) > 0 THEN 2 ELSE 1 END::BIGINT AS version, count(*) FILTER (refinement_index = 1) AS n_due, true AS idle, CASE WHEN count(*) FILTER (refinement_index = 1) > 0 THEN 3 ELSE 1 END::BIGINT AS compacted FROM (SELECT DISTINCT synthetic_id, refinement_index FROM refinement_slots)",
}
