"""Queries of problem 1: new or changed shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions.session import table
from loomline.operators.incremental import due_shards


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    t = {n: table(spark, d, n) for n in ("sealed_inventory", "checkpoint_manifest", "sidecar_state")}
    return due_shards(t["sealed_inventory"], t["checkpoint_manifest"], t["sidecar_state"]).select("run_instance_id", "path")


def p1_due_by_run(spark: SparkSession, d: str) -> DataFrame:
    """How many shards are due per run."""
    return p1_found(spark, d).groupBy("run_instance_id").agg(F.count("*").alias("n_due"))


_FOUND = """
WITH inv AS (
  SELECT DISTINCT run_instance_id, snapshot_seq, lower(sha256) AS sha256,
         'accepted/accepted-' || lower(regexp_extract(path, 'accepted-([0-9a-fA-F]{20})[.]parquet', 1)) || '.parquet' AS path
  FROM sealed_inventory),
src AS (
  SELECT run_instance_id, path, sha256 FROM inv
  QUALIFY row_number() OVER (PARTITION BY run_instance_id, path ORDER BY snapshot_seq DESC, sha256 DESC) = 1),
good AS (SELECT DISTINCT run_instance_id, last_checkpoint FROM sidecar_state WHERE status = 'synchronized'),
tgt AS (
  SELECT m.run_instance_id, m.path, lower(m.sha256) AS sha256
  FROM checkpoint_manifest m JOIN good g ON g.run_instance_id = m.run_instance_id AND g.last_checkpoint = m.checkpoint
  QUALIFY row_number() OVER (PARTITION BY m.run_instance_id, m.path ORDER BY completed_rows DESC, lower(m.sha256) DESC) = 1),
found AS (
  SELECT s.run_instance_id, s.path FROM src s
  LEFT JOIN tgt t ON t.run_instance_id = s.run_instance_id AND t.path = s.path AND t.sha256 = s.sha256
  WHERE t.path IS NULL)
"""

QUERIES = {"p1_found": p1_found, "p1_due_by_run": p1_due_by_run}
SQL = {
    "p1_found": _FOUND + "SELECT run_instance_id, path FROM found",
    "p1_due_by_run": _FOUND + "SELECT run_instance_id, count(*) AS n_due FROM found GROUP BY run_instance_id",
}
