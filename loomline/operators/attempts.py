"""Accounting of attempts: counts, histograms, first successes, stop rules, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions import text as X

FATAL = (400, 401, 403, 404)  # fixed values: codes after which a run stops


def per_slot(attempts: DataFrame) -> DataFrame:
    return attempts.where("synthetic_id IS NOT NULL").groupBy("synthetic_id").agg(F.count("*").alias("n_attempts"), F.max("attempt_number").cast("bigint").alias("last_attempt"))


def rejection_histogram(attempts: DataFrame) -> DataFrame:
    return attempts.select(F.explode("rejection_codes").alias("code")).where("code IS NOT NULL").groupBy("code").agg(F.count("*").alias("n"))


def error_histogram(attempts: DataFrame) -> DataFrame:
    """Provider errors by code; a null or zero code is ``unknown``."""
    code = F.when(F.coalesce("error_code", F.lit(0)) == 0, "unknown").otherwise(F.col("error_code").cast("string"))
    return attempts.where("status = 'provider_error'").groupBy(code.alias("code")).agg(F.count("*").alias("n"))


def first_success(attempts: DataFrame) -> DataFrame:
    """Per slot the first accepted attempt and how many came before it; null where none was accepted."""
    ok = F.col("status") == "accepted"
    out = attempts.where("synthetic_id IS NOT NULL").groupBy("synthetic_id").agg(F.min(F.when(ok, F.col("attempt_number"))).cast("bigint").alias("accepted_attempt"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("n_failed"))
    return out


def report(attempts: DataFrame, target: int) -> DataFrame:
    """One row: accepted slots, acceptance rate, attempts, collisions, fatal and transient errors."""
    ok = F.col("status") == "accepted"
    accepted = F.countDistinct(F.when(ok, F.col("synthetic_id")))
    return attempts.agg(
        accepted.alias("accepted_slots"),
        F.round(accepted / F.lit(target), 6).alias("acceptance_rate"),
        F.count("*").alias("n_attempts"),
        F.coalesce(F.sum(F.when(F.array_contains("rejection_codes", "duplicate_conversation"), 1).otherwise(0)), F.lit(0)).cast("bigint").alias("n_collisions"),
        F.count_if(F.col("error_code").isin(*FATAL)).alias("n_fatal"),
        F.count_if(F.coalesce(F.col("error"), F.lit("")).rlike(X.TRANSIENT)).alias("n_transient"),
    )


def totals(attempts: DataFrame, by: str) -> DataFrame:
    """Accepted and failed attempts and the error rate per value of ``by``."""
    ok = F.count_if(F.col("status") == "accepted")
    err = F.count_if(F.col("status").isin("provider_error", "agent_error"))
    return attempts.groupBy(by).agg(ok.alias("n_ok"), err.alias("n_err"), F.count("*").alias("n"), F.round(err / F.count("*"), 6).alias("error_rate"))


def stops(batches: DataFrame, batch: str, expected: DataFrame | None = None) -> DataFrame:
    """Per batch whether the run stops after it: no attempts at all, a fatal code, or nothing accepted.

    ``expected``: the batches that should have attempts, by the same column; without it no batch is found empty.
    """
    out = batches.groupBy(batch).agg(F.count_if(F.col("status") == "accepted").alias("n_ok"), F.count_if(F.col("error_code").isin(*FATAL)).alias("n_fatal"), F.lit(True).alias("_any"))
    if expected is not None:
        out = expected.select(batch).distinct().join(out, batch, "left").fillna(0, ["n_ok", "n_fatal"])
    reason = F.when(F.col("_any").isNull(), "empty").when(F.col("n_fatal") > 0, "fatal").when(F.col("n_ok") == 0, "none_accepted")
    return out.withColumn("reason", reason).drop("_any")


def safe_error(message, secret: str = "", most: int = 500):
    """White space collapsed, at most ``most`` characters, the secret blotted out."""
    out = F.left(X.squeeze(message), F.lit(most))
    return F.replace(out, F.lit(secret), F.lit("[REDACTED]")) if secret else out
