"""Exact deduplication: keep-first, collision winners, uniqueness violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order.

    An aggregation, not a window: hot keys shrink to a row per task before they are shuffled.
    """
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)) if rest else F.count("*")
    out = df.groupBy(*keys).agg(first.alias("_r"))
    return out.select(*keys, *[F.col(f"_r.`{c}`").alias(c) for c in rest]).select(*df.columns)


def collision_winners(candidates: DataFrame, accepted: DataFrame, fingerprint: str, key: str) -> DataFrame:
    """``won`` per candidate: no accepted row of another key has its fingerprint, and its key is the least of the candidates that share it.

    Where ``accepted`` has no column ``key``, any accepted row with the fingerprint stands against it.
    """
    held = accepted.where(F.col(fingerprint).isNotNull()).groupBy(F.col(fingerprint).alias("_f"))
    taken = held.agg(F.min(key).alias("_low"), F.max(key).alias("_high")) if key in accepted.columns else held.agg(F.lit(None).cast("string").alias("_low"), F.lit(None).cast("string").alias("_high"))
    least = candidates.groupBy(fingerprint).agg(F.min(key).alias("_least"))
    out = candidates.join(least, fingerprint, "left").join(taken.withColumn("_taken", F.lit(True)), F.col(fingerprint) == F.col("_f"), "left")
    other = F.col("_taken") & ~F.coalesce((F.col("_low") == F.col(key)) & (F.col("_high") == F.col(key)), F.lit(False))
    won = ~F.coalesce(other, F.lit(False)) & (F.col(key) == F.col("_least")) & F.col(fingerprint).isNotNull()
    return out.withColumn("won", F.coalesce(won, F.lit(False))).drop("_least", "_f", "_taken", "_low", "_high")


def repeated(df: DataFrame, value: Column, reason: str) -> DataFrame:
    """(reason, value, n) of every value that occurs more than once; nulls are no values."""
    return df.select(value.cast("string").alias("value")).where("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("n")).where("n > 1").select(F.lit(reason).alias("reason"), "value", "n")


def differences(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, side): keys only one of the two tables has."""
    missing = expected.select(key).distinct().join(actual.select(key).distinct(), key, "left_anti").withColumn("side", F.lit("missing"))
    unknown = actual.select(key).distinct().join(expected.select(key).distinct(), key, "left_anti").withColumn("side", F.lit("unknown"))
    return missing.unionByName(unknown)
