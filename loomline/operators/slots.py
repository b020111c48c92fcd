"""Assigning generation slots: who gets a second one, what is pending, batches, quotas, samples and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomline.functions import identity


def smallest_by_hash(df: DataFrame, key: str, prefix: Column, k: int) -> DataFrame:
    """The ``k`` rows with the smallest hash of ``prefix`` and key, ties by key; bounded memory whatever the input."""
    digest = F.sha2(F.concat(prefix, F.lit("\x00"), F.col(key)), 256)
    return df.withColumn("_h", digest).orderBy("_h", key).limit(k).drop("_h")


def pilot(ids: DataFrame, key: str, seed: int, size: int) -> DataFrame:
    """The ids of a pilot of 10 to 50 sources, chosen by hash."""
    if not 10 <= size <= 50:
        raise ValueError("a pilot has 10 to 50 sources")
    return smallest_by_hash(ids, key, F.lit(f"pilot-v1\x00{seed}"), size)


def secondary(ids: DataFrame, key: str, target: int) -> DataFrame:
    """The ids that get a second slot so that ``target`` slots exist in all.

    ``target`` must lie between the number of ids and twice that number; ids must be unique and not null.
    """
    n, distinct = ids.agg(F.count("*"), F.countDistinct(key)).first()
    if n != distinct:
        raise ValueError("ids must be unique and not null")
    if not n <= target <= 2 * n:
        raise ValueError("target must lie between the number of ids and twice that number")
    return smallest_by_hash(ids.select(key), key, F.lit("secondary"), target - n)


def assign(sources: DataFrame, key: str, target: int) -> DataFrame:
    """One row per slot: the source's columns, refinement_index (0, or 0 and 1) and synthetic_id."""
    second = secondary(sources, key, target).withColumn("_second", F.lit(True))
    index = F.explode(F.when(F.col("_second"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    out = sources.join(second, key, "left").withColumn("refinement_index", index).drop("_second")
    out = out.withColumn("refinement_index", F.col("refinement_index").cast("tinyint"))
    return out.withColumn("synthetic_id", identity.synthetic_id(F.col(key), F.col("refinement_index")))


def pending(slots: DataFrame, done: DataFrame, key: str = "synthetic_id") -> DataFrame:
    return slots.join(done.select(key).distinct(), key, "left_anti")


def numbered(df: DataFrame, order: list[str], buckets: int | None = None, name: str = "position") -> DataFrame:
    """Rows numbered from 0 in the given order, without one task that sees all rows.

    Bounds from a sample of the keys (20 per bucket, those with the smallest hashes) split the order into buckets; counts per
    bucket give the offsets. A row's bucket is a plain expression of its key, so it is the same each time
    it is computed. Equal keys are numbered in any order; nulls come first.
    """
    buckets = buckets or min(256, max(16, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    sample = df.select(*order).orderBy(F.xxhash64(*order)).limit(20 * buckets).orderBy(*order).collect()
    kinds = [df.schema[c].dataType for c in order]
    bounds = [F.struct(*[F.lit(v).cast(t).alias(c) for v, t, c in zip(r, kinds, order)]) for r in sample[20::20]]
    own = F.struct(*[F.col(c).alias(c) for c in order])
    bucket = F.lit(0)
    for b in bounds:
        bucket = bucket + (own >= b).cast("int")
    split = df.withColumn("_p", bucket)
    counts = split.groupBy("_p").agg(F.count("*").alias("_n"))
    offsets = counts.withColumn("_from", F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # one row per bucket
    inside = F.row_number().over(W.partitionBy("_p").orderBy(*order)) - 1
    numbers = split.withColumn("_i", inside).join(F.broadcast(offsets.select("_p", "_from")), "_p")
    return numbers.withColumn(name, F.col("_from") + F.col("_i")).drop("_p", "_i", "_from")


def micro_batches(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """batch_id: ``size`` rows each in order, the last one shorter."""
    return numbered(df, order).withColumn("batch_id", F.floor(F.col("position") / size)).drop("position")


def quotas(tasks: DataFrame, key: str, requests: int) -> DataFrame:
    """n_variants per task: an equal share, the first tasks (by key) taking the remainder."""
    n = tasks.count()
    if not n:
        return tasks.select(key).withColumn("n_variants", F.lit(0).cast("bigint"))
    extra = (F.col("position") < requests % n).cast("bigint")
    return numbered(tasks.select(key), [key]).select(key, (F.lit(requests // n) + extra).cast("bigint").alias("n_variants"))


def variants(quota: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """The plan: variant_id, temperature and framing number of every variant, drawn by hash."""
    rows = quota.where("n_variants > 0").withColumn("index", F.explode(F.sequence(F.lit(0), (F.col("n_variants") - 1).cast("int"))))
    rows = rows.withColumn("variant_id", identity.variant_id(F.col(key), F.col("index")))
    draw = lambda salt: identity.seed_of(F.sha2(F.concat(F.lit(f"{salt}{seed}\x00"), F.col("variant_id")), 256)) / 2147483648.0
    u = draw("temperature")
    temperature = F.when(u < 0.3, 0.7).when(u < 0.8, 0.85).otherwise(1.0)  # weights 0.3, 0.5, 0.2
    return rows.select(key, "variant_id", temperature.alias("temperature"), F.floor(draw("framing") * 3).cast("int").alias("framing"))


def holdout(df: DataFrame, key: str, size: int, seed: int = 42) -> DataFrame:
    """``split``: exactly ``size`` rows are ``test``, chosen by hash."""
    test = smallest_by_hash(df.select(key), key, F.lit(f"split{seed}"), size).withColumn("_t", F.lit("test"))
    return df.join(test, key, "left").withColumn("split", F.coalesce("_t", F.lit("train"))).drop("_t")


def within_budget(df: DataFrame, order: list[str], budget: int) -> DataFrame:
    """The first ``budget`` requests in order."""
    return df.orderBy(*order).limit(budget)
