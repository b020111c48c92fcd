"""Conversations made up for scale tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def conversations(spark: SparkSession, rows: int, content_bytes: int = 512, partitions: int | None = None) -> DataFrame:
    """``rows`` source trajectories of two turns whose answer has ``content_bytes`` characters."""
    i = F.col("id").cast("string")
    filler = F.rpad(F.concat(F.lit("Result "), i, F.lit(" ")), F.lit(content_bytes), F.lit("x"))
    turn = lambda c, r: F.struct(c.alias("content"), F.lit(r).alias("role"))
    df = spark.range(0, rows, 1, partitions) if partitions else spark.range(rows)
    return df.select(
        F.array(turn(F.concat(F.lit("Inspect file number "), i, F.lit(" and report its size.")), "user"), turn(filler, "assistant")).alias("conversations"),
        F.concat(F.lit("run-"), i).alias("run_id"), F.concat(F.lit("trial-"), i).alias("trial_name"), F.concat(F.lit("task-"), F.col("id") % 1000).alias("task"), F.lit("model").alias("model"), F.lit("provider").alias("model_provider"),
    )
