"""Accepting candidates from a stream: the accepted table is the state.

Each micro-batch is checked, its collisions are resolved against everything accepted so far, and the winners are
committed as one shard. Nothing depends on the number of a batch: one that is delivered again, by the same or by
another query, finds its slots and fingerprints accepted and adds nothing, so every slot is accepted at most once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.functions import conv
from loomline.functions.storage import Storage
from loomline.operators.dedup import collision_winners, keep_first

ACCEPTED = T.StructType([T.StructField("synthetic_id", T.StringType()), T.StructField("conversations", conv.CONVERSATION), T.StructField("fingerprint", T.StringType())])


def accepted(spark: SparkSession, folder: str) -> DataFrame:
    shards = [f"{folder}/{n}" for n in Storage(spark, folder).names(folder) if n.startswith("batch-")]
    return spark.read.schema(ACCEPTED).parquet(*shards) if shards else spark.createDataFrame([], ACCEPTED)


def commit(batch: DataFrame, batch_id: int, folder: str) -> None:
    """``foreachBatch`` function: candidates synthetic_id, conversations."""
    spark = batch.sparkSession
    files = Storage(spark, folder)
    have = accepted(spark, folder)
    rows = batch.withColumn("problem", conv.problem(F.col("conversations"))).where("problem IS NULL AND synthetic_id IS NOT NULL").drop("problem")
    rows = rows.withColumn("fingerprint", conv.fingerprint(F.col("conversations"))).select(*ACCEPTED.names)
    rows = keep_first(rows, ["synthetic_id"], ["fingerprint"]).join(have.select("synthetic_id"), "synthetic_id", "left_anti")
    won = collision_winners(rows, have, "fingerprint", "synthetic_id").where("won").select(*ACCEPTED.names)
    token = uuid.uuid4().hex
    staging = f"{folder}/.staging-{token}"
    won.write.parquet(staging)
    if spark.read.schema(ACCEPTED).parquet(staging).isEmpty():
        files.delete(staging)
    else:
        files.move(staging, f"{folder}/batch-{batch_id:012d}-{token}")


def run(candidates: DataFrame, folder: str, checkpoint: str) -> None:
    """Process what a stream of candidates has now and stop."""
    Storage(candidates.sparkSession, folder).make(folder)
    query = candidates.writeStream.foreachBatch(lambda df, n: commit(df, n, folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
