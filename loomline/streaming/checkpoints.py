"""Threshold checkpoints over sealed shards: data, then marker, then pointer; the pointer moves last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomline.functions.storage import Storage, document
from loomline.operators.control import inventory_digest


def threshold(done: Column, every: int) -> Column:
    return F.floor(done / every) * every


def advances(progress: DataFrame, run: str, order: str, done: str, every: Column) -> DataFrame:
    """Rows of progress logs at which a run's threshold rises above all before."""
    reached = F.floor(F.col(done) / every) * every
    before = F.coalesce(F.max("reached").over(W.partitionBy(run).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return progress.withColumn("reached", reached.cast("bigint")).withColumn("before", before).where("reached > before").drop("before")


def checkpoint(spark: SparkSession, shards: dict[str, dict], rows: int, every: int, source: str, remote: str, fail=lambda step: None) -> dict:
    """Copy new shards and mark the checkpoint if the threshold has risen; gives the pointer document.

    ``shards``: path -> size, sha256. A known shard that has vanished is an error. Repeating a failed call does the same work again. Both folders
    may lie on any storage.
    """
    files, pointer = Storage(spark, remote), f"{remote}/latest.json"
    state = files.json(pointer) if files.exists(pointer) else {"threshold": 0, "shards": {}}
    gone = set(state["shards"]) - set(shards)
    if gone:
        raise ValueError(f"known shards are missing: {sorted(gone)[:3]}")
    reached = rows // every * every
    if reached <= state["threshold"]:
        return state
    new = {p: e for p, e in shards.items() if state["shards"].get(p, {}).get("sha256") != e["sha256"]}
    for p in new:
        target = f"{remote}/data/{p}"
        files.make(target.rsplit("/", 1)[0])
        files.copy(f"{source}/{p}", f"{target}.staging")
        files.move(f"{target}.staging", target, overwrite=True)
    fail("data")
    digest = inventory_digest(shards)
    marker = f"checkpoints/checkpoint-{reached:012d}-{digest[:12]}.json"
    files.write(f"{remote}/{marker}", document({"threshold": reached, "rows": rows, "digest": digest, "new": sorted(new), "before": state.get("marker")}))
    fail("marker")
    body = {"threshold": reached, "rows": rows, "marker": marker, "digest": digest, "shards": shards}
    files.write(pointer, document(body))
    return body
