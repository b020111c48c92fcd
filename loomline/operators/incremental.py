"""Processing only new or changed records, with the target as the state.

Each published target row carries the key and the version of the source record it was made from.
A run anti-joins the source against them, so a record is due exactly while the target
lacks its current version. The target is a folder of immutable parts plus one pointer per version:

    parts/<token>/rows/*.parquet   rows of one run
    parts/<token>/seen/*.parquet   keys and versions of the records the run processed, with or without rows
    versions/<number>.json         {"version", "parts": [...]}, created exclusively

A run writes its part first and then creates the next version file in one atomic step. Before
that step nothing of it is visible (a retry does the same work again); after it the keys
are in the target (a retry finds nothing due). Two writers cannot both create a version. The folder may lie on any
storage that Spark reads. ``compact`` folds all parts into one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomline.functions.storage import Storage, document

KEY, VERSION = "_source_key", "_source_version"


def latest(df: DataFrame, key: list[str], order: Column, keep: list[str]) -> DataFrame:
    """One row per key: ``keep`` of the row with the highest ``order`` (ties: the greatest values).

    Aggregated before the shuffle, so repeated rows and hot keys cost one row per task.
    Null ``order`` values rank lowest.
    """
    best = F.max_by(F.struct(*keep), F.struct(order.alias("o"), *keep))
    return df.groupBy(*key).agg(best.alias("_best")).select(*key, "_best.*")


def changed(source: DataFrame, target: DataFrame, key: list[str], version: str) -> DataFrame:
    """Rows of ``source`` whose (key, version) the target state lacks.

    ``source`` and ``target`` have one row per key. Null keys and versions are values like others: a
    null version is due until the target holds the key with a null version.
    """
    have = target.select(*[F.col(k).alias(f"_t_{k}") for k in key], F.col(version).alias("_t_version"))
    same = F.col(version).eqNullSafe(F.col("_t_version"))
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_t_{k}"))
    return source.join(have, same, "left_anti")


def due_shards(inventory: DataFrame, manifest: DataFrame, state: DataFrame) -> DataFrame:
    """Accepted shards the next checkpoint of each run must process: run_instance_id, path, sha256.

    Source: the digest of each shard's highest snapshot_seq. Target state: the digest recorded for
    it at the highest completed_rows among successful checkpoints, those a ``synchronized`` state row names
    as last_checkpoint. Spellings of one path are one shard and digests ignore case. Repeated rows
    count once; clocks are not used. Rows without run, path or digest name no shard and are left
    out; empty tables mean no shards, or nothing processed yet.
    """
    run = "run_instance_id"
    src = _shards(inventory).select(run, "path", "sha256", "snapshot_seq")
    source = latest(src, [run, "path"], F.col("snapshot_seq"), ["sha256"])
    good = state.where((F.col("status") == "synchronized") & F.col("last_checkpoint").isNotNull())
    good = good.select(F.col(run).alias("_run"), F.col("last_checkpoint").alias("_checkpoint")).distinct()
    done = _shards(manifest).join(good, (F.col(run) == F.col("_run")) & (F.col("checkpoint") == F.col("_checkpoint")), "left_semi")
    target = latest(done, [run, "path"], F.col("completed_rows"), ["sha256"])
    return changed(source, target, [run, "path"], "sha256")


def _shards(df: DataFrame) -> DataFrame:
    digest = F.lower(F.col("sha256"))
    name = F.lower(F.regexp_extract("path", r"(?i)accepted-([0-9a-f]{20})\.parquet\s*$", 1))
    path = F.when(name != "", F.concat(F.lit("accepted/accepted-"), name, F.lit(".parquet")))
    return df.withColumns({"path": path, "sha256": digest}).where(F.col("run_instance_id").isNotNull() & F.col("path").isNotNull() & F.col("sha256").isNotNull())


class VersionedTarget:
    """A target table in a folder that serves as its own state (see the module's text)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Storage(spark, path)
        self.files.make(f"{self.path}/versions")

    def current(self) -> dict:
        names = [n for n in self.files.names(f"{self.path}/versions") if n.endswith(".json")]
        return self.files.json(f"{self.path}/versions/{names[-1]}") if names else {"version": 0, "parts": []}

    def _parts(self, what: str, now: dict | None = None) -> DataFrame | None:
        parts = (now or self.current())["parts"]
        return self.spark.read.parquet(*[f"{self.path}/parts/{p}/{what}" for p in parts]) if parts else None

    def read(self) -> DataFrame | None:
        """All rows of the current version, older versions of a record included; None if none yet."""
        return self._parts("rows")

    def rows(self) -> DataFrame | None:
        """The rows of each source key as it was processed last; a key whose last processing gave no rows has none."""
        now = self.current()
        df, seen = self._parts("rows", now), self._parts("seen", now)
        if df is None:
            return None
        last = seen.groupBy(F.col(KEY).alias("_k")).agg(F.max("_part").alias("_last"))
        return df.join(last, (F.col(KEY) == F.col("_k")) & (F.col("_part") == F.col("_last")), "left_semi")

    def due(self, source: DataFrame, key: Column, version: Column, now: dict | None = None) -> DataFrame:
        """Source rows whose (key, version) is not what the target holds last. Null keys are errors."""
        src = source.withColumns({KEY: F.coalesce(key.cast("string"), F.raise_error(F.lit("null source key")).cast("string")), VERSION: version.cast("string")})
        have = self._parts("seen", now)
        if have is None:
            return src
        return changed(src, latest(have, [KEY], F.col("_part"), [VERSION]), [KEY], VERSION)

    def run(self, source: DataFrame, key: Column, version: Column, work: Callable[[DataFrame], DataFrame], fail: Callable[[str], None] = lambda step: None) -> int:
        """Process what is due and publish it; gives the version now current.

        ``work`` must hand the two columns of the source key and version on. A record for which it gives no rows counts as
        processed all the same. What is due is settled before the work begins, so records that arrive meanwhile wait for the next
        run. ``fail`` is called at each step, for tests that break a run.
        """
        now = self.current()
        token = f"{now['version'] + 1:012d}-{uuid.uuid4().hex}"
        part, mark = f"{self.path}/parts/{token}", F.lit(token)
        fail("start")
        try:
            due = self.due(source, key, version, now)
            due.write.parquet(f"{part}/due")
            due = self.spark.read.schema(due.schema).parquet(f"{part}/due")
            if due.isEmpty():
                self.files.delete(part)
                return now["version"]
            work(due).withColumn("_part", mark).write.parquet(f"{part}/rows")
            due.select(KEY, VERSION).distinct().withColumn("_part", mark).write.parquet(f"{part}/seen")
            self.files.delete(f"{part}/due")
            fail("written")
        except BaseException:
            self.files.delete(part)
            raise
        body = {"version": now["version"] + 1, "parts": [*now["parts"], token]}
        try:
            self.files.write_new(f"{self.path}/versions/{body['version']:012d}.json", document(body))
        except FileExistsError:  # another writer was first; after any other error the part stays, as the version may be there all the same
            self.files.delete(part)
            raise
        fail("published")
        return body["version"]

    def compact(self) -> int:
        """Fold all parts into one, as a new version; rows, keys and their order of processing stay."""
        now = self.current()
        if len(now["parts"]) < 2:
            return now["version"]
        token = f"{now['version'] + 1:012d}-{uuid.uuid4().hex}"
        for what in ("rows", "seen"):
            self._parts(what, now).write.parquet(f"{self.path}/parts/{token}/{what}")
        body = {"version": now["version"] + 1, "parts": [token]}
        self.files.write_new(f"{self.path}/versions/{body['version']:012d}.json", document(body))
        return body["version"]
