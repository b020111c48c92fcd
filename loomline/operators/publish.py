"""Publication: union with lineage columns, exact shards, validation, atomic promotion."""

from __future__ import annotations

import hashlib
import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.functions import conv, identity
from loomline.functions.session import cut
from loomline.functions.storage import Storage, digests, document, row_counts
from loomline.operators import dedup, slots
from loomline.operators.slots import numbered

FLAG = "is_synthetic_augmentation"
LINEAGE = T.StructType(
    [
        T.StructField(FLAG, T.BooleanType()),
        T.StructField("source_record_id", T.StringType()),
        T.StructField("source_file", T.StringType()),
        T.StructField("source_row_index", T.LongType()),
        T.StructField("source_trial_name", T.StringType()),
        T.StructField("source_conversation_fingerprint", T.StringType()),
        T.StructField("refined_conversation_fingerprint", T.StringType()),
        T.StructField("source_task_id", T.StringType()),
        T.StructField("source_run_id", T.StringType()),
        T.StructField("refinement_index", T.ByteType()),
        T.StructField("refinement_validation_policy", T.StringType()),
    ]
)


def same_schema(a: T.StructType, b: T.StructType) -> bool:
    """Equal names, order and types; whether columns may be null does not count, as it is lost on reading."""
    strip = lambda s: [(f.name, f.dataType.simpleString()) for f in s.fields]
    return strip(a) == strip(b)


def augmented_schema(source: T.StructType) -> T.StructType:
    taken = set(source.names) & set(LINEAGE.names)
    if taken:
        raise ValueError(f"source columns clash with lineage columns: {sorted(taken)}")
    return T.StructType([*source.fields, *LINEAGE.fields])


def null_extended(originals: DataFrame) -> DataFrame:
    """Originals with the flag false and all other lineage columns null."""
    augmented_schema(originals.schema)
    cols = {f.name: (F.lit(False) if f.name == FLAG else F.lit(None).cast(f.dataType)) for f in LINEAGE.fields}
    return originals.withColumns(cols)


def union_published(originals: DataFrame, refined: DataFrame) -> DataFrame:
    """Originals and accepted rows in the augmented schema; columns only one side has are null on the other."""
    return null_extended(originals).unionByName(refined, allowMissingColumns=True)


def refined_rows(slots: DataFrame, sources: DataFrame, answers: DataFrame, model: str, provider: str, policy: str) -> DataFrame:
    """Rows of accepted conversations: the source's columns overwritten, lineage added.

    ``slots``: source_record_id, refinement_index, synthetic_id; ``sources``: the source columns plus source_record_id,
    source_file, source_row_index and source_conversation_fingerprint; ``answers``: synthetic_id, conversations.
    A conversation without the strict form raises an error when the row is read.
    """
    src = sources.withColumnsRenamed({"conversations": "_source", "run_id": "source_run_id", "trial_name": "source_trial_name"}).withColumn("source_task_id", F.col("task"))
    rows = answers.select("synthetic_id", "conversations").join(slots.select("synthetic_id", "source_record_id", "refinement_index"), "synthetic_id").join(src, "source_record_id")
    bad = conv.problem(F.col("conversations"))
    checked = F.when(bad.isNotNull(), F.raise_error(F.concat(F.lit("invalid conversation: "), bad)).cast(rows.schema["conversations"].dataType)).otherwise(F.col("conversations"))
    out = rows.withColumns({"conversations": checked, "run_id": F.col("synthetic_id"), "trial_name": F.col("synthetic_id"), FLAG: F.lit(True), "refinement_index": F.col("refinement_index").cast("tinyint"), "refinement_validation_policy": F.lit(policy)})
    out = out.withColumn("refined_conversation_fingerprint", conv.fingerprint(F.col("conversations")))
    for name, value in (("model", model), ("model_provider", provider)):
        if name in sources.columns:
            out = out.withColumn(name, F.lit(value))
    plain = [c for c in sources.columns if c not in ("source_record_id", "source_file", "source_row_index", "source_conversation_fingerprint")]
    return out.select(*plain, *LINEAGE.names)


def lineage_violations(refined: DataFrame, sources: DataFrame) -> DataFrame:
    """(run_id, reason) of accepted rows that do not match their source or their own ids.

    ``sources``: source_record_id and the six lineage columns. Fingerprints are compared in lower case; a null stored fingerprint is a violation.
    """
    names = ["source_file", "source_row_index", "source_trial_name", "source_conversation_fingerprint", "source_run_id", "source_task_id"]
    src = sources.select("source_record_id", *[F.col(n).alias(f"_{n}") for n in names], F.lit(True).alias("_known"))
    low = lambda c: F.lower(c) if c._jc.toString().endswith("fingerprint") else c
    rows = refined.join(src, "source_record_id", "left")
    differs = [(n, ~low(F.col(n)).eqNullSafe(low(F.col(f"_{n}")))) for n in names]
    checks = [
        ("unknown_source", F.col("_known").isNull()),
        *[(f"differs:{n}", F.col("_known") & d) for n, d in differs],
        ("task", ~F.col("task").eqNullSafe(F.col("source_task_id"))),
        ("refinement_index", ~F.coalesce(F.col("refinement_index").isin(0, 1), F.lit(False))),
        ("synthetic_id", ~F.col("run_id").eqNullSafe(identity.synthetic_id(F.col("source_record_id"), F.col("refinement_index")))),
        ("trial_name", ~F.col("trial_name").eqNullSafe(F.col("run_id"))),
        ("flag", ~F.coalesce(F.col(FLAG), F.lit(False))),
        ("fingerprint", ~F.lower("refined_conversation_fingerprint").eqNullSafe(conv.fingerprint(F.col("conversations")))),
    ]
    reasons = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in checks]))
    return rows.select("run_id", F.explode(reasons).alias("reason"))


def with_shards(df: DataFrame, order: list[str], per_shard: int) -> DataFrame:
    """``shard``: exactly ``per_shard`` rows each in order, the last one shorter."""
    return numbered(df, order).withColumn("shard", F.floor(F.col("position") / per_shard)).drop("position")


def file_sha256(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        for block in iter(lambda: f.read(1 << 20), b""):
            h.update(block)
    return h.hexdigest()


def atomic_json(path: str, body: dict) -> None:
    """Write and replace in one step; readers see the old or the new document."""
    staged = f"{path}.{uuid.uuid4().hex}"
    with open(staged, "w", encoding="utf-8") as f:
        json.dump(body, f, ensure_ascii=False, sort_keys=True, indent=1)
        f.flush()
        os.fsync(f.fileno())
    os.replace(staged, path)


CHUNK = 10_000  # rows whose digests are folded in one task


def ordered_digest(df: DataFrame, columns: list[str], order: list[str]) -> str:
    """A digest over all rows in order: rows are hashed and folded by thousands in the tasks, the driver folds one string a chunk."""
    line = F.concat_ws("\x00", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    rows = numbered(df.select(*order, F.sha2(line, 256).alias("_h")), order).select(F.floor(F.col("position") / CHUNK).alias("_c"), F.struct("position", "_h").alias("_r"))
    chunks = rows.groupBy("_c").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("_r")), lambda r: r["_h"]), "\n"), 256).alias("h"))
    h = hashlib.sha256()
    for row in chunks.orderBy("_c").select("h").toLocalIterator():
        h.update(row.h.encode() + b"\n")
    return h.hexdigest()


def schema_digest(schema: T.StructType) -> str:
    """Of names, order and types; whether a column may be null does not count."""
    return hashlib.sha256("\n".join(f"{f.name}\0{f.dataType.simpleString()}" for f in schema.fields).encode()).hexdigest()


def content_digest(files: DataFrame) -> str:
    """Of (name, bytes, sha256) of all files, by name."""
    return ordered_digest(files, ["name", "bytes", "sha256"], ["name"])


def publication_id(sources: DataFrame, accepted: DataFrame, shards: DataFrame, total_rows: int, digests_: dict[str, str], run_instance_id: str, policy: str) -> str:
    """The name of a publication: equal if and only if it would hold the same rows of the same run and sources.

    ``sources``: source_record_id, source_run_id, source_task_id; ``accepted``: run_id; ``shards``: name, bytes, sha256 of the accepted
    shards; ``digests_``: those of the source's identities, schema and content.
    """
    parts = {**digests_, "total": str(total_rows), "run": run_instance_id, "policy": policy}
    parts["sources"] = ordered_digest(sources, ["source_record_id", "source_run_id", "source_task_id"], ["source_record_id"])
    parts["accepted"] = ordered_digest(accepted, ["run_id"], ["run_id"])
    parts["shards"] = content_digest(shards)
    return "publication-" + hashlib.sha256(document(parts).encode()).hexdigest()[:20]


def preflight(sources: DataFrame, accepted: DataFrame, new_rows: int, total_rows: int | None = None, policy: str | None = None, facts: dict[str, tuple[object, object]] | None = None) -> DataFrame:
    """What stands against a publication: (check, n) of every check that fails; no rows, no objection.

    ``sources``: source_record_id and the six lineage columns of every original, one row each; ``accepted``: the refined rows. ``facts``: name ->
    (expected, found), for the digests, names and numbers of the manifests. Counts, repeated ids and fingerprints, slots that were not
    assigned or are missing, the policy and each lineage rule are checked on the tables. The number of new rows must lie
    between the originals and twice as many, else the check ``target`` fails and slots are not compared.
    """
    spark = sources.sparkSession
    n, rows = sources.count(), accepted.count()
    out = [(name, 1) for name, (want, found) in sorted((facts or {}).items()) if want != found]
    out += [("synthetic_rows", abs(rows - new_rows))] if rows != new_rows else []
    want_total = n + new_rows if total_rows is None else total_rows
    out += [("total_rows", abs(n + rows - want_total))] if n + rows != want_total else []
    in_range = n <= new_rows <= 2 * n
    out += [] if in_range else [("target", 1)]
    found = spark.createDataFrame(out, "check string, n bigint")
    tables = [
        lineage_violations(accepted, sources).groupBy(F.concat(F.lit("lineage:"), F.col("reason")).alias("check")).agg(F.count("*").alias("n")),
        dedup.repeated(accepted, F.col("run_id"), "repeated_id").groupBy(F.col("reason").alias("check")).agg(F.count("*").alias("n")),
        dedup.repeated(accepted, F.lower("refined_conversation_fingerprint"), "repeated_fingerprint").groupBy(F.col("reason").alias("check")).agg(F.count("*").alias("n")),
    ]
    if policy is not None:
        tables.append(accepted.where(~F.col("refinement_validation_policy").eqNullSafe(F.lit(policy))).groupBy(F.lit("policy").alias("check")).agg(F.count("*").alias("n")))
    if in_range:
        want = slots.assign(sources.select("source_record_id"), "source_record_id", new_rows).select("synthetic_id")
        both = dedup.differences(want, accepted.select(F.col("run_id").alias("synthetic_id")), "synthetic_id")
        tables.append(both.groupBy(F.concat(F.col("side"), F.lit("_slots")).alias("check")).agg(F.count("*").alias("n")))
    for t in tables:
        found = found.union(t)
    return found


def write_publication(df: DataFrame, order: list[str], per_shard: int, root: str, name: str, meta: dict | None = None, unchanged=lambda: True) -> dict:
    """Write exact shards ``train-NNNNN-of-MMMMM.parquet`` and promote them in one rename to ``root/publications/name``; gives the manifest.

    ``name`` is the publication's id. An existing folder of that name is kept if it is valid in every byte and its manifest says the same,
    else ValueError. ``unchanged`` is asked after the rows were written: if the sources are no longer those of the preflight, nothing
    is promoted. ``root/current.json`` names the publication promoted last. The order of steps: shards, manifest, complete
    mark, rename, pointer. Files are hashed in the tasks.
    """
    spark = df.sparkSession
    files, final = Storage(spark, root), f"{root}/publications/{name}"
    meta = {**(meta or {}), "publication_id": name, "rows_per_shard": per_shard}
    if files.exists(final):
        manifest = verify_publication(spark, final)
        if any(manifest.get(k) != v for k, v in meta.items()) or manifest["rows"] != df.count():
            raise ValueError("another publication is in the way")
    else:
        work = f"{root}/.work/{name}-{uuid.uuid4().hex}"
        with_shards(df, order, per_shard).repartition("shard").sortWithinPartitions("shard", *order).write.partitionBy("shard").parquet(f"{work}/parts")
        found = sorted((int(n.rsplit("=", 1)[1]), n) for n in files.names(f"{work}/parts"))
        files.make(f"{work}/data")
        for k, folder in found:
            parts = files.names(f"{work}/parts/{folder}")
            if len(parts) != 1:
                raise RuntimeError(f"shard {k} has {len(parts)} files")
            files.move(f"{work}/parts/{folder}/{parts[0]}", f"{work}/data/train-{k:05d}-of-{len(found):05d}.parquet")
        files.delete(f"{work}/parts")
        shards = _entries(spark, f"{work}/data") if found else []
        for k, e in enumerate(shards):
            if e["rows"] != per_shard and k < len(shards) - 1 or e["rows"] > per_shard:
                raise RuntimeError(f"{e['path']} has {e['rows']} rows")
        if not unchanged():
            raise ValueError("the source changed between the preflight and the end of writing")
        manifest = {**meta, "rows": sum(e["rows"] for e in shards), "shards": shards}
        text = document(manifest)
        files.write_new(f"{work}/manifest.json", text)
        files.write_new(f"{work}/complete.json", document({"publication_id": name, "manifest_sha256": hashlib.sha256(text.encode()).hexdigest(), "file_count": len(shards)}))
        files.make(f"{root}/publications")
        files.move(work, final)
    files.write(f"{root}/current.json", document({"publication_id": name, "path": f"publications/{name}"}))
    return manifest


def _entries(spark: SparkSession, folder: str) -> list[dict]:
    """One small row a shard: path, rows, bytes, sha256."""
    found = digests(spark, folder).join(row_counts(spark, folder), "name", "left").orderBy("name")
    return [{"path": r.name, "rows": r.rows or 0, "bytes": r.bytes, "sha256": r.sha256} for r in found.collect()]


def verify_publication(spark: SparkSession, target: str) -> dict:
    """The manifest, after its mark and every listed file were compared with it and no other was found."""
    files = Storage(spark, target)
    try:
        text = files.read(f"{target}/manifest.json")
        manifest, mark = json.loads(text), files.json(f"{target}/complete.json")
        if mark["publication_id"] != manifest["publication_id"] or mark["manifest_sha256"] != hashlib.sha256(text.encode()).hexdigest() or mark["file_count"] != len(manifest["shards"]):
            raise ValueError("the complete mark does not fit the manifest")
        listed = {e["path"]: e for e in manifest["shards"]}
    except ValueError:
        raise
    except Exception as e:
        raise ValueError("no valid manifest and complete mark") from e
    if set(files.names(f"{target}/data")) != set(listed):
        raise ValueError("files differ from the manifest")
    if listed:
        try:
            found = digests(spark, f"{target}/data").collect()  # one small row a shard
        except Exception as e:
            raise ValueError("a shard cannot be read") from e
        for r in found:
            if (r.bytes, r.sha256) != (listed[r.name]["bytes"], listed[r.name]["sha256"]):
                raise ValueError(f"{r.name} differs from the manifest")
        counted = {r.name: r.rows for r in row_counts(spark, f"{target}/data").collect()}
        for name, e in listed.items():
            if counted.get(name, 0) != e["rows"]:
                raise ValueError(f"{name} has {counted.get(name, 0)} rows")
    return manifest


def write_single(df: DataFrame, path: str) -> None:
    """A small table as one Parquet file under exactly this name; an existing file is replaced in one step."""
    files, staging = Storage(df.sparkSession, path), f"{path}.staging-{uuid.uuid4().hex}"
    df.coalesce(1).write.parquet(staging)
    try:
        (part,) = files.names(staging)
        files.move(f"{staging}/{part}", path, overwrite=True)
    finally:
        files.delete(staging)


def write_shard(df: DataFrame, key: str, folder: str) -> str | None:
    """One immutable shard named by the hash of its sorted keys; the same rows again change nothing, other rows under the name are an error.

    For the bounded batches of accepted rows; an empty batch writes nothing.
    """
    spark = df.sparkSession
    files, rows = Storage(spark, folder), cut(df)
    keys = rows.select(F.sha2(F.array_join(F.array_sort(F.collect_list(key)), "\n"), 256).alias("h"), F.count(F.lit(1)).alias("n")).first()
    if not keys.n:
        return None
    name = f"accepted-{keys.h[:20]}.parquet"
    target, staging = f"{folder}/{name}", f"{folder}/.staging-{uuid.uuid4().hex}"
    if files.exists(target):
        have = spark.read.parquet(target)
        if have.columns != rows.columns or not have.exceptAll(rows).isEmpty() or not rows.exceptAll(have).isEmpty():
            raise ValueError(f"{name} exists with other rows")
        return target
    rows.coalesce(1).sortWithinPartitions(key).write.parquet(staging)
    (part,) = files.names(staging)
    try:
        files.move(f"{staging}/{part}", target)
    finally:
        files.delete(staging)
    return target
