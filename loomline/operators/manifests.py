"""Manifests of sources and runs, verification of remote copies, restoring a run: control documents on any storage."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomline.functions.storage import Storage, digests, document
from loomline.operators.publish import content_digest, ordered_digest, schema_digest

IDENTITY = ["source_file", "source_row_index", "source_trial_name", "source_run_id", "source_task_id", "source_conversation_fingerprint"]


def source_manifest(spark: SparkSession, source: str, identities: DataFrame, requested: str | None = None) -> dict:
    """What a source folder holds: its files with digests, its schema, its rows and their identities (``source_record_id`` and ``IDENTITY``)."""
    files = digests(spark, source)
    listed = [r.asDict() for r in files.orderBy("name").collect()]  # one small row a file
    if not listed:
        raise FileNotFoundError(f"no Parquet files at {source}")
    return {
        "requested_source": requested or source, "resolved_source": source, "files": listed, "rows": identities.count(), "source_content_sha256": content_digest(files),
        "source_schema_sha256": schema_digest(spark.read.parquet(source).schema), "source_identity_sha256": ordered_digest(identities, ["source_record_id", *IDENTITY], ["source_record_id"]),
    }


def ensure(spark: SparkSession, path: str, body: dict, own: tuple[str, ...] = ()) -> dict:
    """Write a manifest once; if it is there already, all but the fields ``own`` must be equal. Gives the one that holds."""
    files = Storage(spark, path)
    try:
        files.write_new(path, document(body))
        return body
    except FileExistsError:
        pass
    have = files.json(path)
    differing = sorted(k for k in have.keys() | body.keys() if k not in own and have.get(k) != body.get(k))
    if differing:
        raise ValueError(f"{path} differs in {differing}")
    return have


def ensure_source(spark: SparkSession, state: str, body: dict) -> dict:
    return ensure(spark, f"{state}/source_manifest.json", body, ("requested_source",))


def ensure_run(spark: SparkSession, state: str, source: dict, target_rows: int, policy: str, run_instance_id: str | None = None) -> dict:
    """The run's manifest: bound to its source, its number of rows and its policy; the run's id is kept once drawn."""
    if not source["rows"] <= target_rows <= 2 * source["rows"]:
        raise ValueError("target must lie between the number of source rows and twice that number")
    body = {"run_instance_id": run_instance_id or uuid.uuid4().hex, "target_rows": target_rows, "validation_policy": policy, **{k: source[k] for k in ("source_content_sha256", "source_schema_sha256", "source_identity_sha256")}}
    return ensure(spark, f"{state}/run_manifest.json", body, () if run_instance_id else ("run_instance_id",))


def verify_source(spark: SparkSession, body: dict, identities: DataFrame) -> None:
    """ValueError if the source is no longer what its manifest says."""
    now = source_manifest(spark, body["resolved_source"], identities, body["requested_source"])
    differing = sorted(k for k in body if body[k] != now.get(k))
    if differing:
        raise ValueError(f"the source differs from its manifest in {differing}")


def facts(source: dict, run: dict, target_rows: int, policy: str, named: str) -> dict[str, tuple[object, object]]:
    """What ``publish.preflight`` compares: name -> (expected, found)."""
    out = {f"run_{k}": (source[k], run[k]) for k in ("source_content_sha256", "source_schema_sha256", "source_identity_sha256")}
    known = named in (source["requested_source"], source["resolved_source"])
    return {**out, "source_name": (True, known), "target_rows": (run["target_rows"], target_rows), "validation_policy": (run["validation_policy"], policy)}


def seal_state(spark: SparkSession, state: str, marker: str = "inventory.json") -> dict:
    """An inventory of a state folder: its own documents and the Parquet files under ``accepted``; it is complete once the marker is there."""
    files = Storage(spark, state)
    shards = [r.asDict() for r in digests(spark, f"{state}/accepted").orderBy("name").collect()] if files.names(f"{state}/accepted") else []
    documents = {n: files.json(f"{state}/{n}") for n in files.names(state) if n.endswith(".json") and n != marker}
    body = {"shards": shards, "documents": documents}
    files.write(f"{state}/{marker}", document(body))
    return body


def verify_state(spark: SparkSession, state: str, marker: str = "inventory.json") -> dict:
    """The sealed inventory; ValueError if a shard or document differs, is missing or is not listed."""
    files = Storage(spark, state)
    if not files.exists(f"{state}/{marker}"):
        raise ValueError(f"no inventory in {state}")
    sealed = files.json(f"{state}/{marker}")
    now = {r.name: r.asDict() for r in digests(spark, f"{state}/accepted").collect()} if files.names(f"{state}/accepted") else {}
    listed = {e["name"]: e for e in sealed["shards"]}
    for name in sorted(now.keys() | listed.keys()):
        if now.get(name) != listed.get(name):
            raise ValueError(f"{name} is {'missing' if name not in now else 'unexpected' if name not in listed else 'changed'}")
    for name in sorted({*sealed["documents"], *(n for n in files.names(state) if n.endswith(".json") and n != marker)}):
        if name not in sealed["documents"] or not files.exists(f"{state}/{name}") or files.json(f"{state}/{name}") != sealed["documents"][name]:
            raise ValueError(f"{name} differs from the inventory")
    return sealed


def sealed_shards(spark: SparkSession, state: str, marker: str = "inventory.json", tries: int = 5) -> tuple[dict, DataFrame | None]:
    """(inventory, rows of the shards it lists), read without a lock: the marker is compared before and after the files were looked at.

    Shards are immutable, so rows of listed shards cannot change later; files beside them are not read.
    """
    files = Storage(spark, state)
    for _ in range(tries):
        before = files.read(f"{state}/{marker}")
        body = json.loads(before)
        here = set(files.names(f"{state}/accepted"))
        if files.read(f"{state}/{marker}") == before:
            gone = sorted(e["name"] for e in body["shards"] if e["name"] not in here)
            if gone:
                raise ValueError(f"sealed shards are missing: {gone[:3]}")
            paths = [f"{state}/accepted/{e['name']}" for e in body["shards"]]
            return body, spark.read.parquet(*paths) if paths else None
    raise RuntimeError("the inventory changed at every try")


def read_back(check: Callable[[], object], tries: int = 12, pause: float = 5.0, sleep: Callable[[float], None] = time.sleep) -> object:
    """The result of ``check`` once it passes; storage that lags behind gets ``tries`` chances."""
    for k in range(tries):
        try:
            return check()
        except (ValueError, FileNotFoundError):
            if k == tries - 1:
                raise
            sleep(pause)
    raise ValueError("no tries")


def verify_remote(spark: SparkSession, local: str, remote: str) -> dict:
    """The sealed inventory of a remote state, after its own files and the local inventory were compared with it."""
    here, there = verify_state(spark, local), verify_state(spark, remote)
    if here != there:
        names = lambda x: {e["name"]: e for e in x["shards"]} | x["documents"]
        a, b = names(here), names(there)
        raise ValueError(f"the remote copy differs in {sorted(k for k in a.keys() | b.keys() if a.get(k) != b.get(k))[:3]}")
    return there


def restore(spark: SparkSession, remote: str, target: str) -> dict:
    """Copy a sealed remote state into a folder that is not there yet, verify it, and tell how far the run is.

    Works offline from the copy: the status holds accepted rows, the target and what is pending. A copy that fails verification is removed.
    """
    files = Storage(spark, target)
    if files.exists(target):
        raise FileExistsError(target)
    sealed = verify_state(spark, remote)
    try:
        source = Storage(spark, remote)
        files.make(f"{target}/accepted")
        for e in sealed["shards"]:
            source.copy(f"{remote}/accepted/{e['name']}", f"{target}/accepted/{e['name']}")
        for name, body in sealed["documents"].items():
            files.write_new(f"{target}/{name}", document(body))
        files.write_new(f"{target}/inventory.json", document(sealed))
        verify_state(spark, target)
    except BaseException:
        files.delete(target)
        raise
    return status(spark, target)


def status(spark: SparkSession, state: str) -> dict:
    body, rows = sealed_shards(spark, state)
    run = body["documents"].get("run_manifest.json", {})
    accepted = rows.select("run_id").distinct().count() if rows is not None else 0
    return {"run_instance_id": run.get("run_instance_id"), "accepted_rows": accepted, "target_rows": run.get("target_rows"), "pending_rows": max((run.get("target_rows") or 0) - accepted, 0), "shards": len(body["shards"])}
