"""Small control documents on the driver: inventories, sealed snapshots, digests over ordered identities."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid

from loomline.operators.publish import atomic_json, file_sha256, ordered_digest  # noqa: F401


def inventory(folder: str, before: dict[str, dict] | None = None) -> dict[str, dict]:
    """path -> size and sha256 of every file under ``folder``.

    A file whose size and modification time are those of ``before`` keeps its digest; files of ``before`` that are gone are an error.
    """
    before, out = before or {}, {}
    for root, _, files in os.walk(folder):
        for name in files:
            path = os.path.join(root, name)
            rel = os.path.relpath(path, folder)
            if rel.split(os.sep)[0].startswith(".") or name == "inventory.json":
                continue
            stat, old = os.stat(path), before.get(rel)
            same = old and old["size"] == stat.st_size and old["mtime_ns"] == stat.st_mtime_ns
            out[rel] = {"size": stat.st_size, "mtime_ns": stat.st_mtime_ns, "sha256": old["sha256"] if same else file_sha256(path)}
    gone = set(before) - set(out)
    if gone:
        raise ValueError(f"files are missing: {sorted(gone)[:3]}")
    return dict(sorted(out.items()))


def inventory_digest(files: dict[str, dict]) -> str:
    h = hashlib.sha256()
    for path, e in sorted(files.items()):
        h.update(f"{path}\0{e['size']}\0{e['sha256']}\n".encode())
    return h.hexdigest()


def seal(folder: str) -> dict:
    """Write the inventory of a folder; it is complete once the document is there."""
    files = inventory(folder)
    body = {"files": files, "digest": inventory_digest(files)}
    atomic_json(f"{folder}/inventory.json", body)
    return body


def verify(folder: str) -> dict:
    """The sealed inventory, after the folder was compared with it; differing, missing or unexpected files are errors."""
    with open(f"{folder}/inventory.json", encoding="utf-8") as f:
        sealed = json.load(f)
    now = inventory(folder)
    for path in sorted(set(now) | set(sealed["files"])):
        a, b = sealed["files"].get(path), now.get(path)
        if not a or not b:
            raise ValueError(f"{path} is {'missing' if a else 'unexpected'}")
        if a["sha256"] != b["sha256"]:
            raise ValueError(f"{path} has changed")
    if inventory_digest(sealed["files"]) != sealed["digest"]:
        raise ValueError("the inventory's digest is wrong")
    return sealed


def snapshot(source: str, target: str) -> dict:
    """A sealed copy of a folder, promoted in one rename; a race for the same target leaves the first one."""
    staging = f"{target}.staging-{uuid.uuid4().hex}"
    shutil.copytree(source, staging)
    body = seal(staging)
    try:
        os.rename(staging, target)
    except OSError:
        shutil.rmtree(staging)
        body = verify(target)
    return body


class SingleWriter:
    """A lock file: one writer at a time, released at the end of the block."""

    def __init__(self, path: str):
        self.path = path

    def __enter__(self):
        import fcntl

        self.file = open(self.path, "w")  # noqa: SIM115
        try:
            fcntl.flock(self.file, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError as e:
            self.file.close()
            raise RuntimeError("another writer holds the lock") from e
        return self

    def __exit__(self, *_):
        self.file.close()
