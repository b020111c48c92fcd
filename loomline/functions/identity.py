"""Stable ids and seeds: hashes over NUL-joined parts. Null parts give a null id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _hash(*parts: Column) -> Column:
    out = [parts[0]]
    for p in parts[1:]:
        out += [F.lit("\x00"), p]
    return F.sha2(F.concat(*out), 256)  # concat, unlike concat_ws, is null if a part is


def source_record_id(file: Column, row: Column, trial: Column, run: Column, task: Column, fingerprint: Column) -> Column:
    return F.concat(F.lit("source-"), F.substring(_hash(F.lit("source-row"), file, row.cast("string"), trial, run, task, fingerprint), 1, 24))


def synthetic_id(record_id: Column, index: Column) -> Column:
    return F.concat(F.lit("refined-"), F.substring(_hash(F.lit("refinement"), record_id, index.cast("string")), 1, 24))


def seed_of(digest: Column) -> Column:
    """31 bits of a hex digest: its first four bytes, big-endian, without the sign."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint").bitwiseAND(F.lit(0x7FFFFFFF))


def attempt_seed(synthetic: Column, attempt: Column) -> Column:
    return seed_of(_hash(synthetic, F.lit("attempt"), attempt.cast("string")))


def variant_seed(variant: Column) -> Column:
    return seed_of(F.sha2(variant, 256))


def variant_id(task: Column, index: Column) -> Column:
    return F.concat(task, F.lit("-v"), index.cast("string"), F.lit("-"), F.substring(F.sha2(F.concat(task, F.lit("::"), index.cast("string")), 256), 1, 16))


def task_of_variant(variant: Column) -> Column:
    return F.regexp_extract(variant, r"^(.*)-v\d+-", 1)


def is_sha256(c: Column) -> Column:
    return c.rlike("^[0-9A-Fa-f]{64}$")
