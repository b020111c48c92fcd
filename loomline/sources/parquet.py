"""Parquet sources with a fixed schema and physical row coordinates."""

from __future__ import annotations

import glob
import os

import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED = ("conversations", "run_id", "task", "trial_name")


def resolve(source: str) -> list[str]:
    """Sorted Parquet files of a glob, a folder or a file; an error if there are none."""
    path = source.removeprefix("file:")
    found = [path] if os.path.isfile(path) else glob.glob(path if glob.has_magic(path) else f"{path}/*.parquet")
    if not found:
        raise FileNotFoundError(f"no Parquet files at {source}")
    return sorted(found)


def footer_rows(files: list[str]) -> int:
    return sum(pq.ParquetFile(f).metadata.num_rows for f in files)


def uniform_schema(files: list[str], required: tuple[str, ...] = REQUIRED):
    """The schema all footers share; a differing file or a missing column is an error."""
    first = pq.read_schema(files[0])
    for f in files[1:]:
        if not pq.read_schema(f).equals(first):
            raise ValueError(f"schema of {f} differs from {files[0]}")
    missing = [c for c in required if c not in first.names]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return first


def read(spark: SparkSession, source: str, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    files = resolve(source)
    uniform_schema(files, required)
    return spark.read.parquet(*files)


def with_coordinates(df: DataFrame, canonical: dict[str, str] | None = None) -> DataFrame:
    """``source_file`` and ``source_row_index`` of each row as it lies in its file.

    ``canonical`` maps local file names to the names they are known by (copies keep their identity).
    """
    name = F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/")
    out = df.select("*", name.alias("_file"), F.col("_metadata.row_index").alias("source_row_index"))
    if not canonical:
        return out.withColumnRenamed("_file", "source_file")
    pairs = df.sparkSession.createDataFrame(list(canonical.items()), "_local string, source_file string")
    base = F.element_at(F.split("_file", "/"), -1)
    out = out.join(F.broadcast(pairs), base == F.col("_local"), "left").drop("_local")  # one row per file
    return out.withColumn("source_file", F.coalesce("source_file", "_file")).drop("_file")
