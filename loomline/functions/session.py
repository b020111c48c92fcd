"""Session helpers: table access and the shared folder for cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder (a file or a folder of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named by ``spark.checkpoint.dir``.

    Only where the session names none (local tests) a temporary folder is made and set.
    """
    set_dir = spark.sparkContext.getCheckpointDir()
    if set_dir:
        return set_dir
    named = spark.conf.get("spark.checkpoint.dir", None)
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="loomline-"))
    return spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    Like ``checkpoint()`` it ends the lineage on storage that outlives any executor, but it
    keeps the columnar reader (pruning, push-down) for what follows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Batches of at most ``rows`` rows, read from Parquet or handed to Python, in what is run inside.

    Wide rows would else fill much memory on both sides of a Python task: the reader holds the texts of a batch in single arrays.
    """
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = {name: spark.conf.get(name) for name in names}
    for name, value in before.items():
        spark.conf.set(name, str(min(rows, int(value)) if int(value) > 0 else rows))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
