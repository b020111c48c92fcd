"""Small files on shared storage, through Hadoop's file API: the same on a local disk, HDFS or an object store."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Storage:
    """Files of one file system, named by whole paths. Only small documents pass through the driver."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._gateway = spark._jvm, spark.sparkContext._gateway
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        path = self._path(self.root)
        self._fs = path.getFileSystem(self._conf)
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def names(self, folder: str) -> list[str]:
        """Sorted names in a folder, without hidden ones; empty if there is no folder."""
        if not self.exists(folder):
            return []
        found = (s.getPath().getName() for s in self._fs.listStatus(self._path(folder)))
        return sorted(n for n in found if not n.startswith((".", "_")))

    def make(self, folder: str) -> None:
        self._fs.mkdirs(self._path(folder))

    def size(self, path: str) -> int:
        return self._fs.getFileStatus(self._path(path)).getLen()

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def json(self, path: str) -> dict:
        return json.loads(self.read(path))

    def _stage(self, path: str, text: str) -> str:
        folder, name = path.rsplit("/", 1)
        self.make(folder)
        staged = f"{folder}/.{name}.{uuid.uuid4().hex}"
        stream = self._fs.create(self._path(staged), False)
        try:
            stream.write(bytearray(text.encode("utf-8")))
            stream.hsync()
        finally:
            stream.close()
        return staged

    def move(self, source: str, target: str, overwrite: bool = False) -> None:
        """Rename in one step; FileExistsError if the target is there, unless ``overwrite``."""
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self._gateway.new_array(rename, 1 if overwrite else 0)
        if overwrite:
            options[0] = rename.OVERWRITE
        elif self.exists(target):
            raise FileExistsError(target)
        try:
            self._context.rename(self._path(source), self._path(target), options)
        except Exception as e:
            if "already exist" in str(e) or "FileAlreadyExists" in str(e):
                raise FileExistsError(target) from e
            raise

    def write_new(self, path: str, text: str) -> None:
        """A file that must not be there yet; readers see all of it or nothing."""
        staged = self._stage(path, text)
        try:
            self.move(staged, path)
        except BaseException:
            self.delete(staged)
            raise

    def write(self, path: str, text: str) -> None:
        """Write or replace in one step; readers see the old or the new document."""
        self.move(self._stage(path, text), path, overwrite=True)

    def copy(self, source: str, target: str) -> None:
        """Copy one file; the bytes pass through the driver."""
        a, b = self._path(source), self._path(target)
        self._jvm.org.apache.hadoop.fs.FileUtil.copy(a.getFileSystem(self._conf), a, b.getFileSystem(self._conf), b, False, self._conf)

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)


def document(body: dict) -> str:
    return json.dumps(body, ensure_ascii=False, sort_keys=True, indent=1)


def digests(spark: SparkSession, folder: str, pattern: str = "*.parquet") -> DataFrame:
    """(name, bytes, sha256) of the files in a folder, hashed in the tasks. A file must be under 2 GB, as shards are."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def row_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(name, rows) of the Parquet files in a folder."""
    rows = spark.read.parquet(folder).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name"))
    return rows.groupBy("name").agg(F.count("*").alias("rows"))
