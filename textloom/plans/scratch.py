"""Intermediate tables in the folder that all executors share.

Iterative operators cut their lineage by writing a table and reading it again. The files lie in
the folder named by ``spark.checkpoint.dir``, so a lost executor costs at most the tasks it ran.
Only where that setting is missing (local tests) is a temporary folder made.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a local one is made and set where there is none."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="textloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = "file://" + folder
    spark.conf.set("spark.checkpoint.dir", path)
    return path


#: Folders made by this process. Results are read from them, so they stay until ``clear`` is called.
_MADE: list[str] = []


def clear(spark: SparkSession) -> None:
    """Delete the folders of all operators run so far, once no result of theirs is needed any more."""
    while _MADE:
        Scratch(spark, "", _MADE.pop()).drop("")


class Scratch:
    """Tables of one run of an operator, in a folder of its own."""

    def __init__(self, spark: SparkSession, label: str, root: str | None = None) -> None:
        """A new folder below the shared one, or the folder ``root``, which may hold tables of an earlier session."""
        self.spark = spark
        self.root = root.rstrip("/") if root else f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        if not root:
            _MADE.append(self.root)

    def path(self, key: str) -> str:
        return f"{self.root}/{key}"

    def write(self, df: DataFrame, key: str, partition_by: list[str] | None = None) -> DataFrame:
        """Write ``df`` once and return it as read from there."""
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(self.path(key))
        return self.read(key, df)

    def read(self, key: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(key))

    def _file(self, key: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(key))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def drop(self, key: str) -> None:
        """Remove a table that nothing reads any more."""
        system, path = self._file(key)
        system.delete(path, True)

    def save(self, key: str, text: str) -> None:
        """A small text file, written beside its place and then moved there, so a reader sees the old one or the new."""
        system, path = self._file(key)
        _, beside = self._file(f"{key}.new")
        out = system.create(beside, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        system.delete(path, False)
        system.rename(beside, path)

    def load(self, key: str) -> str | None:
        """What ``save`` wrote; null if there is none."""
        for name in (key, f"{key}.new"):  # the second one, where a writer stopped before its move
            system, path = self._file(name)
            if system.exists(path):
                stream = system.open(path)
                try:
                    return bytes(stream.readAllBytes()).decode()
                finally:
                    stream.close()
        return None
