"""Results that several steps read: written once to the session's reliable checkpoint folder."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where that is unset, a local session gets a folder beside the warehouse, and a cluster an error."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_checkpoints")
    return sc.getCheckpointDir()


def materialized(df: DataFrame) -> DataFrame:
    """``df`` (a pool, a run, judgements: rows by query, not by document; or an index) computed once, into the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Folder:
    """A folder of small files in any store that Spark can open, seen from the driver."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm = spark.sparkContext._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path(path)
        self.files = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _of(self, name: str | None):
        return self.path if name is None else self.jvm.org.apache.hadoop.fs.Path(self.path, name)

    def is_file(self) -> bool:
        return self.files.exists(self.path) and self.files.getFileStatus(self.path).isFile()

    def names(self) -> list[str]:
        return [f.getPath().getName() for f in self.files.listStatus(self.path)] if self.files.exists(self.path) else []

    def text(self, name: str) -> str:
        stream = self.files.open(self._of(name))
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def make(self, name: str, text: str) -> bool:
        """Makes a file; False if it is there."""
        try:
            stream = self.files.create(self._of(name), False)
        except Exception as error:  # the store's own class for a file that exists
            if "exist" in str(error).lower():
                return False
            raise
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()
        return True

    def delete(self, name: str | None = None) -> None:
        self.files.delete(self._of(name), True)
