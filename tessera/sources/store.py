"""Folders of tables on any file system Spark reaches, replaced whole by switching a pointer."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: File that names the version of a table that holds.
POINTER = "_CURRENT"


class Store:
    """A folder on a local disk, HDFS or an object store, by the Hadoop file system of its address.

    A table is a folder of versions; a new one is written beside the old one, then the pointer is replaced by one file
    write.  A failure while rows are written leaves the old version; versions before the last two are dropped.  The pointer
itself is overwritten: where the file system does not do that atomically, a crash at that moment can leave it empty, which
reads as an empty table, though both versions are still there.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, str(root).rstrip("/")

    def _at(self, *parts: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path("/".join((self.root, *(p for p in parts if p))))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def exists(self, name: str) -> bool:
        fs, path = self._at(name)
        return fs.exists(path)

    def folders(self, name: str = "") -> list[str]:
        """Names of the folders in a folder; none where it does not exist."""
        fs, path = self._at(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()) if fs.exists(path) else []

    def read_text(self, name: str) -> str | None:
        fs, path = self._at(name)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_text(self, name: str, text: str) -> None:
        fs, path = self._at(name)
        stream = fs.create(path, True)
        try:
            stream.write(bytearray(text.encode("utf-8")))
        finally:
            stream.close()

    def version(self, name: str) -> str | None:
        """The version of a table that holds; None where it was never written."""
        return (self.read_text(f"{name}/{POINTER}") or "").strip() or None

    def table(self, name: str, schema: str) -> DataFrame:
        """A table; empty where it was never written."""
        version = self.version(name)
        reader = self.spark.read.schema(schema)
        return reader.parquet(f"{self.root}/{name}/{version}") if version else self.spark.createDataFrame([], schema)

    def append(self, name: str, rows: DataFrame) -> None:
        """Adds rows to the version of a table that holds, or writes its first one."""
        version = self.version(name)
        if version:
            rows.write.mode("append").parquet(f"{self.root}/{name}/{version}")
        else:
            self.replace(name, rows)

    def replace(self, name: str, rows: DataFrame) -> None:
        """Writes a new version, which the rows may be read from the old one for, and switches to it."""
        before, fresh = self.version(name), f"v-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{name}/{fresh}")
        self.write_text(f"{name}/{POINTER}", fresh)
        for old in self.folders(name):
            if old not in (before, fresh):
                fs, path = self._at(name, old)
                fs.delete(path, True)
