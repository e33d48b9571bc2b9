"""Session helpers: local test sessions, the shared scratch folder, written intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", name: str = "tessera", memory: str = "6g", **conf: str) -> SparkSession:
    """A session on this machine, for tests and the bench; on a cluster the caller's session is used as it is."""
    n = os.cpu_count() if cores == "*" else int(cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for k, v in conf.items():
        builder = builder.config(k.replace("__", "."), v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` as the session names it.

    Where it is unset, a temporary folder is used on a local master only; on a cluster that would
    be a folder of one machine, so an error is raised instead.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    set_before = spark.sparkContext.getCheckpointDir()
    if set_before:
        return set_before.rsplit("/", 1)[0]
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="tessera-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = "file://" + folder
    spark.sparkContext.setCheckpointDir(path)
    return path


class Scratch:
    """Intermediate tables written to the shared folder, to cut lineage and to survive lost executors.

    A table can be dropped as soon as no later step reads it, so loops hold two rounds at a time.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        _LEFT[self.base] = self

    def write(self, df: DataFrame, label: str = "t") -> DataFrame:
        """Writes ``df`` as Parquet and returns a reader of it; its path is kept in ``last``."""
        self.count += 1
        self.last = f"{self.base}/{label}-{self.count}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.last)
        return self.spark.read.schema(df.schema).parquet(self.last)

    def drop(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        jsc = self.spark.sparkContext._jsc  # none once the session has been stopped
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(jsc.hadoopConfiguration() if jsc else jvm.org.apache.hadoop.conf.Configuration()).delete(target, True)

    def clear(self) -> None:
        """Drops all tables of this scratch, once nothing reads them any more."""
        self.drop(self.base)
        _LEFT.pop(self.base, None)


_LEFT: dict[str, Scratch] = {}  # scratch folders of this process that are still there


@atexit.register
def _clear_all() -> None:
    """Removes what is left in the shared folder when the driver ends."""
    for scratch in list(_LEFT.values()):
        try:
            scratch.clear()
        except Exception:  # the session is gone; nothing more can be done from here
            return
