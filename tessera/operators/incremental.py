"""Incremental builds: what changed since the last build, and which cached results still hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FILE = ["topic", "filename"]


def manifest_diff(current: DataFrame, stored: DataFrame) -> DataFrame:
    """``topic, filename, change``: ``changed`` (new or later), ``unchanged`` or ``removed``; both sides ``topic, filename, mtime``."""
    cur = current.groupBy(*FILE).agg(F.max("mtime").alias("now"))
    old = stored.groupBy(*FILE).agg(F.max("mtime").alias("then"))
    seen = cur.join(old, FILE, "left").select(*FILE, F.when(F.coalesce("now", F.lit(0.0)) > F.coalesce("then", F.lit(0.0)), "changed").otherwise("unchanged").alias("change"))
    return seen.unionByName(old.join(cur, FILE, "left_anti").select(*FILE, F.lit("removed").alias("change")))


def cache_sync(live: DataFrame, cached: DataFrame, keys: list[str]) -> DataFrame:
    """``*keys, action``: ``keep`` where the cached hash is that of the text, ``encode`` where not, ``drop`` what is gone.

    live: ``*keys, text``; cached: ``*keys, sha1``.
    """
    now = live.select(*keys, F.sha1(F.coalesce("text", F.lit("")).cast("binary")).alias("h"))
    both = now.join(cached.select(*keys, "sha1"), keys, "left").select(*keys, F.when(F.col("h") == F.col("sha1"), "keep").otherwise("encode").alias("action"))
    return both.unionByName(cached.join(now, keys, "left_anti").select(*keys, F.lit("drop").alias("action")))


def capped_documents(files: DataFrame, cap: int = 50) -> DataFrame:
    """The first ``cap`` file names of each topic, which a full build takes; one row per name."""
    names = files.where("filename is not null").select(*FILE).distinct()
    return names.withColumn("place", F.row_number().over(W.partitionBy("topic").orderBy("filename")).cast("long")).where(F.col("place") <= cap)


def topic_overview(raw: DataFrame, graph: DataFrame, tasks: DataFrame | None = None) -> DataFrame:
    """``topic, n_files, n_entities, status``: topics that have files or a graph; a running task goes before a graph, that before idle."""
    files = raw.groupBy("topic").agg(F.count("*").alias("n_files"))
    nodes = graph.groupBy("topic").agg(F.count("*").alias("n_entities"))
    both = files.join(nodes, "topic", "full").na.fill(0, ["n_files", "n_entities"])
    state = F.when(F.col("n_entities") > 0, "ready").otherwise("idle")
    if tasks is None:
        return both.withColumn("status", state)
    return both.join(tasks.select("topic", F.col("status").alias("task")), "topic", "left").withColumn("status", F.coalesce("task", state)).drop("task")
