"""Table mutations of the graph: merging extracted rows into nodes and edges, and taking sources out again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def folded_text(parts: Column) -> Column:
    """Ordered texts joined by blanks; a text that is empty or already contained in what was joined is left out."""
    step = lambda acc, d: F.when((d == "") | F.contains(acc, d), acc).when(acc == "", d).otherwise(F.concat(acc, F.lit(" "), d))
    return F.aggregate(parts, F.lit("").cast("string"), step)


def _ordered_firsts(rows: DataFrame, keys: list[str], value: str, ord_col: str, name: str) -> DataFrame:
    """Distinct values per key in the order of their first row; repeats are gone before anything is collected."""
    first = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(ord_col).alias("_ord"))
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_ord", F.col(value).alias("v")))), lambda x: x.v).alias(name))


def upsert_nodes(extracted: DataFrame, keys: tuple[str, ...] = ("topic", "id")) -> DataFrame:
    """Nodes from extracted rows ``topic, id, name, type, description, source, ord``.

    The first row by ``ord`` gives name and type; descriptions are folded in order; sources are the
    distinct ones in order.  Repeated descriptions and sources are reduced before they are collected.
    """
    k = list(keys)
    first = extracted.groupBy(*k).agg(F.min_by(F.struct("name", "type"), "ord").alias("f"), F.min("ord").alias("ord"))
    texts = _ordered_firsts(extracted, k, "description", "ord", "texts")
    sources = _ordered_firsts(extracted.where("source <> ''"), k, "source", "ord", "sources")
    out = first.join(texts, k, "left").join(sources, k, "left")
    empty = F.array().cast("array<string>")
    return out.select(*k, "f.name", "f.type", folded_text(F.coalesce("texts", empty)).alias("description"), F.coalesce("sources", empty).alias("sources"), "ord")


def upsert_edges(rows: DataFrame) -> DataFrame:
    """One edge per ``topic, src, label, dst``; the last row by ``ord`` gives its description."""
    return rows.groupBy("topic", "src", "label", "dst").agg(F.max_by("description", "ord").alias("description"), F.min("ord").alias("ord"))


def collapse_edges(rows: DataFrame) -> DataFrame:
    """One edge per key, with the descriptions of all its rows folded in order."""
    k = ["topic", "src", "label", "dst"]
    first = rows.groupBy(*k).agg(F.min("ord").alias("ord"), F.count("*").alias("n_rows"))
    texts = _ordered_firsts(rows, k, "description", "ord", "texts")
    return first.join(texts, k, "left").select(*k, folded_text(F.coalesce("texts", F.array().cast("array<string>"))).alias("description"), "n_rows", "ord")


def missing_endpoints(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Names that a document's relations use but its entities lack: ``topic, filename, name``; they become nodes of type ENTITY."""
    k = ["topic", "filename", "name"]
    used = relations.select("topic", "filename", F.explode(F.array("src", "dst")).alias("name")).where("name <> ''").distinct()
    return used.join(entities.select(*k).distinct(), k, "left_anti")


def removal_counts(nodes: DataFrame, edges: DataFrame, left: tuple[DataFrame, DataFrame]) -> DataFrame:
    """``topic, nodes_removed, edges_removed, nodes_trimmed`` of a removal of sources, for topics in which anything changed."""
    alive, rest = left
    n = lambda df, name: df.groupBy("topic").agg(F.count("*").alias(name))
    before = n(nodes, "n0").join(n(alive, "n1"), "topic", "left").join(n(edges, "e0"), "topic", "left").join(n(rest, "e1"), "topic", "left").join(n(alive.where("trimmed"), "nodes_trimmed"), "topic", "left").na.fill(0)
    out = before.select("topic", (F.col("n0") - F.col("n1")).alias("nodes_removed"), (F.col("e0") - F.col("e1")).alias("edges_removed"), "nodes_trimmed")
    return out.where("nodes_removed + edges_removed + nodes_trimmed > 0")


def remove_sources(nodes: DataFrame, edges: DataFrame, removed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes without the removed files (``topic, source``) and the edges that remain.

    Nodes left without a source are deleted with their edges; nodes that never had one stay.  ``trimmed`` tells whether
    a surviving node lost a source.  The removed files of a node are found by a join, so their number is not limited.
    """
    keys = ["topic", "id"]
    each = nodes.select(*keys, F.posexplode("sources").alias("pos", "source"))
    gone = removed.select("topic", "source").distinct().withColumn("gone", F.lit(1))
    marked = each.join(gone, ["topic", "source"], "left")
    kept = marked.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("gone").isNull(), F.struct("pos", "source")))), lambda x: x.source).alias("kept"),
        F.sum(F.coalesce("gone", F.lit(0))).alias("n_gone"),
    )
    out = nodes.join(kept, keys, "left").withColumn("trimmed", F.coalesce(F.col("n_gone") > 0, F.lit(False)))
    dead = F.col("trimmed") & (F.size("kept") == 0)
    alive = out.where(~dead).withColumn("sources", F.coalesce("kept", "sources")).drop("kept", "n_gone")
    lost = out.where(dead).select(*keys)
    rest = edges.join(lost.withColumnRenamed("id", "src"), ["topic", "src"], "left_anti").join(lost.withColumnRenamed("id", "dst"), ["topic", "dst"], "left_anti")
    return alive, rest
