"""Operators on the property graph: nodes ``topic, id, ...`` and directed labelled edges ``topic, src, label, dst, ...``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NODE = ["topic", "id"]


def edge_ends(edges: DataFrame) -> DataFrame:
    """Both ends of each edge, one row each: ``topic, id``.  A self-loop gives its node twice."""
    return edges.select("topic", F.explode(F.array("src", "dst")).alias("id"))


def degrees(edges: DataFrame) -> DataFrame:
    """``topic, id, degree``: incident edge ends; missing nodes count, isolated ones do not appear."""
    return edge_ends(edges).groupBy(*NODE).agg(F.count("*").alias("degree"))


def with_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.drop("degree").join(degrees(edges), NODE, "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are nodes."""
    ids = nodes.select(*NODE).distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), ["topic", "src"], "left_semi").join(ids.withColumnRenamed("id", "dst"), ["topic", "dst"], "left_semi")


def undirected(edges: DataFrame) -> DataFrame:
    """One edge per unordered pair, without loops; label and description are those of the last edge by ``ord``."""
    pair = edges.where("src <> dst").groupBy("topic", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    return pair.agg(F.max_by(F.struct("label", "description"), "ord").alias("last"), F.count("*").alias("n_edges")).select("topic", "a", "b", "last.label", "last.description", "n_edges")


def top_hubs(nodes: DataFrame, edges: DataFrame, k: int = 15) -> DataFrame:
    """The ``k`` best-connected nodes of each topic; ties go to the earlier node."""
    place = F.row_number().over(W.partitionBy("topic").orderBy(F.desc("degree"), "ord", "id"))
    nodes = nodes.withColumn("type", F.coalesce(F.nullif(F.col("type"), F.lit("")), F.lit("OTHER")))
    return with_degree(nodes, edges).withColumn("place", place).where(F.col("place") <= k)


def neighbours(edges: DataFrame, nodes: DataFrame, loops_once: bool = True) -> DataFrame:
    """``topic, id, direction, label, other, other_type, description, ord``: every edge seen from its ends.

    A missing neighbour has its id for a name and the type ENTITY; a self-loop counts as outgoing only if ``loops_once``.
    """
    out = edges.select("topic", F.col("src").alias("id"), F.lit("out").alias("direction"), "label", F.col("dst").alias("other"), "description", "ord")
    into = edges.where("src <> dst") if loops_once else edges
    into = into.select("topic", F.col("dst").alias("id"), F.lit("in").alias("direction"), "label", F.col("src").alias("other"), "description", "ord")
    types = nodes.select("topic", F.col("id").alias("other"), F.col("type").alias("other_type"))
    return out.unionByName(into).join(types, ["topic", "other"], "left").withColumn("other_type", F.coalesce("other_type", F.lit("ENTITY")))


def ego_network(edges: DataFrame, centers: DataFrame) -> DataFrame:
    """``topic, center, id, hops``: each center (hops 0) with its direct neighbours (1)."""
    c = centers.select("topic", F.col("id").alias("center")).distinct()
    ends = edges.select("topic", F.col("src").alias("center"), F.col("dst").alias("id")).unionByName(edges.select("topic", F.col("dst").alias("center"), F.col("src").alias("id")))
    near = ends.where("center <> id").join(c, ["topic", "center"], "left_semi").distinct().withColumn("hops", F.lit(1))
    return c.select("topic", "center", F.col("center").alias("id"), F.lit(0).alias("hops")).unionByName(near)


def health_report(nodes: DataFrame, edges: DataFrame, communities: DataFrame) -> DataFrame:
    """One row per topic: nodes, edges, communities, orphans, dangling edges and the share of typed nodes."""
    sound = valid_edges(edges, nodes)
    orphans = nodes.select(*NODE).join(edge_ends(sound).distinct(), NODE, "left_anti").groupBy("topic").agg(F.count("*").alias("orphans"))
    typed = F.coalesce((F.col("type") != "") & (F.col("type") != "OTHER"), F.lit(False))
    base = nodes.groupBy("topic").agg(F.count("*").alias("entities"), F.round(F.avg(typed.cast("double")), 3).alias("typed_ratio"))
    n_edges = edges.groupBy("topic").agg(F.count("*").alias("edges"))
    n_sound = sound.groupBy("topic").agg(F.count("*").alias("sound"))
    n_comm = communities.where("community is not null").groupBy("topic").agg(F.countDistinct("community").alias("communities"))
    out = base.join(n_edges, "topic", "left").join(n_sound, "topic", "left").join(orphans, "topic", "left").join(n_comm, "topic", "left").na.fill(0)
    return out.select("topic", "entities", "edges", "communities", "orphans", (F.col("edges") - F.col("sound")).alias("dangling"), "typed_ratio")


def drawn_degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``topic, id, degree``: links of the drawn graph, one per pair of different nodes; a node without any counts as having one."""
    pairs = undirected(valid_edges(edges, nodes))
    d = pairs.select("topic", F.explode(F.array("a", "b")).alias("id")).groupBy(*NODE).agg(F.count("*").alias("degree"))
    return nodes.select(*NODE).distinct().join(d, NODE, "left").withColumn("degree", F.coalesce("degree", F.lit(1).cast("long")))


def node_radius(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``topic, id, radius``: 8 to 36 by degree of the drawn graph within the topic."""
    d = drawn_degrees(nodes, edges)
    ends = d.groupBy("topic").agg(F.min("degree").alias("lo"), F.max("degree").alias("hi"))
    spread = F.col("hi") - F.col("lo")
    return d.join(ends, "topic").select(*NODE, F.round(8 + 28 * (F.col("degree") - F.col("lo")) / F.when(spread == 0, 1).otherwise(spread), 6).alias("radius"))


def type_colours(nodes: DataFrame, palette: int = 15) -> DataFrame:
    """``topic, type, colour``: index into a palette, types in the order of their first node; nodes without a type take no place.

    OTHER, if it is no type of the topic, has the colour -1, which stands for the fixed colour of the rest.
    """
    first = nodes.where(F.coalesce("type", F.lit("")) != "").groupBy("topic", "type").agg(F.min("ord").alias("first_ord"))
    place = F.row_number().over(W.partitionBy("topic").orderBy("first_ord", "type")) - 1  # one row a type
    named = first.select("topic", "type", (place % palette).cast("long").alias("colour"))
    rest = nodes.select("topic").distinct().withColumn("type", F.lit("OTHER"))
    return named.unionByName(rest.join(first, ["topic", "type"], "left_anti").select("topic", "type", F.lit(-1).cast("long").alias("colour")))


def visible_labels(nodes: DataFrame, edges: DataFrame, slider: int) -> DataFrame:
    """``topic, a, b, label, description, n_edges``: the drawn links whose label is shown: both ends have at least ``10 - slider`` links."""
    d = drawn_degrees(nodes, edges)
    near, far = (d.select("topic", F.col("id").alias(x), F.col("degree").alias(f"d_{x}")) for x in "ab")
    out = undirected(valid_edges(edges, nodes)).join(near, ["topic", "a"]).join(far, ["topic", "b"])
    return out.where(F.least("d_a", "d_b") >= 10 - slider).drop("d_a", "d_b")


def without_types(nodes: DataFrame, edges: DataFrame, hidden: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes that are not of a hidden type, and the edges between them."""
    shown = nodes.where(~F.coalesce(F.col("type").isin(*hidden), F.lit(False))) if hidden else nodes
    return shown, valid_edges(edges, shown)


def intra_community_edges(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """Edges within one community: ``topic, community, src, label, dst, description, ord``."""
    a = assignment.where("community is not null").select(*NODE, "community").distinct()
    one = a.withColumnRenamed("id", "src").withColumnRenamed("community", "c_src")
    two = a.withColumnRenamed("id", "dst").withColumnRenamed("community", "c_dst")
    return edges.join(one, ["topic", "src"]).join(two, ["topic", "dst"]).where("c_src = c_dst").select("topic", F.col("c_src").alias("community"), "src", "label", "dst", "description", "ord")


def relationship_lines(edges: DataFrame, assignment: DataFrame, both_ways: bool = False) -> DataFrame:
    """``topic, community, line``: distinct text lines of the edges within a community.

    ``both_ways`` gives each line in both directions, as an undirected traversal would.
    """
    e = intra_community_edges(edges, assignment)
    if both_ways:
        e = e.unionByName(e.withColumns({"src": F.col("dst"), "dst": F.col("src")}))
    tail = F.when(F.coalesce(F.col("description"), F.lit("")) != "", F.concat(F.lit(" ("), F.col("description"), F.lit(")"))).otherwise("")
    return e.select("topic", "community", F.concat(F.col("src"), F.lit(" --["), F.col("label"), F.lit("]--> "), F.col("dst"), tail).alias("line")).distinct()
