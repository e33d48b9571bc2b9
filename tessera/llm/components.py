"""Consolidating pairwise matches into groups: connected components of a pair table.

Plan.  (1) Every topic is a graph of its own, and its likeliest giant component is peeled first: from the
topic's vertex of highest degree a breadth-first search joins the frontier with the edges, for all topics at once, round by
round, until nothing new is reached or ``bfs_rounds`` are over.  What was reached gets that vertex as its label and is
anti-joined away; if the search was cut short, the edges that leave the reached part are kept with the reached part
contracted into that vertex, so no link is lost.  (2) The remaining small components are
labelled by minimum propagation with contraction: each vertex takes the least vertex among itself and its
neighbours in an order hashed anew each round, and the edges are rewritten to what their ends took.  A
chain of n vertices takes about log n rounds in whatever order its names are, not n.  (3) Each component
takes its smallest name.

Scale.  Edges are stored once, distinct and oriented; a minimum over neighbours is a partial
aggregation, so a hub costs one row per map task; relabelling joins edges with a table that has one
row per vertex, whose edge side adaptive execution may split.  Only counts reach the driver.  Each
round is written to the shared scratch folder, which cuts lineage; rounds that nothing reads any more
are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.closure import both_ways, followed, minimum_pointers, oriented, rewritten, smallest_of_groups
from tessera.session import Scratch

KEY = ["topic", "name"]


def connected_groups(pairs: DataFrame, left: str = "alias", right: str = "canonical", bfs_rounds: int = 8) -> DataFrame:
    """``topic, name, group_name``: each non-blank name with the smallest name it is linked to, directly or not.

    pairs: ``topic`` and the two name columns; further columns are ignored.

    Defined edge cases: names are trimmed of outer spaces and otherwise compared exactly, the smaller by
    code point; a pair with a null or blank side links nothing, its other side still counts as a name;
    a pair of a name with itself, repeated and reversed pairs change nothing; a name without partner
    is its own group; a null topic is the same topic as the empty string; an empty table gives no rows.
    """
    spark = pairs.sparkSession
    scratch = Scratch(spark, "components")
    # Pairs whose two names differ, oriented from the smaller to the larger; the rest only name vertices.
    clean = pairs.select(F.coalesce("topic", F.lit("")).alias("topic"), F.trim(F.col(left)).alias("a"), F.trim(F.col(right)).alias("b"))
    vertices = (
        clean.select("topic", F.explode(F.array("a", "b")).alias("name")).where("name <> ''").distinct()
    )
    edges = scratch.write(oriented(clean.where("a <> '' and b <> ''")), "edges")
    labels, edges = _peel_giants(scratch, edges, bfs_rounds)
    pointers = minimum_pointers(scratch, edges)

    named = vertices.join(labels, KEY, "left") if labels is not None else vertices.withColumn("group_name", F.lit(None).cast("string"))
    named = followed(named.withColumn("group_name", F.coalesce("group_name", "name")), "group_name", pointers)
    return smallest_of_groups(scratch, named, "name", "group_name").select("topic", "name", "group_name")


def _peel_giants(scratch: Scratch, edges: DataFrame, rounds: int) -> tuple[DataFrame | None, DataFrame]:
    """What was reached in each topic with its label, the vertex that the search began at, and the edges that remain."""
    degree = both_ways(edges).groupBy(*KEY).agg(F.count("*").alias("degree"))
    hub = degree.groupBy("topic").agg(F.min_by("name", F.struct((-F.col("degree")).alias("d"), "name")).alias("name"))
    reached = scratch.write(hub.select("topic", "name", F.col("name").alias("group_name")), "reached")
    if reached.isEmpty():
        return None, edges
    frontier, paths, done = reached, [scratch.last], False
    for _ in range(rounds):
        # A topic has one start, so all that is reached in it has one label, and a row of each pair is enough.
        step = both_ways(edges).join(frontier, KEY).select("topic", F.col("other").alias("name"), "group_name").distinct()
        frontier = scratch.write(step.join(reached, KEY, "left_anti"), "frontier")
        paths.append(scratch.last)
        if frontier.isEmpty():
            done = True
            break
        reached = scratch.spark.read.schema(reached.schema).parquet(*paths)
    start = reached.select("topic", F.col("name").alias("a"))
    if done:  # an edge whose one end was reached has both ends reached
        return reached, scratch.write(edges.join(start, ["topic", "a"], "left_anti"), "rest")
    return reached, scratch.write(rewritten(edges, reached.select("topic", "name", F.col("group_name").alias("to"))), "rest")
