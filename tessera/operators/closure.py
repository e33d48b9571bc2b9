"""Connected components by minimum propagation with contraction.

Each round every name points to the least name among itself and its neighbours (a partial aggregation, no join), in
an order that is hashed anew for the round, so that long chains in alphabetical order are nothing special.  Pointers
are followed once more and the edges rewritten to what their ends point to.  Names that still have edges shrink by a
constant factor a round, so a chain of n names takes about log n rounds, and the edges shrink as quickly.  At the end
each component takes its smallest name.  Rounds are written to the shared folder; only counts reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import Scratch

#: A group with more than this part of all rows is hot.
HOT_SHARE = 256


def oriented(pairs: DataFrame) -> DataFrame:
    """Distinct edges ``topic, a, b`` with ``a < b``; pairs of a name with itself are left out."""
    return pairs.where("a <> b").select("topic", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge from both ends: ``topic, name, other``."""
    ends = F.array(F.struct(F.col("a").alias("name"), F.col("b").alias("other")), F.struct(F.col("b").alias("name"), F.col("a").alias("other")))
    return edges.select("topic", F.explode(ends).alias("e")).select("topic", "e.name", "e.other")


def rewritten(edges: DataFrame, to: DataFrame) -> DataFrame:
    """Edges with their ends replaced by what ``to`` (``topic, name, to``) points to; loops and repeats are gone."""
    a = to.select("topic", F.col("name").alias("a"), F.col("to").alias("new_a"))
    b = to.select("topic", F.col("name").alias("b"), F.col("to").alias("new_b"))
    new = edges.join(a, ["topic", "a"], "left").join(b, ["topic", "b"], "left")
    return oriented(new.select("topic", F.coalesce("new_a", "a").alias("a"), F.coalesce("new_b", "b").alias("b")))


def _shortened(to: DataFrame) -> DataFrame:
    """Pointers to where the pointed-to names point."""
    onward = to.select("topic", F.col("name").alias("to"), F.col("to").alias("further"))
    return to.join(onward, ["topic", "to"], "left").select("topic", "name", F.coalesce("further", "to").alias("to"))


def minimum_pointers(scratch: Scratch, edges: DataFrame) -> list[DataFrame]:
    """Pointer tables ``topic, name, to``, one a round; following them in order leads to one name of each component."""
    steps, edges_path = [], None
    while not edges.isEmpty():
        at = lambda c, k=len(steps): F.struct(F.xxhash64(c, F.lit(k)).alias("h"), F.col(c).alias("n"))
        least = both_ways(edges).groupBy("topic", "name").agg(F.min(at("other")).alias("near"))
        to = scratch.write(_shortened(least.select("topic", "name", F.least("near", at("name")).n.alias("to")).where("to <> name")), "to")
        steps.append(to)
        old = edges_path
        edges = scratch.write(rewritten(edges, to), "edges")
        edges_path = scratch.last
        if old:
            scratch.drop(old)
    return steps


def smallest_of_groups(scratch: Scratch, rows: DataFrame, name: str, group: str) -> DataFrame:
    """``rows`` with the smallest ``name`` of each ``group`` of a topic in place of it.

    Groups that hold 1 / ``HOT_SHARE`` of all rows or more, of which there are at most ``HOT_SHARE``, are broadcast, so no
    task gets all rows of a giant group.
    """
    rows = scratch.write(rows, "grouped")
    least = scratch.write(rows.groupBy("topic", group).agg(F.min(name).alias("_least"), F.count("*").alias("_n")), "least")
    hot = F.broadcast(least.where(F.col("_n") * HOT_SHARE >= rows.count()).drop("_n"))
    others = [c for c in rows.columns if c != group]
    giant = rows.join(hot, ["topic", group])
    rest = rows.join(hot, ["topic", group], "left_anti").join(least.drop("_n"), ["topic", group])
    return giant.unionByName(rest).select(*others, F.col("_least").alias(group))


def followed(rows: DataFrame, column: str, steps: list[DataFrame]) -> DataFrame:
    """``rows`` with ``column`` replaced by what the pointers lead to."""
    others = [c for c in rows.columns if c not in ("topic", column)]
    for step in steps:
        onward = step.select("topic", F.col("name").alias(column), F.col("to").alias("_next"))
        rows = rows.join(onward, ["topic", column], "left").select("topic", *others, F.coalesce("_next", column).alias(column))
    return rows


def closure(pairs: DataFrame) -> DataFrame:
    """``topic, id, root``: every name of the pairs ``topic, a, b`` with the smallest name it is linked to."""
    scratch = Scratch(pairs.sparkSession, "closure")
    edges = scratch.write(oriented(pairs), "edges")
    names = pairs.select("topic", F.explode(F.array("a", "b")).alias("id")).where("id is not null").distinct()
    found = followed(names.withColumn("root", F.col("id")), "root", minimum_pointers(scratch, edges))
    return smallest_of_groups(scratch, found, "id", "root").select("topic", "id", "root")
