"""Merging duplicate nodes: candidate groups, canonical names, alias rules, closure of merge records, and their application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.closure import closure
from tessera.operators.ranking import placed
from tessera.operators.upsert import collapse_edges, folded_text
from tessera.session import Scratch

NODE = ["topic", "id"]


def merge_groups(nodes: DataFrame, key: str = "name") -> DataFrame:
    """``topic, key, id`` of nodes that share a non-empty key with another: ``name`` or ``signature``.

    Nodes whose key is empty are in no group.
    """
    k = T.normal_name(F.col("id")) if key == "name" else T.token_signature(F.col("id"))
    keyed = nodes.select(*NODE, k.alias("key")).where("key <> ''")
    large = keyed.groupBy("topic", "key").agg(F.countDistinct("id").alias("n")).where("n > 1")
    return keyed.join(large.drop("n"), ["topic", "key"]).select("topic", "key", "id")


def canonical_nodes(groups: DataFrame, degree: DataFrame) -> DataFrame:
    """``topic, key, canonical``: of each group the node of highest degree, then longest name, then greatest name."""
    d = groups.join(degree, NODE, "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))
    return d.groupBy("topic", "key").agg(F.max_by("id", F.struct("degree", F.length("id").alias("n"), "id")).alias("canonical"))


def acronym_pairs(nodes: DataFrame) -> DataFrame:
    """``topic, acronym, expansion``: acronyms with the longest name that has these initials (the first node on ties)."""
    named = nodes.select("topic", "id", "ord", T.initials(F.col("id")).alias("initials"))
    long = named.where("initials is not null").groupBy("topic", "initials").agg(F.max_by("id", F.struct(F.length("id").alias("n"), (-F.col("ord")).alias("o"))).alias("expansion"))
    short = nodes.where(T.is_acronym(F.col("id"))).select("topic", F.col("id").alias("acronym"), F.lower("id").alias("initials"))
    return short.join(long, ["topic", "initials"]).where("acronym <> expansion").select("topic", "acronym", "expansion")


def alias_map(aliases: DataFrame) -> DataFrame:
    """``topic, alias, canonical``: one target per alias; ontology pairs go before learned ones, then the latest, then the smallest."""
    rank = F.struct(F.when(F.col("origin") == "ontology", 0).otherwise(1).alias("o"), (-F.coalesce(F.unix_micros(F.col("learned_at").cast("timestamp")), F.lit(0))).alias("t"), F.col("canonical").alias("c"))
    clean = aliases.where("trim(alias) <> '' and trim(canonical) <> ''").withColumns({"alias": F.trim("alias"), "canonical": F.trim("canonical")})
    return clean.groupBy("topic", "alias").agg(F.min_by("canonical", rank).alias("canonical"))


def applicable_aliases(mapping: DataFrame, nodes: DataFrame) -> DataFrame:
    """Alias pairs of two different names that both are nodes."""
    ids = nodes.select(*NODE).distinct()
    return (
        mapping.where("alias <> canonical")
        .join(ids.withColumnRenamed("id", "alias"), ["topic", "alias"], "left_semi")
        .join(ids.withColumnRenamed("id", "canonical"), ["topic", "canonical"], "left_semi")
    )


def merge_map(nodes: DataFrame, edges_degree: DataFrame, aliases: DataFrame) -> DataFrame:
    """``topic, id, winner`` of every node that is merged into another.

    Groups of equal names, equal signatures, acronyms with their expansions and applicable aliases are
    closed transitively.  The winner is an alias target that is no alias itself, if there is one, otherwise the
    canonical node of the component.
    """
    groups = [merge_groups(nodes, k) for k in ("name", "signature")]
    pairs = [g.join(g.groupBy("topic", "key").agg(F.min("id").alias("b")), ["topic", "key"]).select("topic", F.col("id").alias("a"), "b") for g in groups]
    pairs.append(acronym_pairs(nodes).select("topic", F.col("acronym").alias("a"), F.col("expansion").alias("b")))
    usable = applicable_aliases(alias_map(aliases), nodes)
    pairs.append(usable.select("topic", F.col("alias").alias("a"), F.col("canonical").alias("b")))
    linked = pairs[0]
    for p in pairs[1:]:
        linked = linked.unionByName(p)
    roots = closure(Scratch(nodes.sparkSession, "linked").write(linked.distinct()))
    member = roots.join(edges_degree, NODE, "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))
    final = usable.select("topic", F.col("canonical").alias("id")).distinct().join(usable.select("topic", F.col("alias").alias("id")), NODE, "left_anti").withColumn("final", F.lit(1))
    member = member.join(final, NODE, "left").withColumn("final", F.coalesce("final", F.lit(0)))
    rank = F.struct("final", "degree", F.length("id").alias("n"), "id")
    winners = member.groupBy("topic", "root").agg(F.max_by("id", rank).alias("winner"))
    return member.join(winners, ["topic", "root"]).where("id <> winner").select("topic", "id", "winner")


def decided_aliases(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """``topic, alias, canonical`` of groups of names that a resolver gave in one pass: ``topic, batch, place, g``.

    The first name is the canonical one; if it is no node, the longest name of the group that is (the first on ties).
    Names that are no nodes are left out.  Of several targets of a name that of the last group holds.
    """
    members = groups.where("size(g) > 1").select("topic", "batch", "place", F.posexplode("g").alias("k", "id")).join(nodes.select(*NODE).distinct(), NODE, "left_semi")
    key = ["topic", "batch", "place"]
    rank = F.struct((F.col("k") == 0).alias("first"), F.length("id").alias("n"), (-F.col("k")).alias("k"))
    canonical = members.groupBy(*key).agg(F.max_by("id", rank).alias("canonical"))
    pairs = members.join(canonical, key).where("id <> canonical")
    return pairs.groupBy("topic", F.col("id").alias("alias")).agg(F.max_by("canonical", F.struct("batch", "place")).alias("canonical"))


def apply_merge(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges with merged ends replaced; self-loops, old ones included, are gone."""
    a = mapping.select("topic", F.col("id").alias("src"), F.col("winner").alias("w_src"))
    b = mapping.select("topic", F.col("id").alias("dst"), F.col("winner").alias("w_dst"))
    new = edges.join(a, ["topic", "src"], "left").join(b, ["topic", "dst"], "left")
    new = new.withColumns({"src": F.coalesce("w_src", "src"), "dst": F.coalesce("w_dst", "dst")}).drop("w_src", "w_dst")
    return new.where("src <> dst").select(edges.columns)


def merge_nodes(nodes: DataFrame, mapping: DataFrame) -> DataFrame:
    """Nodes after the merge: the winner first, then the merged ones in order, folded; ``grown`` tells if the description did."""
    m = nodes.join(mapping, NODE, "left").withColumns({"winner": F.coalesce("winner", "id"), "is_winner": F.col("winner").isNull()})
    one = F.struct((~F.col("is_winner")).alias("later"), "ord", F.coalesce("description", F.lit("")).alias("d"), F.coalesce("sources", F.array().cast("array<string>")).alias("s"))
    g = m.groupBy("topic", "winner").agg(F.array_sort(F.collect_list(one)).alias("parts"), F.max_by(F.struct("name", "type", "ord"), "is_winner").alias("w"))
    description = folded_text(F.transform("parts", lambda x: x.d))
    return g.select(
        "topic", F.col("winner").alias("id"), "w.name", "w.type", description.alias("description"),
        F.array_distinct(F.flatten(F.transform("parts", lambda x: x.s))).alias("sources"), "w.ord", (description != F.element_at("parts", 1).d).alias("grown"),
    )


def deduplicate(nodes: DataFrame, edges: DataFrame, degree: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and the merge map after merging all duplicates.

    Nodes and degrees are read many times, so they are written first.
    """
    scratch = Scratch(nodes.sparkSession, "merge")
    nodes, degree = scratch.write(nodes, "nodes"), scratch.write(degree, "degree")
    mapping = scratch.write(merge_map(nodes, degree, aliases), "map")
    return merge_nodes(nodes, mapping), collapse_edges(apply_merge(edges, mapping)), mapping


def _order_key(by: str) -> Column:
    return T.token_signature(F.col("id")) if by == "signature" else F.coalesce("type", F.lit(""))


def resolver_order(nodes: DataFrame, by: str = "signature") -> DataFrame:
    """``topic, id, place``: nodes in the order in which a resolver sees them, by signature and name or by type and name."""
    return placed(nodes.select("topic", "id", _order_key(by).alias("k")), ["topic"], [F.col("k"), F.col("id")]).select("topic", "id", "place")


def resolver_line() -> Column:
    """A node as a resolver sees it: name, type, and the first 120 characters of the description."""
    return F.concat(F.lit('- "'), F.col("id"), F.lit('" ('), F.coalesce("type", F.lit("")), F.lit("): "), F.substring(F.coalesce("description", F.lit("")), 1, 120))


def resolver_batches(nodes: DataFrame, most: int = 25, chars: int = 6000, by: str = "signature") -> DataFrame:
    """``topic, id, batch``: greedy batches of the resolver's order, new when ``most`` lines or ``chars`` characters, line ends
    included, would be passed; no batch is empty, so a line that is too long stands alone.

    The rule is sequential within a topic.  Rows stream through sorted partitions, so no topic is ever held in memory.
    """
    import pandas as pd

    rows = nodes.select("topic", _order_key(by).alias("k"), "id", (F.length(resolver_line()) + 1).cast("long").alias("n"))

    def number(batches):
        topic, batch, lines, used = None, 0, 0, 0
        for pdf in batches:
            out = []
            for t, n in zip(pdf["topic"], pdf["n"]):
                if t != topic:
                    topic, batch, lines, used = t, 1, 0, 0
                elif lines >= most or lines and used + n > chars:
                    batch, lines, used = batch + 1, 0, 0
                lines, used = lines + 1, used + n
                out.append(batch)
            yield pd.DataFrame({"topic": pdf["topic"], "id": pdf["id"], "batch": out})

    return rows.repartition("topic").sortWithinPartitions("topic", "k", "id").mapInPandas(number, "topic string, id string, batch long")
