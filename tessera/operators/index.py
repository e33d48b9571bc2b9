"""The entity index and what is rendered from it: groupings, digests, contexts, searches and note texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.ranking import placed

DASH = " — "
#: Letters by which parts of names are looked up.
GRAM = 3


def _by_degree():
    return [F.desc("degree"), F.col("ord"), F.col("id")]


def known_type(kind: str = "type") -> Column:
    """The type of a node, OTHER where it has none."""
    return F.coalesce(F.nullif(F.col(kind), F.lit("")), F.lit("OTHER"))


def entity_index(nodes: DataFrame) -> DataFrame:
    """Nodes with degree and community as the index holds them: with a type, and the first line of the description."""
    return nodes.withColumns({"type": known_type(), "description": F.coalesce(T.one_line(F.col("description")), F.lit(""))})


def type_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("topic", known_type().alias("type")).agg(F.count("*").alias("n_entities"))


def grouped(index: DataFrame, by: str) -> DataFrame:
    """``topic, <by>, place, id, degree``: entities of a type or community in order of degree, then of their node."""
    rows = index.where(F.col(by).isNotNull()).select("topic", by, "id", "degree", "ord")
    return placed(rows, ["topic", by], _by_degree()).select("topic", by, "place", "id", "degree")


def digest(index: DataFrame, most: int = 120) -> DataFrame:
    """``topic, type, line``: one line per type with its best-connected entities, at most max(5, most / types) of them."""
    types = index.groupBy("topic").agg(F.countDistinct("type").alias("n_types"))
    cap = F.greatest(F.lit(5), F.floor(F.lit(most) / F.greatest(F.lit(1), F.col("n_types"))))
    counts = index.where("type is not null").groupBy("topic", "type").agg(F.count("*").alias("n")).join(types, "topic").withColumn("cap", cap)
    # No type shows more than ``most`` or 5 names, so a rank limit before the shuffle is enough.
    place = F.row_number().over(W.partitionBy("topic", "type").orderBy(*_by_degree()))
    first = index.where("type is not null").select("topic", "type", "id", "degree", "ord").withColumn("place", place).where(F.col("place") <= max(5, most))
    shown = first.join(counts, ["topic", "type"]).where("place <= cap")
    totals = shown.groupBy("topic", "type", "cap", "n").agg(F.array_sort(F.collect_list(F.struct("place", "id"))).alias("l"))
    names = F.array_join(F.transform("l", lambda x: x.id), ", ")
    more = F.when(F.col("n") > F.col("cap"), F.concat(F.lit(", … (+"), (F.col("n") - F.col("cap")).cast("string"), F.lit(" more)"))).otherwise("")
    return totals.select("topic", "type", F.concat(F.lit("- **"), F.col("type"), F.lit("**: "), names, more).alias("line"))


def index_lines(index: DataFrame) -> DataFrame:
    """``topic, section, place, line``: the lines of the index page, entities of a type by degree."""
    tail = F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(DASH), F.col("description"))).otherwise("")
    rows = placed(index.where("type is not null").select("topic", "type", "id", "name", "description", "degree", "ord"), ["topic", "type"], _by_degree())
    return rows.select("topic", F.col("type").alias("section"), "place", F.concat(F.lit("- **"), F.col("name"), F.lit("**"), tail).alias("line"))


def source_entities(index: DataFrame, shown: int = 8) -> DataFrame:
    """``topic, source, n_entities, line``: the first entities of each file, and how many more there are."""
    each = index.select("topic", F.explode(F.array_distinct("sources")).alias("source"), "id", "ord").where("trim(source) <> ''")
    place = F.row_number().over(W.partitionBy("topic", "source").orderBy("ord", "id"))
    first = each.withColumn("place", place).where(F.col("place") <= shown)  # limited before the shuffle
    lists = first.groupBy("topic", "source").agg(F.array_sort(F.collect_list(F.struct("place", "id"))).alias("l"))
    counts = each.groupBy("topic", "source").agg(F.count("*").alias("n_entities"))
    more = F.when(F.col("n_entities") > shown, F.concat(F.lit(" (+"), (F.col("n_entities") - shown).cast("string"), F.lit(" more)"))).otherwise("")
    return lists.join(counts, ["topic", "source"]).select("topic", "source", "n_entities", F.concat(F.array_join(F.transform("l", lambda x: x.id), ", "), more).alias("line"))


def node_search(index: DataFrame, query: str, k: int = 10) -> DataFrame:
    """The ``k`` best nodes for a query: exact name, prefix, part of the name, type, part of the description."""
    q = query.strip().lower()
    name, kind, text = F.lower("name"), F.lower(F.coalesce("type", F.lit(""))), F.lower(F.coalesce("description", F.lit("")))
    score = (
        F.when(name == q, 100).when(name.startswith(q), 80).when(F.contains(name, F.lit(q)), 60).when(F.contains(kind, F.lit(q)), 40).when(F.contains(text, F.lit(q)), 20)
    ).cast("long")
    return index.withColumn("score", score).where("score is not null").orderBy(F.desc("score"), F.desc("degree"), "name", "topic").limit(k).select("topic", "id", "score", "degree")


def lookup_label(labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """``topic, label, id``: the node a cited label means: the same name ignoring case, otherwise the first that contains it."""
    l = labels.select("topic", "label", F.lower(F.trim("label")).alias("low")).distinct()
    n = nodes.select("topic", "id", "ord", F.lower("id").alias("name"))
    exact = l.join(n.withColumnRenamed("name", "low"), ["topic", "low"]).select("topic", "label", "id", F.lit(0).alias("kind"), "ord")
    rest = l.join(exact.select("topic", "label").distinct(), ["topic", "label"], "left_anti").where("low <> ''")
    # A name that contains a label contains its first three letters: an equi-join instead of all pairs of a topic.
    starts = lambda size: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("name") - size + 1), lambda i: F.substr(F.col("name"), i, F.lit(size))))
    parts = n.where(F.length("name") >= GRAM).select("topic", "id", "ord", "name", F.explode(starts(GRAM)).alias("gram"))
    long = rest.where(F.length("low") >= GRAM).withColumn("gram", F.left("low", F.lit(GRAM)))
    part = long.join(parts, ["topic", "gram"]).where(F.contains("name", "low")).select("topic", "label", "id", F.lit(1).alias("kind"), "ord")
    # Shorter labels are whole grams, of which each topic keeps only its first name: no list of all names of a letter is joined.
    order = F.struct("ord", "id")
    short = rest.where(F.length("low") < GRAM).withColumn("gram", F.col("low"))
    for size in range(1, GRAM):
        first = n.where(F.length("name") >= size).select("topic", "id", "ord", F.explode(starts(size)).alias("gram")).groupBy("topic", "gram").agg(F.min(order).alias("f"))
        part = part.unionByName(short.where(F.length("low") == size).join(first, ["topic", "gram"]).select("topic", "label", "f.id", F.lit(1).alias("kind"), "f.ord"))
    return exact.unionByName(part).groupBy("topic", "label").agg(F.min_by("id", F.struct("kind", "ord", "id")).alias("id"))


def wiki_context(neighbours: DataFrame, most: int = 25) -> DataFrame:
    """``topic, id, direction, place, line``: at most ``most`` lines of each direction with their descriptions, in order of the relations."""
    w = W.partitionBy("topic", "id", "direction").orderBy("ord", "label", "other")
    arrow = F.when(F.col("direction") == "out", F.concat(F.lit("- ["), F.col("label"), F.lit("] → "), F.col("other"))).otherwise(F.concat(F.lit("- "), F.col("other"), F.lit(" → ["), F.col("label"), F.lit("]")))
    line = F.concat(arrow, F.lit(": "), F.coalesce("description", F.lit("")))
    return neighbours.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= most).select("topic", "id", "direction", "place", line.alias("line"))


def blog_context(index: DataFrame, edges: DataFrame, entities: int = 30, relations: int = 40, shown: int = 8) -> DataFrame:
    """``topic, part, place, line``: the best-connected entities of each topic, the first relations between nodes, and the numbered files of these entities."""
    w = W.partitionBy("topic").orderBy(F.desc("degree"), "ord", "id")
    best = index.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= entities)
    head = F.concat(F.lit("- "), F.col("name"), F.lit(" ("), F.col("type"), F.lit(", "), F.col("degree").cast("string"), F.lit(" connections): "))
    e = best.select("topic", F.lit("entity").alias("part"), "place", F.concat(head, F.substring("description", 1, 220)).alias("line"))
    v = W.partitionBy("topic").orderBy("ord", "src", "label", "dst")
    r = edges.withColumn("place", F.row_number().over(v).cast("long")).where(F.col("place") <= relations)
    arrow = F.concat(F.lit("- "), F.col("src"), F.lit(" → ["), F.col("label"), F.lit("] → "), F.col("dst"), F.lit(": "))
    r = r.select("topic", F.lit("relation").alias("part"), "place", F.concat(arrow, F.substring(F.coalesce("description", F.lit("")), 1, 150)).alias("line"))
    # At most ``entities`` names a topic: the lists stay short, and so do the files of a topic.
    names = best.select("topic", F.explode("sources").alias("file"), "place", "name").groupBy("topic", "file").agg(F.array_sort(F.collect_list(F.struct("place", "name"))).alias("l"))
    more = F.when(F.size("l") > shown, F.concat(F.lit(" (+"), (F.size("l") - shown).cast("string"), F.lit(" more)"))).otherwise("")
    number = F.row_number().over(W.partitionBy("topic").orderBy("file")).cast("long")
    text = F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] "), F.col("file"), F.lit(" — contributes to: "), F.array_join(F.transform(F.slice("l", 1, shown), lambda x: x["name"]), ", "), more)
    s = names.withColumn("place", number).select("topic", F.lit("source").alias("part"), "place", text.alias("line"))
    return e.unionByName(r).unionByName(s)


def blog_communities(summaries: DataFrame, most: int = 20) -> DataFrame:
    """``topic, place, line``: the first ``most`` communities of each topic by number, others after those below 1000 by name."""
    number = F.when(F.col("community").rlike("^[0-9]+$"), F.col("community").cast("decimal(38,0)")).otherwise(999)
    w = W.partitionBy("topic").orderBy("n", "community")
    first = summaries.withColumn("n", number).withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= most)
    return first.select("topic", "place", F.concat(F.lit("Community "), F.col("place").cast("string"), F.lit(": "), F.substring("summary", 1, 500)).alias("line"))


def file_stems(nodes: DataFrame) -> DataFrame:
    """``topic, id, stem``: file names of notes; the n-th node of a name gets `` (n)``."""
    base = nodes.select("topic", "id", "ord", T.safe_filename(F.col("name")).alias("base"))
    return placed(base, ["topic", "base"], [F.col("ord"), F.col("id")], "n").select("topic", "id", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat("base", F.lit(" ("), F.col("n").cast("string"), F.lit(")"))).alias("stem"))
