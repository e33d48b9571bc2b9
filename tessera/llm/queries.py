"""Queries of the operators for training data, by problem number, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import boilerplate, components, entity_names, leakage, packing, spam, splitting, survivors
from tessera.plans.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# Problem 5: splitting oversized items


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.cut_kinds(table(spark, d, "parsed_files"))


ORACLE["p5_found"] = """
SELECT file_id, CASE WHEN list_max(list_transform(string_split_regex(text, '[ \\t\\r\\n]+'), lambda x: length(x))) > 6000
       THEN 'forced' ELSE 'natural' END AS cut
FROM parsed_files WHERE length(text) > 6000
"""


@query
def p5_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_texts(table(spark, d, "parsed_files"))


@query
def p5_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """Each text put together again from its pieces without their overlaps, and whether all pieces and overlaps are within bounds."""
    pieces = splitting.split_texts(table(spark, d, "parsed_files"))
    own = F.struct("piece_no", F.expr("substring(piece, overlap + 1)").alias("own"))
    parts = F.transform(F.array_sort(F.collect_list(own)), lambda x: x.own)  # no longer than the text
    bounds = F.max(F.when((F.col("length") > 6000) | (F.length("piece") != F.col("length")) | (F.col("overlap") > 200), 1).otherwise(0)) == 0
    return pieces.groupBy("file_id").agg(F.sha1(F.array_join(parts, "").cast("binary")).alias("text_sha1"), bounds.alias("within"))


ORACLE["p5_rebuilt"] = "SELECT file_id, sha1(text) AS text_sha1, true AS within FROM parsed_files WHERE length(text) > 6000"


# Problem 6: consolidating pairwise matches


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return components.connected_groups(table(spark, d, "aliases"))


ORACLE["p6_found"] = """
WITH RECURSIVE p AS (SELECT topic, trim(alias) AS a, trim(canonical) AS b FROM aliases),
v AS (SELECT topic, a AS name FROM p WHERE a <> '' UNION SELECT topic, b FROM p WHERE b <> ''),
e AS (SELECT topic, a, b FROM p WHERE a <> '' AND b <> '' UNION SELECT topic, b, a FROM p WHERE a <> '' AND b <> ''),
reach AS (
  SELECT topic, name, name AS other FROM v
  UNION
  SELECT r.topic, r.name, e.b FROM reach r JOIN e ON r.topic = e.topic AND r.other = e.a)
SELECT topic, name, min(other) AS group_name FROM reach GROUP BY topic, name
"""


@query
def p6_sizes(spark: SparkSession, d: str) -> DataFrame:
    groups = components.connected_groups(table(spark, d, "aliases"))
    sizes = groups.groupBy("topic", "group_name").agg(F.count("*").alias("n_names"))
    return sizes.groupBy("n_names").agg(F.count("*").alias("n_groups"))


ORACLE["p6_sizes"] = (
    "WITH g AS (" + ORACLE["p6_found"] + "), s AS (SELECT topic, group_name, CAST(count(*) AS BIGINT) AS n_names FROM g GROUP BY topic, group_name)"
    " SELECT n_names, CAST(count(*) AS BIGINT) AS n_groups FROM s GROUP BY n_names"
)


# Problem 9: keyword-stuffed and link-list pages


@query
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam_pages(table(spark, d, "documents"))


@query
def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam_shares(table(spark, d, "documents"))


# Problem 8: evaluation texts in training text


@query
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


@query
def p8_report(spark: SparkSession, d: str) -> DataFrame:
    found = leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.groupBy("item_id", "part").agg(F.countDistinct("doc_id").alias("n_docs"), F.max(F.col("words") / F.col("of_words")).alias("most"))


# Problem 7: filling containers


@query
def p7_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"))


@query
def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_report(packing.pack_documents(table(spark, d, "documents")))


@query
def p7_kept(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose pieces follow on without a gap, and containers above the capacity."""
    packed = packing.pack_documents(table(spark, d, "documents"))
    whole = packed.groupBy("doc_id").agg((F.sum("n_tokens") == F.max(F.col("start_token") + F.col("n_tokens"))).alias("whole"))
    full = packed.groupBy("container").agg(F.sum("n_tokens").alias("n"))
    kept = whole.where("whole").agg(F.count("*").alias("n_docs")).withColumn("k", F.lit(1))
    over = full.where("n > 2048").agg(F.count("*").alias("n_overfull")).withColumn("k", F.lit(1))
    return kept.join(over, "k").drop("k")  # one row each


ORACLE["p7_kept"] = "SELECT CAST(count(DISTINCT doc_id) AS BIGINT) AS n_docs, CAST(0 AS BIGINT) AS n_overfull FROM documents"


# Problem 4: best representative of each duplicate group


def _survivors(spark: SparkSession, d: str) -> DataFrame:
    return survivors.surviving_records(*(table(spark, d, t) for t in ("extracted_entities", "extractors", "ontology_terms", "entity_index")))


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _survivors(spark, d)


@query
def p4_consensus(spark: SparkSession, d: str) -> DataFrame:
    return survivors.elected_descriptions(table(spark, d, "extracted_entities"), table(spark, d, "extractors"))


@query
def p4_types_and_sources(spark: SparkSession, d: str) -> DataFrame:
    return _survivors(spark, d).where("field <> 'description'")


ORACLE["p4_types_and_sources"] = r"""
WITH live AS (SELECT *, lower(regexp_replace(trim(name), ' +', ' ', 'g')) AS key FROM extracted_entities WHERE deleted_at IS NULL),
g AS (SELECT topic, key, min(ent_id) AS first_id FROM live GROUP BY topic, key HAVING count(*) > 1),
t AS (SELECT l.topic, l.key, upper(trim(l.type)) AS value,
             row_number() OVER (PARTITION BY l.topic, l.key ORDER BY x.trust DESC, l.extracted_at DESC, l.ent_id) AS k
      FROM live l JOIN extractors x ON l.extractor = x.extractor
      WHERE upper(trim(l.type)) IN (SELECT upper(trim(term)) FROM ontology_terms WHERE kind = 'entity_type')),
f AS (SELECT topic, key, filename AS file FROM live
      UNION ALL SELECT topic, lower(regexp_replace(trim(name), ' +', ' ', 'g')), unnest(sources) FROM entity_index),
s AS (SELECT DISTINCT topic, key, trim(regexp_replace(file, '^.*[/\\]', '')) AS value FROM f)
SELECT first_id, 'type' AS field, value FROM g JOIN t USING (topic, key) WHERE k = 1
UNION ALL
SELECT first_id, 'sources', value FROM g JOIN s USING (topic, key) WHERE value <> ''
"""


# Problem 1: page boilerplate


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.boilerplate_lines(table(spark, d, "parsed_files"))


@query
def p1_learned(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.learned_lines(table(spark, d, "parsed_files"))


@query
def p1_main_bodies(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.main_bodies(table(spark, d, "parsed_files"))


# Problem 2: variant spellings of names


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return entity_names.linked_names(table(spark, d, "extracted_entities"), table(spark, d, "aliases"))


@query
def p2_clusters(spark: SparkSession, d: str) -> DataFrame:
    return entity_names.clustered_names(table(spark, d, "extracted_entities"), table(spark, d, "aliases"))
