"""Queries of the knowledge-graph operators over the test tables, each with the SQL it must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import community, dedup, graph, incremental, index, search, upsert
from tessera.operators.closure import closure
from tessera.plans.tables import table
from tessera.session import Scratch
from tessera.sources import files

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL where SQL can express it on whole tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# Views of the tables as a property graph.


def entity_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "extracted_entities").where("deleted_at is null and trim(name) <> ''")
    return rows.select("topic", F.col("name").alias("id"), "name", F.coalesce("type", F.lit("")).alias("type"), F.coalesce("description", F.lit("")).alias("description"), F.coalesce("filename", F.lit("")).alias("source"), F.col("ent_id").alias("ord"))


def nodes_of(spark: SparkSession, d: str) -> DataFrame:
    g = entity_rows(spark, d).groupBy("topic", "id").agg(F.min_by(F.struct("name", "type", "description"), "ord").alias("f"), F.min("ord").alias("ord"))
    return g.select("topic", "id", "f.name", "f.type", "f.description", "ord")


def edges_of(spark: SparkSession, d: str) -> DataFrame:
    rel = table(spark, d, "extracted_relationships").where("trim(source) <> '' and trim(target) <> ''")
    return rel.select("topic", F.col("source").alias("src"), F.coalesce("relation", F.lit("")).alias("label"), F.col("target").alias("dst"), F.coalesce("description", F.lit("")).alias("description"), F.col("rel_id").alias("ord"))


def communities_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entity_index").where("community is not null").groupBy("topic", "id").agg(F.min("community").alias("community"))


def index_of(spark: SparkSession, d: str) -> DataFrame:
    """Nodes with degree, community and the sources of their rows."""
    n = graph.with_degree(nodes_of(spark, d), edges_of(spark, d)).join(communities_of(spark, d), ["topic", "id"], "left")
    return index.entity_index(n.join(upsert.upsert_nodes(entity_rows(spark, d)).select("topic", "id", "sources"), ["topic", "id"]))


_ROWS = """rows_ AS (SELECT topic, name AS id, coalesce(type, '') AS type, coalesce(description, '') AS description, coalesce(filename, '') AS source, ent_id AS ord
  FROM extracted_entities WHERE deleted_at IS NULL AND trim(name) <> '')"""
_NODES = _ROWS + """, nodes AS (SELECT topic, id, arg_min(type, ord) AS type, arg_min(description, ord) AS description, min(ord) AS ord FROM rows_ GROUP BY topic, id)"""
_EDGES = """edges AS (SELECT topic, source AS src, coalesce(relation, '') AS label, target AS dst, coalesce(description, '') AS description, rel_id AS ord
  FROM extracted_relationships WHERE trim(source) <> '' AND trim(target) <> '')"""
_DEGREE = """ends AS (SELECT topic, src AS id FROM edges UNION ALL SELECT topic, dst FROM edges),
degree AS (SELECT topic, id, CAST(count(*) AS BIGINT) AS degree FROM ends GROUP BY topic, id)"""
_COMM = "comm AS (SELECT topic, id, min(community) AS community FROM entity_index WHERE community IS NOT NULL GROUP BY topic, id)"
_TRIM_D = "regexp_replace(n.description, '^\\s+|\\s+$', '', 'g')"
_ONE_LINE = f"trim(left(CASE WHEN regexp_matches({_TRIM_D}, '(?s)^(.*?[.!?])\\s') THEN regexp_extract({_TRIM_D}, '(?s)^(.*?[.!?])\\s', 1) ELSE {_TRIM_D} END, 180))"
_INDEX = f"""{_NODES}, {_EDGES}, {_DEGREE}, {_COMM},
idx AS (SELECT n.topic, n.id, coalesce(nullif(n.type, ''), 'OTHER') AS type, {_ONE_LINE} AS description, n.ord, coalesce(d.degree, 0) AS degree, c.community
  FROM nodes n LEFT JOIN degree d ON n.topic = d.topic AND n.id = d.id LEFT JOIN comm c ON n.topic = c.topic AND n.id = c.id)"""

# The graph as it is drawn: one link per pair of different nodes, and the links of each node, 1 where it has none.
_DRAWN = f"""{_NODES}, {_EDGES}, sound AS (SELECT e.* FROM edges e SEMI JOIN nodes a ON e.topic = a.topic AND e.src = a.id SEMI JOIN nodes b ON e.topic = b.topic AND e.dst = b.id WHERE src <> dst),
links AS (SELECT topic, least(src, dst) AS a, greatest(src, dst) AS b, arg_max(label, ord) AS label FROM sound GROUP BY 1, 2, 3),
drawn AS (SELECT n.topic, n.id, greatest(1, count(l.topic)) AS degree FROM nodes n LEFT JOIN (SELECT topic, a AS id FROM links UNION ALL SELECT topic, b FROM links) l ON n.topic = l.topic AND n.id = l.id GROUP BY n.topic, n.id)"""

# Scalar functions


@query(r"SELECT name AS mention, CAST(count(DISTINCT doc_id) AS BIGINT) AS n_docs FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{3,}')) AS name FROM documents) GROUP BY name")
def mention_extract(spark: SparkSession, d: str) -> DataFrame:
    each = table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{3,}"), F.lit(0)))).alias("mention"))
    return each.groupBy("mention").agg(F.countDistinct("doc_id").alias("n_docs"))


_AMERICAN = "replace(replace(replace(replace(replace(regexp_replace(name, '\\s*\\(.*?\\)', '', 'g'), 'odelling', 'odeling'), 'rganisation', 'rganization'), 'ptimisation', 'ptimization'), 'nalyse', 'nalyze'), 'ehaviour', 'ehavior')"


@query(f"SELECT DISTINCT name, lower(trim(regexp_replace({_AMERICAN}, '\\s+', ' ', 'g'))) AS name_key FROM extracted_entities WHERE name IS NOT NULL")
def name_normalize(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "extracted_entities").where("name is not null").select("name").distinct().select("name", T.normal_name(F.col("name")).alias("name_key"))


_STEM = """CASE WHEN length(t) > 5 AND t LIKE '%ing' THEN left(t, length(t) - 3) WHEN length(t) > 4 AND t LIKE '%ies' THEN left(t, length(t) - 3) || 'y'
  WHEN length(t) > 3 AND t LIKE '%s' AND NOT regexp_matches(t, '(ss|us|is|os|as)$') THEN left(t, length(t) - 1) ELSE t END"""
_SIGNATURE = f"array_to_string(list_transform(regexp_extract_all(lower({_AMERICAN}), '[a-z0-9]+'), lambda t: {_STEM}), ' ')"


@query(f"SELECT DISTINCT name, {_SIGNATURE} AS signature FROM extracted_entities WHERE name IS NOT NULL")
def token_signature(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "extracted_entities").where("name is not null").select("name").distinct().select("name", T.token_signature(F.col("name")).alias("signature"))


_TOKENS = "regexp_extract_all(id, '[A-Za-z][A-Za-z0-9]*')"
_ACRONYM = "NOT contains(id, ' ') AND length(id) BETWEEN 2 AND 8 AND length(regexp_replace(id, '[^\\p{Lu}]', '', 'g')) >= 2"


@query(
    f"""WITH {_NODES}, long_ AS (SELECT topic, lower(array_to_string(list_transform({_TOKENS}, lambda t: left(t, 1)), '')) AS initials, id, ord FROM nodes WHERE len({_TOKENS}) BETWEEN 2 AND 8),
best AS (SELECT topic, initials, arg_max(id, row(length(id), -ord)) AS expansion FROM long_ GROUP BY topic, initials)
SELECT n.topic, n.id AS acronym, b.expansion FROM nodes n JOIN best b ON n.topic = b.topic AND lower(n.id) = b.initials WHERE {_ACRONYM} AND n.id <> b.expansion"""
)
def acronym_pairs(spark: SparkSession, d: str) -> DataFrame:
    return dedup.acronym_pairs(nodes_of(spark, d))


_TRIMMED = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"
_FIRST = f"regexp_replace(left(CASE WHEN regexp_matches({_TRIMMED}, '(?s)^(.*?[.!?])\\s') THEN regexp_extract({_TRIMMED}, '(?s)^(.*?[.!?])\\s', 1) ELSE {_TRIMMED} END, 180), '^\\s+|\\s+$', '', 'g')"


@query(f"SELECT doc_id, {_FIRST} AS sentence FROM documents WHERE text IS NOT NULL")
def first_sentence(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.one_line(F.col("text")).alias("sentence"))


_STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"
_WANTED = f"wanted AS (SELECT DISTINCT item_id AS qid, w AS keyword FROM (SELECT item_id, unnest(regexp_extract_all(lower(question), '[a-z]{{3,}}')) AS w FROM eval_items) WHERE NOT list_contains({_STOP}, w))"


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").select(F.col("item_id").alias("qid"), "question")


@query(f"WITH {_WANTED} SELECT qid, keyword FROM wanted")
def keyword_extract(spark: SparkSession, d: str) -> DataFrame:
    return search.question_keywords(_questions(spark, d))


@query("SELECT doc_id, sha1(regexp_replace(string_split(replace(text, '. ', '</think>'), '</think>')[-1], '^\\s+|\\s+$', '', 'g')) AS rest_sha1 FROM documents WHERE text IS NOT NULL")
def reasoning_strip(spark: SparkSession, d: str) -> DataFrame:
    t = F.replace("text", F.lit(". "), F.lit("</think>"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.sha1(T.after_reasoning(t).cast("binary")).alias("rest_sha1"))


def _cited(d: DataFrame) -> DataFrame:
    return d.where("text is not null").select("doc_id", F.replace("text", F.lit(" the "), F.lit(" [[the]] ")).alias("text"))


@query("SELECT doc_id, CAST(len(regexp_extract_all(replace(text, ' the ', ' [[the]] '), '\\[\\[([^\\[\\]\\n]{1,80})\\]\\]')) AS BIGINT) AS n_citations FROM documents WHERE text IS NOT NULL")
def citation_extract(spark: SparkSession, d: str) -> DataFrame:
    return _cited(table(spark, d, "documents")).select("doc_id", F.size(T.citations(F.col("text"))).cast("long").alias("n_citations"))


@query(
    r"""WITH t AS (SELECT doc_id, replace(text, ' the ', ' [[the]] ') AS text FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, generate_subscripts(ls, 1) AS k, unnest(ls) AS line FROM (SELECT doc_id, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS ls FROM t)),
s AS (SELECT doc_id, k, line, regexp_replace(line, '^\s+|\s+$', '', 'g') AS s FROM l),
c AS (SELECT doc_id, k, CASE WHEN s = '' OR regexp_matches(s, '^(#|-|\*|>|\||```)') OR s LIKE '%:' OR length(s) < 50 OR contains(lower(s), 'not in the graph') THEN line
  ELSE regexp_extract(line, '^(\s*)', 1) || nullif(array_to_string(list_filter(string_split(regexp_replace(s, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_matches(x, '\[\[[^\[\]\n]{1,80}\]\]')), ' '), '') END AS kept FROM s),
o AS (SELECT doc_id, regexp_replace(coalesce(string_agg(kept, chr(10) ORDER BY k) FILTER (WHERE kept IS NOT NULL), ''), '^\s+|\s+$', '', 'g') AS o FROM c GROUP BY doc_id)
SELECT o.doc_id, sha1(CASE WHEN t.text = '' THEN '' WHEN o = '' THEN 'Not in the graph. The LLM could not produce a citation-backed answer from the community evidence.' ELSE o END) AS answer_sha1 FROM o JOIN t ON o.doc_id = t.doc_id"""
)
def citation_enforce(spark: SparkSession, d: str) -> DataFrame:
    return _cited(table(spark, d, "documents")).select("doc_id", F.sha1(T.enforce_citations(F.col("text")).cast("binary")).alias("answer_sha1"))


@query("SELECT item_id FROM eval_items WHERE answer IS NOT NULL AND NOT contains(answer, '<<NO_RELEVANT_INFO>>') AND regexp_replace(answer, '^\\s+|\\s+$', '', 'g') <> ''")
def no_info_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_items").where(T.informative(F.col("answer"))).select("item_id")


@query("SELECT event_id, CAST(regexp_extract(props, '\"k\": *(-?[0-9]+)', 1) AS BIGINT) AS k FROM events WHERE props IS NOT NULL")
def json_block_parse(spark: SparkSession, d: str) -> DataFrame:
    said = F.concat(F.lit('Here is the result:\n```json\n{"note": "a } in a string", "data": '), F.col("props"), F.lit("}\n```\nAnything else? {}"))
    block = F.from_json(T.json_block(said), "note string, data struct<k bigint>")
    return table(spark, d, "events").where("props is not null").select("event_id", block.data.k.alias("k"))


@query("SELECT DISTINCT name, CASE WHEN f = '' THEN 'untitled' ELSE left(f, 120) END AS safe FROM (SELECT name, trim(regexp_replace(regexp_replace(name, '[\\\\/:*?\"<>|]+', ' ', 'g'), '\\s+', ' ', 'g')) AS f FROM extracted_entities WHERE name IS NOT NULL)")
def safe_filename(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "extracted_entities").where("name is not null").select("name").distinct().select("name", T.safe_filename(F.col("name")).alias("safe"))


@query("SELECT file_id, CAST(length(left(text, 3000)) AS BIGINT) AS kept, length(text) <= 1500 AS is_short FROM parsed_files WHERE text IS NOT NULL")
def doc_truncate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parsed_files").where("text is not null").select("file_id", F.length(T.truncated(F.col("text"), 1000)).cast("long").alias("kept"), (F.length("text") <= 1500).alias("is_short"))


@query("SELECT doc_id, sha1(replace(replace(text, '{', '{{'), '}', '}}')) AS escaped_sha1 FROM documents WHERE text IS NOT NULL")
def context_escape(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.sha1(T.escaped_context(F.col("text")).cast("binary")).alias("escaped_sha1"))


@query(
    """SELECT file_id, CASE WHEN coalesce(source, '') = '' THEN 'openai' WHEN contains(lower(source), '1234') OR contains(lower(source), 'lmstudio') THEN 'lmstudio' WHEN contains(lower(source), '11434') OR contains(lower(source), 'ollama') THEN 'ollama'
  WHEN contains(lower(source), 'googleapis.com') THEN 'gemini' WHEN contains(lower(source), 'anthropic') THEN 'anthropic' ELSE 'custom' END AS provider FROM parsed_files"""
)
def provider_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parsed_files").select("file_id", T.provider(F.col("source")).alias("provider"))


@query(
    """WITH v AS (SELECT term FROM ontology_terms WHERE kind = 'entity_type')
SELECT CASE WHEN type IN (SELECT term FROM v) THEN type ELSE 'OTHER' END AS coerced, CAST(count(*) AS BIGINT) AS n_rows FROM extracted_entities GROUP BY 1"""
)
def ontology_coerce(spark: SparkSession, d: str) -> DataFrame:
    terms = F.broadcast(table(spark, d, "ontology_terms").where("kind = 'entity_type'").select("term").distinct())  # a fixed vocabulary
    rows = table(spark, d, "extracted_entities").select("type").join(terms, F.col("type") == F.col("term"), "left")
    return rows.groupBy(F.coalesce("term", F.lit("OTHER")).alias("coerced")).agg(F.count("*").alias("n_rows"))


# Upserts


@query(
    f"""WITH {_ROWS}, d AS (SELECT topic, id, description, min(ord) AS o FROM rows_ GROUP BY topic, id, description),
t AS (SELECT topic, id, list(description ORDER BY o) AS ds FROM d GROUP BY topic, id),
s AS (SELECT topic, id, source, min(ord) AS o FROM rows_ WHERE source <> '' GROUP BY topic, id, source),
u AS (SELECT topic, id, list(source ORDER BY o) AS ss FROM s GROUP BY topic, id),
f AS (SELECT topic, id, arg_min(type, ord) AS type FROM rows_ GROUP BY topic, id)
SELECT t.topic, t.id, f.type, list_reduce(list_concat([''], ds), lambda acc, x: CASE WHEN x = '' OR contains(acc, x) THEN acc WHEN acc = '' THEN x ELSE acc || ' ' || x END) AS description,
  coalesce(array_to_string(ss, ' | '), '') AS sources FROM t JOIN f ON t.topic = f.topic AND t.id = f.id LEFT JOIN u ON t.topic = u.topic AND t.id = u.id"""
)
def node_upsert_merge(spark: SparkSession, d: str) -> DataFrame:
    return upsert.upsert_nodes(entity_rows(spark, d)).select("topic", "id", "type", "description", F.array_join("sources", " | ").alias("sources"))


@query(f"WITH {_EDGES} SELECT topic, src, label, dst, arg_max(description, ord) AS description FROM edges GROUP BY topic, src, label, dst")
def edge_upsert(spark: SparkSession, d: str) -> DataFrame:
    return upsert.upsert_edges(edges_of(spark, d)).drop("ord")


@query(
    f"""WITH {_EDGES}, e AS (SELECT topic, src, label, dst, description, min(ord) AS o FROM edges GROUP BY topic, src, label, dst, description),
n AS (SELECT topic, src, label, dst, CAST(count(*) AS BIGINT) AS n_rows FROM edges GROUP BY topic, src, label, dst),
t AS (SELECT topic, src, label, dst, list_reduce(list_concat([''], list(description ORDER BY o)), lambda acc, x: CASE WHEN x = '' OR contains(acc, x) THEN acc WHEN acc = '' THEN x ELSE acc || ' ' || x END) AS description FROM e GROUP BY topic, src, label, dst)
SELECT * FROM t JOIN n USING (topic, src, label, dst)"""
)
def edge_dedup(spark: SparkSession, d: str) -> DataFrame:
    return upsert.collapse_edges(edges_of(spark, d)).drop("ord")


@query(
    f"""WITH {_EDGES}, e AS (SELECT topic, filename, unnest([source, target]) AS name FROM extracted_relationships)
SELECT DISTINCT topic, filename, name FROM e WHERE name <> '' AND NOT EXISTS (SELECT 1 FROM extracted_entities x WHERE x.topic = e.topic AND x.filename = e.filename AND x.name = e.name)"""
)
def endpoint_completion(spark: SparkSession, d: str) -> DataFrame:
    rel = table(spark, d, "extracted_relationships").select("topic", "filename", F.col("source").alias("src"), F.col("target").alias("dst"))
    return upsert.missing_endpoints(rel, table(spark, d, "extracted_entities"))


_REMOVAL = f"""{_EDGES}, each AS (SELECT topic, id, unnest(CASE WHEN len(coalesce(sources, [])) = 0 THEN CAST([NULL] AS VARCHAR[]) ELSE sources END) AS x FROM entity_index WHERE id IS NOT NULL),
s AS (SELECT topic, id, coalesce(list(DISTINCT x ORDER BY x) FILTER (WHERE x IS NOT NULL), []) AS sources FROM each GROUP BY topic, id),
k AS (SELECT topic, id, sources, list_filter(sources, lambda x: NOT x LIKE '%.csv') AS kept FROM s),
dead AS (SELECT topic, id FROM k WHERE len(sources) > 0 AND len(kept) = 0),
rest AS (SELECT e.* FROM edges e ANTI JOIN dead a ON e.topic = a.topic AND e.src = a.id ANTI JOIN dead b ON e.topic = b.topic AND e.dst = b.id)"""


def _removal(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, tuple[DataFrame, DataFrame]]:
    """Nodes of the index, nodes without any source among them, and edges; all CSV files are removed."""
    each = table(spark, d, "entity_index").where("id is not null").select("topic", "id", F.explode_outer("sources").alias("s"))
    nodes = each.groupBy("topic", "id").agg(F.array_sort(F.collect_set("s")).alias("sources"))
    removed = each.where(F.col("s").endswith(".csv")).select("topic", F.col("s").alias("source")).distinct()
    edges = edges_of(spark, d)
    return nodes, edges, upsert.remove_sources(nodes, edges, removed)


@query(f"WITH {_REMOVAL} SELECT topic, id, array_to_string(kept, ' | ') AS sources, len(kept) < len(sources) AS trimmed FROM k WHERE NOT (len(sources) > 0 AND len(kept) = 0)")
def remove_sources(spark: SparkSession, d: str) -> DataFrame:
    alive = _removal(spark, d)[2][0]
    return alive.select("topic", "id", F.array_join("sources", " | ").alias("sources"), "trimmed")


@query(f"WITH {_REMOVAL} SELECT topic, src, label, dst, ord FROM rest")
def remove_sources_edges(spark: SparkSession, d: str) -> DataFrame:
    return _removal(spark, d)[2][1].select("topic", "src", "label", "dst", "ord")


@query(
    f"""WITH {_REMOVAL}, n AS (SELECT topic, count(*) FILTER (WHERE len(sources) > 0 AND len(kept) = 0) AS gone, count(*) FILTER (WHERE len(kept) > 0 AND len(kept) < len(sources)) AS trimmed FROM k GROUP BY topic),
e AS (SELECT topic, count(*) AS n FROM edges GROUP BY topic), r AS (SELECT topic, count(*) AS n FROM rest GROUP BY topic)
SELECT n.topic, CAST(gone AS BIGINT) AS nodes_removed, CAST(coalesce(e.n, 0) - coalesce(r.n, 0) AS BIGINT) AS edges_removed, CAST(trimmed AS BIGINT) AS nodes_trimmed FROM n LEFT JOIN e ON n.topic = e.topic LEFT JOIN r ON n.topic = r.topic WHERE gone + trimmed + coalesce(e.n, 0) - coalesce(r.n, 0) > 0"""
)
def remove_sources_counts(spark: SparkSession, d: str) -> DataFrame:
    return upsert.removal_counts(*_removal(spark, d))


# Graph


@query(
    f"""WITH {_EDGES} SELECT topic, least(src, dst) AS a, greatest(src, dst) AS b, arg_max(label, ord) AS label, CAST(count(*) AS BIGINT) AS n_edges FROM edges WHERE src <> dst GROUP BY 1, 2, 3"""
)
def undirected_collapse(spark: SparkSession, d: str) -> DataFrame:
    return graph.undirected(edges_of(spark, d)).drop("description")


@query(f"WITH {_EDGES}, {_DEGREE} SELECT topic, id, degree FROM degree")
def node_degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(edges_of(spark, d))


@query(f"WITH {_INDEX}, r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY degree DESC, ord, id) AS place FROM idx) SELECT topic, id, type, degree, place FROM r WHERE place <= 15")
def top_hubs(spark: SparkSession, d: str) -> DataFrame:
    return graph.top_hubs(nodes_of(spark, d), edges_of(spark, d)).select("topic", "id", "type", "degree", F.col("place").cast("long").alias("place"))


@query(f"WITH {_NODES} SELECT topic, coalesce(nullif(type, ''), 'OTHER') AS type, CAST(count(*) AS BIGINT) AS n_entities FROM nodes GROUP BY 1, 2")
def type_counts(spark: SparkSession, d: str) -> DataFrame:
    return index.type_counts(nodes_of(spark, d))


@query(f"WITH {_INDEX} SELECT topic, type, CAST(row_number() OVER (PARTITION BY topic, type ORDER BY degree DESC, ord, id) AS BIGINT) AS place, id, degree FROM idx")
def by_type(spark: SparkSession, d: str) -> DataFrame:
    return index.grouped(index_of(spark, d), "type")


@query(f"WITH {_INDEX} SELECT topic, community, CAST(row_number() OVER (PARTITION BY topic, community ORDER BY degree DESC, ord, id) AS BIGINT) AS place, id, degree FROM idx WHERE community IS NOT NULL")
def by_community(spark: SparkSession, d: str) -> DataFrame:
    return index.grouped(index_of(spark, d), "community")


@query(
    f"""WITH {_INDEX}, p AS (SELECT topic, type, id, row_number() OVER (PARTITION BY topic, type ORDER BY degree DESC, ord, id) AS place FROM idx),
c AS (SELECT topic, greatest(5, floor(120 / greatest(1, count(DISTINCT type)))) AS cap FROM idx GROUP BY topic),
g AS (SELECT p.topic, p.type, any_value(cap) AS cap, count(*) AS n, string_agg(id, ', ' ORDER BY place) FILTER (WHERE place <= cap) AS names FROM p JOIN c ON p.topic = c.topic GROUP BY p.topic, p.type)
SELECT topic, type, '- **' || type || '**: ' || names || CASE WHEN n > cap THEN ', … (+' || CAST(CAST(n - cap AS BIGINT) AS VARCHAR) || ' more)' ELSE '' END AS line FROM g"""
)
def index_digest(spark: SparkSession, d: str) -> DataFrame:
    return index.digest(index_of(spark, d))


@query(f"WITH {_INDEX} SELECT topic, type AS section, CAST(row_number() OVER (PARTITION BY topic, type ORDER BY degree DESC, ord, id) AS BIGINT) AS place, '- **' || id || '**' || CASE WHEN description <> '' THEN ' — ' || description ELSE '' END AS line FROM idx")
def index_markdown(spark: SparkSession, d: str) -> DataFrame:
    return index.index_lines(index_of(spark, d))


@query(
    f"""WITH {_INDEX}, s AS (SELECT *, CASE WHEN lower(id) = 'media' THEN 100 WHEN starts_with(lower(id), 'media') THEN 80 WHEN contains(lower(id), 'media') THEN 60 WHEN contains(lower(type), 'media') THEN 40 WHEN contains(lower(description), 'media') THEN 20 END AS score FROM idx)
SELECT topic, id, CAST(score AS BIGINT) AS score, degree FROM s WHERE score IS NOT NULL ORDER BY score DESC, degree DESC, id, topic LIMIT 10"""
)
def node_search(spark: SparkSession, d: str) -> DataFrame:
    return index.node_search(index_of(spark, d), "Media")


@query(
    f"""WITH {_EDGES}, c AS (SELECT DISTINCT topic, name AS center FROM extracted_entities WHERE ent_id % 100 = 0 AND trim(name) <> ''),
e AS (SELECT topic, src AS center, dst AS id FROM edges UNION SELECT topic, dst, src FROM edges)
SELECT topic, center, center AS id, 0 AS hops FROM c UNION ALL SELECT DISTINCT e.topic, e.center, e.id, 1 FROM e JOIN c ON e.topic = c.topic AND e.center = c.center WHERE e.center <> e.id"""
)
def ego_network(spark: SparkSession, d: str) -> DataFrame:
    """Queries: every entity whose id is divisible by 100."""
    centers = table(spark, d, "extracted_entities").where("ent_id % 100 = 0 and trim(name) <> ''").select("topic", F.col("name").alias("id"))
    return graph.ego_network(edges_of(spark, d), centers)


@query(
    f"""WITH {_NODES}, {_EDGES}, x AS (SELECT topic, src AS id, 'out' AS direction, label, dst AS other, ord FROM edges UNION ALL SELECT topic, dst, 'in', label, src, ord FROM edges WHERE src <> dst)
SELECT x.topic, x.id, x.direction, x.label, x.other, coalesce(n.type, 'ENTITY') AS other_type, x.ord FROM x LEFT JOIN nodes n ON x.topic = n.topic AND x.other = n.id"""
)
def node_detail(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(edges_of(spark, d), nodes_of(spark, d)).drop("description")


@query(
    f"""WITH {_NODES}, {_EDGES}, {_COMM},
ok AS (SELECT e.* FROM edges e SEMI JOIN nodes a ON e.topic = a.topic AND e.src = a.id SEMI JOIN nodes b ON e.topic = b.topic AND e.dst = b.id),
used AS (SELECT DISTINCT topic, src AS id FROM ok UNION SELECT topic, dst FROM ok),
b AS (SELECT topic, count(*) AS entities, round(avg(CASE WHEN type <> '' AND type <> 'OTHER' THEN 1.0 ELSE 0.0 END), 3) AS typed_ratio FROM nodes GROUP BY topic),
o AS (SELECT topic, count(*) AS orphans FROM nodes n ANTI JOIN used u ON n.topic = u.topic AND n.id = u.id GROUP BY topic)
SELECT b.topic, CAST(entities AS BIGINT) AS entities, CAST(coalesce((SELECT count(*) FROM edges e WHERE e.topic = b.topic), 0) AS BIGINT) AS edges,
  CAST(coalesce((SELECT count(DISTINCT community) FROM comm c WHERE c.topic = b.topic), 0) AS BIGINT) AS communities, CAST(coalesce(o.orphans, 0) AS BIGINT) AS orphans,
  CAST(coalesce((SELECT count(*) FROM edges e WHERE e.topic = b.topic), 0) - coalesce((SELECT count(*) FROM ok WHERE ok.topic = b.topic), 0) AS BIGINT) AS dangling, CAST(typed_ratio AS DOUBLE) AS typed_ratio
FROM b LEFT JOIN o ON b.topic = o.topic"""
)
def health_report(spark: SparkSession, d: str) -> DataFrame:
    return graph.health_report(nodes_of(spark, d), edges_of(spark, d), communities_of(spark, d))


@query(
    f"""WITH {_DRAWN}, w AS (SELECT *, min(degree) OVER (PARTITION BY topic) AS lo, max(degree) OVER (PARTITION BY topic) AS hi FROM drawn)
SELECT topic, id, round(CAST(8 + 28 * (degree - lo) / CAST(CASE WHEN hi = lo THEN 1 ELSE hi - lo END AS DOUBLE) AS DOUBLE), 6) AS radius FROM w"""
)
def node_radius(spark: SparkSession, d: str) -> DataFrame:
    return graph.node_radius(nodes_of(spark, d), edges_of(spark, d))


@query(
    f"""WITH {_NODES}, f AS (SELECT topic, type, min(ord) AS o FROM nodes WHERE type <> '' GROUP BY topic, type) SELECT topic, type, CAST((row_number() OVER (PARTITION BY topic ORDER BY o, type) - 1) % 15 AS BIGINT) AS colour FROM f
UNION ALL SELECT DISTINCT topic, 'OTHER', CAST(-1 AS BIGINT) FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.topic = n.topic AND f.type = 'OTHER')"""
)
def type_colours(spark: SparkSession, d: str) -> DataFrame:
    return graph.type_colours(nodes_of(spark, d))


@query(f"WITH {_DRAWN} SELECT l.topic, l.a, l.b, l.label FROM links l JOIN drawn x ON l.topic = x.topic AND l.a = x.id JOIN drawn y ON l.topic = y.topic AND l.b = y.id WHERE least(x.degree, y.degree) >= 4")
def edge_label_visibility(spark: SparkSession, d: str) -> DataFrame:
    return graph.visible_labels(nodes_of(spark, d), edges_of(spark, d), 6).select("topic", "a", "b", "label")


@query(f"WITH {_NODES}, {_EDGES}, v AS (SELECT topic, id FROM nodes WHERE type NOT IN ('CONCEPT', 'OTHER')) SELECT e.topic, e.src, e.label, e.dst, e.ord FROM edges e SEMI JOIN v a ON e.topic = a.topic AND e.src = a.id SEMI JOIN v b ON e.topic = b.topic AND e.dst = b.id")
def type_filter(spark: SparkSession, d: str) -> DataFrame:
    return graph.without_types(nodes_of(spark, d), edges_of(spark, d), ["CONCEPT", "OTHER"])[1].drop("description")


_INTRA = f"{_EDGES}, {_COMM}, intra AS (SELECT e.topic, a.community, e.src, e.label, e.dst, e.description, e.ord FROM edges e JOIN comm a ON e.topic = a.topic AND e.src = a.id JOIN comm b ON e.topic = b.topic AND e.dst = b.id WHERE a.community = b.community)"


@query(f"WITH {_INTRA} SELECT topic, community, src, label, dst, ord FROM intra")
def intra_community_edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.intra_community_edges(edges_of(spark, d), communities_of(spark, d)).drop("description")


@query(f"WITH {_INTRA} SELECT DISTINCT topic, community, src || ' --[' || label || ']--> ' || dst || CASE WHEN description <> '' THEN ' (' || description || ')' ELSE '' END AS line FROM intra")
def community_relationship_lines(spark: SparkSession, d: str) -> DataFrame:
    return graph.relationship_lines(edges_of(spark, d), communities_of(spark, d))


# Deduplication


_NAME_KEY = "lower(trim(regexp_replace(" + _AMERICAN.replace("(name,", "(id,") + ", '\\s+', ' ', 'g')))"
_GROUPS = f"keyed AS (SELECT topic, id, {_NAME_KEY} AS key FROM nodes), groups_ AS (SELECT * FROM keyed WHERE key <> '' AND (topic, key) IN (SELECT (topic, key) FROM keyed WHERE key <> '' GROUP BY topic, key HAVING count(*) > 1))"


@query(f"WITH {_NODES}, {_GROUPS} SELECT topic, key, id FROM groups_")
def merge_groups(spark: SparkSession, d: str) -> DataFrame:
    return dedup.merge_groups(nodes_of(spark, d))


@query(
    f"""WITH {_NODES}, {_EDGES}, {_DEGREE}, {_GROUPS}
SELECT g.topic, g.key, arg_max(g.id, row(coalesce(d.degree, 0), length(g.id), g.id)) AS canonical FROM groups_ g LEFT JOIN degree d ON g.topic = d.topic AND g.id = d.id GROUP BY g.topic, g.key"""
)
def canonical_pick(spark: SparkSession, d: str) -> DataFrame:
    return dedup.canonical_nodes(dedup.merge_groups(nodes_of(spark, d)), graph.degrees(edges_of(spark, d)))


_ALIAS = """al AS (SELECT topic, trim(alias) AS alias, arg_min(trim(canonical), row(CASE WHEN origin = 'ontology' THEN 0 ELSE 1 END, -coalesce(epoch_us(learned_at), 0), trim(canonical))) AS canonical
  FROM aliases WHERE trim(alias) <> '' AND trim(canonical) <> '' GROUP BY topic, trim(alias))"""


@query(f"WITH {_ALIAS} SELECT topic, alias, canonical FROM al")
def alias_precedence(spark: SparkSession, d: str) -> DataFrame:
    return dedup.alias_map(table(spark, d, "aliases"))


@query(
    f"""WITH RECURSIVE {_NODES}, {_ALIAS}, ok AS (SELECT al.topic, alias AS a, canonical AS b FROM al SEMI JOIN nodes x ON al.topic = x.topic AND al.alias = x.id SEMI JOIN nodes y ON al.topic = y.topic AND al.canonical = y.id WHERE alias <> canonical),
e AS (SELECT topic, a, b FROM ok UNION SELECT topic, b, a FROM ok), v AS (SELECT topic, a AS id FROM e),
reach AS (SELECT topic, id, id AS other FROM v UNION SELECT r.topic, r.id, e.b FROM reach r JOIN e ON r.topic = e.topic AND r.other = e.a)
SELECT topic, id, min(other) AS root FROM reach GROUP BY topic, id"""
)
def merge_closure(spark: SparkSession, d: str) -> DataFrame:
    usable = dedup.applicable_aliases(dedup.alias_map(table(spark, d, "aliases")), nodes_of(spark, d))
    return dedup.closure(usable.select("topic", F.col("alias").alias("a"), F.col("canonical").alias("b")))


@query(
    f"""WITH {_EDGES}, {_ALIAS}, n AS (SELECT e.topic, coalesce(a.canonical, e.src) AS src, e.label, coalesce(b.canonical, e.dst) AS dst, e.ord
  FROM edges e LEFT JOIN al a ON e.topic = a.topic AND e.src = a.alias LEFT JOIN al b ON e.topic = b.topic AND e.dst = b.alias) SELECT topic, src, label, dst, ord FROM n WHERE src <> dst"""
)
def merge_apply(spark: SparkSession, d: str) -> DataFrame:
    mapping = dedup.alias_map(table(spark, d, "aliases")).select("topic", F.col("alias").alias("id"), F.col("canonical").alias("winner"))
    return dedup.apply_merge(edges_of(spark, d), mapping).drop("description")


@query()
def deduplicated_nodes(spark: SparkSession, d: str) -> DataFrame:
    nodes = upsert.upsert_nodes(entity_rows(spark, d))
    edges = edges_of(spark, d)
    merged, _, _ = dedup.deduplicate(nodes, edges, graph.degrees(edges), table(spark, d, "aliases"))
    return merged.select("topic", "id", "type", "description", F.array_join("sources", " | ").alias("sources"), "grown")


@query(f"WITH {_NODES} SELECT topic, id, CAST(row_number() OVER (PARTITION BY topic ORDER BY {_SIGNATURE.replace('(name,', '(id,')}, id) AS BIGINT) AS place FROM nodes")
def resolver_order(spark: SparkSession, d: str) -> DataFrame:
    return dedup.resolver_order(nodes_of(spark, d))


@query(
    f"""WITH RECURSIVE {_NODES}, o AS (SELECT topic, id, length('- "' || id || '" (' || type || '): ' || left(description, 120)) + 1 AS n, row_number() OVER (PARTITION BY topic ORDER BY {_SIGNATURE.replace('(name,', '(id,')}, id) AS k FROM nodes),
b AS (SELECT topic, id, k, 1 AS batch, 1 AS lines, n AS used FROM o WHERE k = 1
  UNION ALL SELECT o.topic, o.id, o.k, CASE WHEN b.lines >= 25 OR b.used + o.n > 6000 THEN b.batch + 1 ELSE b.batch END, CASE WHEN b.lines >= 25 OR b.used + o.n > 6000 THEN 1 ELSE b.lines + 1 END, CASE WHEN b.lines >= 25 OR b.used + o.n > 6000 THEN o.n ELSE b.used + o.n END
  FROM b JOIN o ON o.topic = b.topic AND o.k = b.k + 1)
SELECT topic, id, CAST(batch AS BIGINT) AS batch FROM b"""
)
def resolver_batches(spark: SparkSession, d: str) -> DataFrame:
    return dedup.resolver_batches(nodes_of(spark, d))


@query(f"WITH {_NODES} SELECT topic, id, CAST(row_number() OVER (PARTITION BY topic ORDER BY coalesce(type, ''), id) AS BIGINT) AS place FROM nodes")
def resolver_order_by_type(spark: SparkSession, d: str) -> DataFrame:
    return dedup.resolver_order(nodes_of(spark, d), "type")


@query(
    f"""WITH RECURSIVE {_NODES}, o AS (SELECT topic, id, length('- "' || id || '" (' || type || '): ' || left(description, 120)) + 1 AS n, row_number() OVER (PARTITION BY topic ORDER BY coalesce(type, ''), id) AS k FROM nodes),
b AS (SELECT topic, id, k, 1 AS batch, 1 AS lines, n AS used FROM o WHERE k = 1
  UNION ALL SELECT o.topic, o.id, o.k, CASE WHEN b.lines >= 25 OR b.used + o.n > 6000 THEN b.batch + 1 ELSE b.batch END, CASE WHEN b.lines >= 25 OR b.used + o.n > 6000 THEN 1 ELSE b.lines + 1 END, CASE WHEN b.lines >= 25 OR b.used + o.n > 6000 THEN o.n ELSE b.used + o.n END
  FROM b JOIN o ON o.topic = b.topic AND o.k = b.k + 1)
SELECT topic, id, CAST(batch AS BIGINT) AS batch FROM b"""
)
def resolver_batches_by_type(spark: SparkSession, d: str) -> DataFrame:
    return dedup.resolver_batches(nodes_of(spark, d), by="type")


# Contexts and notes


@query(
    f"""WITH {_ROWS}, f AS (SELECT topic, id, min(ord) AS ord FROM rows_ GROUP BY topic, id), e AS (SELECT DISTINCT topic, source, id FROM rows_ WHERE trim(source) <> ''),
p AS (SELECT e.*, row_number() OVER (PARTITION BY e.topic, e.source ORDER BY f.ord, e.id) AS place FROM e JOIN f ON e.topic = f.topic AND e.id = f.id)
SELECT topic, source, CAST(count(*) AS BIGINT) AS n_entities, string_agg(id, ', ' ORDER BY place) FILTER (WHERE place <= 8) || CASE WHEN count(*) > 8 THEN ' (+' || CAST(count(*) - 8 AS VARCHAR) || ' more)' ELSE '' END AS line FROM p GROUP BY topic, source"""
)
def source_entity_map(spark: SparkSession, d: str) -> DataFrame:
    return index.source_entities(upsert.upsert_nodes(entity_rows(spark, d)))


@query(
    f"""WITH {_NODES}, {_EDGES}, x AS (SELECT topic, src AS id, 'out' AS direction, label, dst AS other, description, ord FROM edges UNION ALL SELECT topic, dst, 'in', label, src, description, ord FROM edges WHERE src <> dst),
p AS (SELECT *, row_number() OVER (PARTITION BY topic, id, direction ORDER BY ord, label, other) AS place FROM x)
SELECT topic, id, direction, CAST(place AS BIGINT) AS place, CASE direction WHEN 'out' THEN '- [' || label || '] → ' || other || ': ' || description ELSE '- ' || other || ' → [' || label || ']: ' || description END AS line FROM p WHERE place <= 25"""
)
def wiki_context(spark: SparkSession, d: str) -> DataFrame:
    return index.wiki_context(graph.neighbours(edges_of(spark, d), nodes_of(spark, d)))


@query(
    f"""WITH {_INDEX}, e AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY degree DESC, ord, id) AS place FROM idx),
ok AS (SELECT x.* FROM edges x SEMI JOIN nodes a ON x.topic = a.topic AND x.src = a.id SEMI JOIN nodes b ON x.topic = b.topic AND x.dst = b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY ord, src, label, dst) AS place FROM ok)
SELECT topic, 'entity' AS part, CAST(place AS BIGINT) AS place, '- ' || id || ' (' || type || ', ' || degree || ' connections): ' || left(description, 220) AS line FROM e WHERE place <= 30
UNION ALL SELECT topic, 'relation', CAST(place AS BIGINT), '- ' || src || ' → [' || label || '] → ' || dst || ': ' || left(description, 150) FROM r WHERE place <= 40
UNION ALL SELECT topic, 'source', CAST(i AS BIGINT), '[' || i || '] ' || source || ' — contributes to: ' || list_aggregate(names[1:8], 'string_agg', ', ') || CASE WHEN len(names) > 8 THEN ' (+' || (len(names) - 8) || ' more)' ELSE '' END
  FROM (SELECT topic, source, list(id ORDER BY place) AS names, row_number() OVER (PARTITION BY topic ORDER BY source) AS i FROM (SELECT DISTINCT e.topic, r2.source, e.id, e.place FROM e JOIN rows_ r2 ON e.topic = r2.topic AND e.id = r2.id AND r2.source <> '' WHERE place <= 30) GROUP BY topic, source)"""
)
def blog_context(spark: SparkSession, d: str) -> DataFrame:
    return index.blog_context(index_of(spark, d), graph.valid_edges(edges_of(spark, d), nodes_of(spark, d)))


@query(
    f"""WITH {_NODES}, b AS (SELECT topic, id, ord, left(CASE WHEN f = '' THEN 'untitled' ELSE f END, 120) AS base FROM (SELECT *, trim(regexp_replace(regexp_replace(id, '[\\\\/:*?"<>|]+', ' ', 'g'), '\\s+', ' ', 'g')) AS f FROM nodes)),
n AS (SELECT *, row_number() OVER (PARTITION BY topic, base ORDER BY ord, id) AS n FROM b) SELECT topic, id, CASE WHEN n = 1 THEN base ELSE base || ' (' || CAST(n AS VARCHAR) || ')' END AS stem FROM n"""
)
def filename_disambiguate(spark: SparkSession, d: str) -> DataFrame:
    return index.file_stems(nodes_of(spark, d))


# Questions


def _summaries(spark: SparkSession, d: str) -> DataFrame:
    return search.community_summaries(nodes_of(spark, d).join(communities_of(spark, d), ["topic", "id"]))


@query(
    f"""WITH {_NODES}, {_COMM}, s AS (SELECT n.topic, c.community, string_agg(n.description, ' ' ORDER BY n.ord, n.id) AS text FROM nodes n JOIN comm c ON n.topic = c.topic AND n.id = c.id GROUP BY n.topic, c.community),
p AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY CASE WHEN regexp_full_match(community, '[0-9]+') THEN CAST(community AS HUGEINT) ELSE 999 END, community) AS place FROM s)
SELECT topic, CAST(place AS BIGINT) AS place, 'Community ' || place || ': ' || left(text, 500) AS line FROM p WHERE place <= 20"""
)
def blog_communities(spark: SparkSession, d: str) -> DataFrame:
    return index.blog_communities(_summaries(spark, d).withColumnRenamed("text", "summary"))


_SUMMARY = f"""{_NODES}, {_COMM}, summary AS (SELECT n.topic, c.community, lower(string_agg(n.description, ' ' ORDER BY n.ord, n.id)) AS text FROM nodes n JOIN comm c ON n.topic = c.topic AND n.id = c.id GROUP BY n.topic, c.community), {_WANTED},
hit AS (SELECT qid, topic, community, CAST(count(*) AS BIGINT) AS n FROM wanted JOIN summary ON contains(text, keyword) GROUP BY qid, topic, community)"""
_BONUS = f"""hay AS (SELECT n.topic, c.community, n.ord, n.id, lower(n.id || ' ' || {_FIRST.replace('(text,', '(description,')}) AS text FROM nodes n JOIN comm c ON n.topic = c.topic AND n.id = c.id),
bonus AS (SELECT qid, topic, community, CAST(count(*) AS BIGINT) AS bonus FROM wanted JOIN hay ON contains(text, keyword) GROUP BY qid, topic, community)"""


@query(f"WITH {_SUMMARY} SELECT qid, topic, community, n FROM hit")
def summary_keyword_score(spark: SparkSession, d: str) -> DataFrame:
    return search.keyword_hits(_summaries(spark, d), search.question_keywords(_questions(spark, d)), ["topic", "community"])


@query(f"WITH {_SUMMARY}, {_BONUS} SELECT qid, topic, community, bonus FROM bonus")
def entity_index_bonus(spark: SparkSession, d: str) -> DataFrame:
    return search.entity_bonus(nodes_of(spark, d).join(communities_of(spark, d), ["topic", "id"], "left"), search.question_keywords(_questions(spark, d)))


@query(
    f"""WITH {_SUMMARY}, {_BONUS}, t AS (SELECT coalesce(h.qid, b.qid) AS qid, coalesce(h.topic, b.topic) AS topic, coalesce(h.community, b.community) AS community, CAST(coalesce(n, 0) + coalesce(bonus, 0) AS DOUBLE) AS total
  FROM hit h FULL JOIN bonus b ON h.qid = b.qid AND h.topic = b.topic AND h.community = b.community),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY total DESC, topic, community) AS BIGINT) AS place FROM t WHERE total > 0) SELECT qid, topic, community, total, place FROM p WHERE place <= 15"""
)
def candidate_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.candidates(summary_keyword_score(spark, d), entity_index_bonus(spark, d))


@query(
    f"""WITH {_SUMMARY}, q AS (SELECT DISTINCT item_id AS qid FROM eval_items ANTI JOIN hit h ON item_id = h.qid),
f AS (SELECT topic, community, CAST(row_number() OVER (ORDER BY topic, community) AS BIGINT) AS place FROM summary ORDER BY topic, community LIMIT 15) SELECT qid, topic, community, place FROM q CROSS JOIN f"""
)
def candidate_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Questions of which no summary has any keyword get the first communities."""
    return search.fallback_candidates(_questions(spark, d), summary_keyword_score(spark, d), _summaries(spark, d))


@query(
    """WITH q AS (SELECT vec_id AS qid, embedding AS v FROM embeddings WHERE vec_id % 100 = 0),
s AS (SELECT qid, vec_id, round(list_inner_product(CAST(v AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS similarity FROM q JOIN embeddings ON qid <> vec_id),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, vec_id) AS BIGINT) AS place FROM s) SELECT qid, vec_id, similarity, place FROM p WHERE place <= 15"""
)
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """Queries: every vector whose id is divisible by 100, against all."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    return search.vector_topk(e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("qid"), "vec"), e)


# Incremental builds


@query(
    """WITH c AS (SELECT topic, filename, max(mtime) AS now FROM parsed_files GROUP BY topic, filename),
s AS (SELECT topic, filename, max(epoch(extracted_at)) AS was FROM extracted_entities WHERE filename IS NOT NULL GROUP BY topic, filename)
SELECT c.topic, c.filename, CASE WHEN coalesce(now, 0) > coalesce(was, 0) THEN 'changed' ELSE 'unchanged' END AS change FROM c LEFT JOIN s ON c.topic = s.topic AND c.filename = s.filename
UNION ALL SELECT topic, filename, 'removed' FROM s WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.topic = s.topic AND c.filename = s.filename)"""
)
def manifest_diff(spark: SparkSession, d: str) -> DataFrame:
    stored = table(spark, d, "extracted_entities").where("filename is not null").select("topic", "filename", (F.unix_micros(F.col("extracted_at").cast("timestamp")) / 1e6).alias("mtime"))
    return incremental.manifest_diff(table(spark, d, "parsed_files"), stored)


@query(
    f"""WITH {_NODES}, live AS (SELECT topic, id, sha1(description) AS h FROM nodes),
cached AS (SELECT topic, id, sha1(coalesce(min(description), '')) AS h FROM entity_index WHERE id IS NOT NULL GROUP BY topic, id)
SELECT l.topic, l.id, CASE WHEN l.h = c.h THEN 'keep' ELSE 'encode' END AS action FROM live l LEFT JOIN cached c ON l.topic = c.topic AND l.id = c.id
UNION ALL SELECT topic, id, 'drop' FROM cached c WHERE NOT EXISTS (SELECT 1 FROM live l WHERE l.topic = c.topic AND l.id = c.id)"""
)
def embedding_cache_sync(spark: SparkSession, d: str) -> DataFrame:
    live = nodes_of(spark, d).select("topic", "id", F.col("description").alias("text"))
    cached = table(spark, d, "entity_index").where("id is not null").groupBy("topic", "id").agg(F.sha1(F.coalesce(F.min("description"), F.lit("")).cast("binary")).alias("sha1"))
    return incremental.cache_sync(live, cached, ["topic", "id"])


@query("WITH n AS (SELECT DISTINCT topic, filename FROM parsed_files WHERE filename IS NOT NULL), p AS (SELECT *, CAST(row_number() OVER (PARTITION BY topic ORDER BY filename) AS BIGINT) AS place FROM n) SELECT topic, filename, place FROM p WHERE place <= 50")
def doc_cap(spark: SparkSession, d: str) -> DataFrame:
    return incremental.capped_documents(table(spark, d, "parsed_files"))


@query(
    f"""WITH {_NODES}, f AS (SELECT topic, count(*) AS n_files FROM parsed_files GROUP BY topic), g AS (SELECT topic, count(*) AS n_entities FROM nodes GROUP BY topic)
SELECT coalesce(f.topic, g.topic) AS topic, CAST(coalesce(n_files, 0) AS BIGINT) AS n_files, CAST(coalesce(n_entities, 0) AS BIGINT) AS n_entities, CASE WHEN coalesce(n_entities, 0) > 0 THEN 'ready' ELSE 'idle' END AS status FROM f FULL JOIN g ON f.topic = g.topic"""
)
def topic_discovery(spark: SparkSession, d: str) -> DataFrame:
    return incremental.topic_overview(table(spark, d, "parsed_files"), nodes_of(spark, d))


@query("SELECT item_id, suite, CAST(row_number() OVER (PARTITION BY suite ORDER BY item_id DESC) AS BIGINT) AS place FROM eval_items WHERE trim(question) <> '' AND trim(answer) <> ''")
def pinned_list(spark: SparkSession, d: str) -> DataFrame:
    ok = table(spark, d, "eval_items").where("trim(question) <> '' and trim(answer) <> ''")
    return ok.select("item_id", "suite", F.row_number().over(W.partitionBy("suite").orderBy(F.desc("item_id"))).cast("long").alias("place"))


# Communities, sources


@query()
def community_detect(spark: SparkSession, d: str) -> DataFrame:
    return community.detect_communities(graph.undirected(edges_of(spark, d)))


@query(
    f"""WITH {_EDGES}, p AS (SELECT topic, src AS id FROM edges WHERE src <> dst UNION SELECT topic, dst FROM edges WHERE src <> dst)
SELECT topic, CAST(count(*) AS BIGINT) AS n_nodes, CAST(count(*) AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS n_unconnected FROM p GROUP BY topic"""
)
def community_cover(spark: SparkSession, d: str) -> DataFrame:
    """Nodes with a community, rows of the assignment, and members that no edges within their community link to its name."""
    pairs = graph.undirected(edges_of(spark, d))
    found = Scratch(spark, "cover").write(community.detect_communities(pairs), "found")
    a, b = (found.select("topic", F.col("id").alias(x), F.col("community").alias(f"c_{x}")) for x in "ab")
    inner = pairs.join(a, ["topic", "a"]).join(b, ["topic", "b"]).where("c_a = c_b").select("topic", "a", "b")
    linked = found.join(closure(inner), ["topic", "id"], "left").withColumn("off", (F.coalesce("root", "id") != F.col("community")).cast("long"))
    return linked.groupBy("topic").agg(F.countDistinct("id").alias("n_nodes"), F.count("*").alias("n_rows"), F.sum("off").alias("n_unconnected"))


@query(r"SELECT doc_id, sha1(regexp_replace(regexp_replace(text, '[ \t]*\n\s*', chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS text_sha1 FROM documents WHERE text IS NOT NULL")
def html_text(spark: SparkSession, d: str) -> DataFrame:
    escaped = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    page = F.concat(F.lit("<html><head><style>p { color: red }</style></head><body><nav>Home</nav><p>"), escaped, F.lit("</p><script>var x = 1;</script><footer>End</footer></body></html>"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.sha1(files.html_fallback(page).cast("binary")).alias("text_sha1"))


def _csv(rows: DataFrame, header: list[str], cells: list, keys: list[str], order: str) -> DataFrame:
    """Rows of a table as the CSV file of each key: ``*keys, text, mode, cut``."""
    line = F.struct(order, F.array(*[F.col(c).cast("string") for c in cells]).alias("r"))
    held = rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(line)), lambda x: x.r).alias("cells"))
    text, extra = files.csv_rendering(F.array(*[F.lit(h) for h in header]), F.col("cells"))
    return held.select(*keys, text.alias("text"), extra["csv_mode"].alias("mode"), extra["truncated_to"].alias("cut"))


@query(
    """SELECT p_brand, string_agg('## ' || p_name || chr(10) || '- **Type:** ' || p_type || chr(10) || '- **size:** ' || p_size, chr(10) || chr(10) ORDER BY p_partkey) AS text, 'entity_per_row' AS mode, CAST(NULL AS VARCHAR) AS cut FROM part GROUP BY p_brand"""
)
def csv_entity_rows(spark: SparkSession, d: str) -> DataFrame:
    return _csv(table(spark, d, "part"), ["Name", "Type", "size"], ["p_name", "p_type", "p_size"], ["p_brand"], "p_partkey")


@query(
    """WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS k, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
SELECT o_orderpriority AS priority, 'Schema: order (int64), customer (int64), status (object)' || chr(10) || chr(10) || 'Rows (' || least(200, any_value(n)) || ' of ' || any_value(n) || '):' || chr(10)
  || string_agg('- order=' || o_orderkey || '; customer=' || o_custkey || '; status=' || o_orderstatus, chr(10) ORDER BY k) FILTER (WHERE k <= 200) AS text, 'table' AS mode, CASE WHEN any_value(n) > 200 THEN '200' END AS cut FROM o GROUP BY o_orderpriority"""
)
def csv_table(spark: SparkSession, d: str) -> DataFrame:
    return _csv(table(spark, d, "orders"), ["order", "customer", "status"], ["o_orderkey", "o_custkey", "o_orderstatus"], ["o_orderpriority"], "o_orderkey").withColumnRenamed("o_orderpriority", "priority")


@query("SELECT s_nationkey AS nation, string_agg(s_name, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY s_suppkey) AS text, 'narrative' AS mode, CAST(NULL AS VARCHAR) AS cut FROM supplier GROUP BY s_nationkey")
def csv_narrative(spark: SparkSession, d: str) -> DataFrame:
    return _csv(table(spark, d, "supplier"), ["id", "Body"], ["s_suppkey", "s_name"], ["s_nationkey"], "s_suppkey").withColumnRenamed("s_nationkey", "nation")


# The star schema as a property graph


_STAR = """star AS (SELECT 'nation:' || n_nationkey AS src, 'PART_OF' AS label, 'region:' || n_regionkey AS dst FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'LOCATED_IN', 'nation:' || c_nationkey FROM customer UNION ALL SELECT 'supplier:' || s_suppkey, 'LOCATED_IN', 'nation:' || s_nationkey FROM supplier
  UNION ALL SELECT DISTINCT 'supplier:' || l_suppkey, 'SUPPORTS', 'part:' || l_partkey FROM lineitem UNION ALL SELECT DISTINCT 'customer:' || o_custkey, 'REFERENCES', 'part:' || l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""


def star_edges(spark: SparkSession, d: str) -> DataFrame:
    """Regions, nations, customers, suppliers and parts as nodes of one graph."""
    name = lambda kind, key: F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))
    part = lambda df, a, label, b: df.select(F.lit("star").alias("topic"), a.alias("src"), F.lit(label).alias("label"), b.alias("dst"))
    line = table(spark, d, "lineitem")
    edges = part(table(spark, d, "nation"), name("nation", "n_nationkey"), "PART_OF", name("region", "n_regionkey"))
    edges = edges.unionByName(part(table(spark, d, "customer"), name("customer", "c_custkey"), "LOCATED_IN", name("nation", "c_nationkey")))
    edges = edges.unionByName(part(table(spark, d, "supplier"), name("supplier", "s_suppkey"), "LOCATED_IN", name("nation", "s_nationkey")))
    edges = edges.unionByName(part(line.select("l_suppkey", "l_partkey").distinct(), name("supplier", "l_suppkey"), "SUPPORTS", name("part", "l_partkey")))
    bought = table(spark, d, "orders").join(line, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_partkey").distinct()
    return edges.unionByName(part(bought, name("customer", "o_custkey"), "REFERENCES", name("part", "l_partkey")))


@query(f"WITH {_STAR}, ends AS (SELECT src AS id FROM star UNION ALL SELECT dst FROM star) SELECT id, CAST(count(*) AS BIGINT) AS degree FROM ends GROUP BY id")
def star_degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(star_edges(spark, d)).drop("topic")


@query("SELECT user_id, event_type, CAST(count(*) AS BIGINT) AS n_events, max(ts) AS last_seen FROM events GROUP BY user_id, event_type")
def event_activity(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n_events"), F.max("ts").alias("last_seen"))


_CITED = "cited AS (SELECT DISTINCT topic, regexp_extract(name, '^(\\S+)', 1) AS label FROM extracted_entities WHERE ent_id % 100 = 0 AND regexp_matches(name, '^\\S'))"


@query(
    f"""WITH {_NODES}, {_CITED}, x AS (SELECT c.topic, c.label, n.id, CASE WHEN lower(n.id) = lower(c.label) THEN 0 ELSE 1 END AS kind, n.ord FROM cited c JOIN nodes n ON c.topic = n.topic AND contains(lower(n.id), lower(c.label)))
SELECT topic, label, arg_min(id, row(kind, ord, id)) AS id FROM x GROUP BY topic, label"""
)
def label_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Labels: the first word of every name whose row id is divisible by 100, looked up in all nodes of the topic."""
    rows = table(spark, d, "extracted_entities").where(F.col("name").rlike(r"^\S") & (F.col("ent_id") % 100 == 0))
    return index.lookup_label(rows.select("topic", F.regexp_extract("name", r"^(\S+)", 1).alias("label")), nodes_of(spark, d))


@query(f"WITH {_INTRA}, b AS (SELECT * FROM intra UNION ALL SELECT topic, community, dst, label, src, description, ord FROM intra) SELECT DISTINCT topic, community, src || ' --[' || label || ']--> ' || dst || CASE WHEN description <> '' THEN ' (' || description || ')' ELSE '' END AS line FROM b")
def community_lines_both_ways(spark: SparkSession, d: str) -> DataFrame:
    return graph.relationship_lines(edges_of(spark, d), communities_of(spark, d), both_ways=True)


@query("WITH a AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings), m AS (SELECT label, arg_min(v, vec_id) AS first_v FROM a GROUP BY label) SELECT vec_id, a.label, round(list_inner_product(v, first_v), 6) AS similarity FROM a JOIN m ON a.label = m.label")
def vector_similarity(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of each vector to the first one of its label."""
    a = table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").alias("v"))
    first = a.groupBy("label").agg(F.min_by("v", "vec_id").alias("first_v"))
    return a.join(first, "label").select("vec_id", "label", F.round(T.dot(F.col("v"), F.col("first_v")), 6).alias("similarity"))


@query(
    """WITH live AS (SELECT topic, lower(regexp_replace(trim(name), ' +', ' ', 'g')) AS key, ent_id FROM extracted_entities WHERE deleted_at IS NULL AND trim(name) <> '')
SELECT topic, key, min(ent_id) AS first_id, CAST(count(*) AS BIGINT) AS n_rows FROM live GROUP BY topic, key HAVING count(*) > 1"""
)
def duplicate_names(spark: SparkSession, d: str) -> DataFrame:
    from tessera.functions.names import same_name

    live = table(spark, d, "extracted_entities").where("deleted_at is null and trim(name) <> ''").select("topic", same_name(F.col("name")).alias("key"), "ent_id")
    return live.groupBy("topic", "key").agg(F.min("ent_id").alias("first_id"), F.count("*").alias("n_rows")).where("n_rows > 1")
