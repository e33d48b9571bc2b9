"""Problem 3: queries on references to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.operators.references import orphan_references, orphan_report
from tessera.plans.tables import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return orphan_references(table(spark, d, "extracted_relationships"), table(spark, d, "extracted_entities"))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(table(spark, d, "extracted_relationships"), table(spark, d, "extracted_entities"))


QUERIES = {"p3_found": p3_found, "p3_report": p3_report}

_STATES = """
WITH ends AS (
  SELECT rel_id, 'source' AS endpoint, topic, lower(regexp_replace(trim(source), ' +', ' ', 'g')) AS key, loaded_at FROM extracted_relationships
  UNION ALL
  SELECT rel_id, 'target', topic, lower(regexp_replace(trim(target), ' +', ' ', 'g')), loaded_at FROM extracted_relationships),
refs AS (SELECT * FROM ends WHERE key <> ''),
parents AS (SELECT topic, lower(regexp_replace(trim(name), ' +', ' ', 'g')) AS key, loaded_at, deleted_at FROM extracted_entities),
judged AS (
  SELECT r.rel_id, r.endpoint, strftime(any_value(r.loaded_at), '%Y-%m') AS period,
         count(p.key) AS n_rows,
         count(*) FILTER (WHERE p.loaded_at <= r.loaded_at) AS n_loaded,
         count(*) FILTER (WHERE p.loaded_at <= r.loaded_at AND (p.deleted_at IS NULL OR p.deleted_at > r.loaded_at)) AS n_alive
  FROM refs r LEFT JOIN parents p ON r.topic = p.topic AND r.key = p.key
  GROUP BY r.rel_id, r.endpoint),
found AS (
  SELECT rel_id, endpoint, CASE WHEN n_rows = 0 THEN 'missing' WHEN n_loaded = 0 THEN 'late' ELSE 'deleted' END AS state, period
  FROM judged WHERE n_alive = 0)
"""

ORACLE = {
    "p3_found": _STATES + "SELECT rel_id, endpoint, state, period FROM found",
    "p3_report": _STATES
    + "SELECT 'extracted_relationships' AS table_name, endpoint, period, state, CAST(count(*) AS BIGINT) AS n_refs FROM found GROUP BY endpoint, period, state",
}
