"""Numbering rows within groups where a group may hold any share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.session import Scratch


def placed(rows: DataFrame, group: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """``rows`` with their place, from 1, in the given complete order of their group.

    No group is sorted in one task: rows are range-partitioned by group and order and written with the number of
    their partition, numbered within it, and shifted by the counts of the group's partitions before.
    ``order`` must leave no ties; a null group value is a group of its own.
    """
    scratch = Scratch(rows.sparkSession, "placed")
    ranged = rows.repartitionByRange(*[F.col(g) for g in group], *order).withColumn("_part", F.spark_partition_id())
    written = scratch.write(ranged, "rows")
    local = written.withColumn("_local", F.row_number().over(W.partitionBy(*group, "_part").orderBy(*order)))
    counts = written.groupBy(*group, "_part").agg(F.count("*").alias("_n"))
    before = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row a partition and group
    shift = counts.select(*[F.col(g).alias(f"_{g}") for g in group], F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = F.col("_part") == F.col("_p")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    out = local.join(shift, same)
    return out.select(*rows.columns, (F.col("_local") + F.col("_before")).cast("long").alias(name))
