"""References to records that do not exist: orphan endpoints per row, and counted per table and period.

Plan.  The endpoints of all relationships are reduced to their distinct non-null keys with a row
count (map-side partial aggregation, so a key that holds a third of all rows is one row per map task
after combining).  Those distinct keys are left-anti-joined with the distinct parent keys, which
gives the missing keys; an inner join of the same two tables gives, for the other keys, when the key
was first loaded and since when it has had a row that is never withdrawn.  The verdict per key is
then joined back to the endpoints.

Skew.  Keys with at least 1/``HOT_SHARE`` of all references number at most ``HOT_SHARE``; only those
keys are broadcast (bound proven by that share), and their rows are salted for the join back.
Endpoints that the verdict per key cannot settle (loaded
before the key's lasting row but after its first row) are settled by a running maximum over time,
cut into days per key with a carried-in maximum, so that one key's history is not one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.names import same_name
from tessera.session import Scratch

#: A key with at least this fraction (1/HOT_SHARE) of all references counts as hot: at most HOT_SHARE keys can.
HOT_SHARE = 256
#: A hot key's rows are spread over this many parts of the join back.
SALTS = 64


def endpoints(relationships: DataFrame) -> DataFrame:
    """One row per non-blank endpoint: ``rel_id, endpoint, topic, key, at, period``."""
    rel = relationships.select("rel_id", "topic", "source", "target", F.col("loaded_at").alias("at"))
    pair = F.array(
        F.struct(F.lit("source").alias("endpoint"), same_name(F.col("source")).alias("key")),
        F.struct(F.lit("target").alias("endpoint"), same_name(F.col("target")).alias("key")),
    )
    return (
        rel.select("rel_id", "topic", "at", F.explode(pair).alias("e"))
        .select("rel_id", "e.endpoint", F.coalesce("topic", F.lit("")).alias("topic"), "e.key", "at", F.date_format("at", "yyyy-MM").alias("period"))
        .where("key <> ''")
    )


def orphan_references(relationships: DataFrame, entities: DataFrame) -> DataFrame:
    """Endpoints whose entity is ``missing``, ``late`` or ``deleted`` at the relationship's load time.

    relationships: ``rel_id, topic, source, target, loaded_at``; entities: ``topic, name, loaded_at,
    deleted_at``; further columns are ignored.  Returns ``rel_id, endpoint, state, period``.

    missing: no entity row of the topic has the same name.  late: there are such rows, all loaded
    after the relationship.  deleted: each such row loaded by then was also withdrawn by then.

    Defined edge cases: null and blank endpoints are no references and give no row; a null topic is a
    topic of its own, the same as the empty string; an entity row with null ``loaded_at`` counts as
    loaded from the start; a relationship with null ``loaded_at`` is judged as of the end of time and
    has a null period; null or blank entity names are never parents; repeated relationship rows each
    give their own row.  Empty inputs give an empty result; without any entity every reference is missing.
    """
    begin, end = (F.lit(x).cast(entities.schema["loaded_at"].dataType) for x in ("0001-01-01", "9999-12-31"))
    refs = endpoints(relationships).withColumn("at", F.coalesce(F.col("at"), end))
    rows = entities.select(
        F.coalesce("topic", F.lit("")).alias("topic"),
        same_name(F.col("name")).alias("key"),
        F.coalesce("loaded_at", begin).alias("loaded_at"),
        "deleted_at",
    ).where("key <> ''")

    wanted = refs.groupBy("topic", "key").agg(F.count("*").alias("n"))
    parents = rows.groupBy("topic", "key").agg(
        F.min("loaded_at").alias("first_at"),
        F.min(F.when(F.col("deleted_at").isNull(), F.col("loaded_at"))).alias("lasting_at"),
        F.max("deleted_at").alias("last_deleted"),
    )
    none = F.lit(None).cast(entities.schema["loaded_at"].dataType)
    missing = wanted.join(parents, ["topic", "key"], "left_anti").select(
        "topic", "key", "n", none.alias("first_at"), none.alias("lasting_at"), none.alias("last_deleted")
    )
    scratch = Scratch(relationships.sparkSession, "references")
    verdicts = scratch.write(missing.unionByName(wanted.join(parents, ["topic", "key"])), "verdicts")

    total = verdicts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    hot = verdicts.join(F.broadcast(total), F.col("n") * HOT_SHARE >= F.col("total")).select("topic", "key", F.lit(True).alias("hot"))
    salts = F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    salted = verdicts.drop("n").join(F.broadcast(hot), ["topic", "key"], "left").withColumn("salt", salts).drop("hot")
    spread = F.when(F.col("hot"), F.pmod(F.xxhash64("rel_id", "endpoint"), F.lit(SALTS)).cast("int")).otherwise(0)
    judged = refs.join(F.broadcast(hot), ["topic", "key"], "left").withColumn("salt", spread).drop("hot").join(salted, ["topic", "key", "salt"])

    state = (
        F.when(F.col("first_at").isNull(), "missing")
        .when(F.col("at") < F.col("first_at"), "late")
        .when(F.col("at") >= F.col("lasting_at"), "fine")
        .when((F.col("at") >= F.col("last_deleted")) & F.col("lasting_at").isNull(), "deleted")
        .otherwise("open")
    )
    judged = judged.withColumn("state", state).where("state <> 'fine'")
    judged = scratch.write(judged.select("rel_id", "endpoint", "topic", "key", "at", "period", "state"), "judged")
    settled = judged.where("state <> 'open'").select("rel_id", "endpoint", "state", "period")
    unsettled = judged.where("state = 'open'").select("rel_id", "endpoint", "topic", "key", "at", "period")
    deleted = _withdrawn_by_then(unsettled, rows.where("deleted_at is not null"))
    return settled.unionByName(deleted.select("rel_id", "endpoint", F.lit("deleted").alias("state"), "period"))


def _withdrawn_by_then(refs: DataFrame, withdrawn: DataFrame) -> DataFrame:
    """Those of ``refs`` at whose time every withdrawn row loaded so far was already withdrawn.

    At time t some row is alive iff the greatest ``deleted_at`` of the rows loaded by t is after t, which
    is a running maximum over load time.  Distinct times only enter it; days keep its groups small.
    """
    marks = (
        withdrawn.join(refs.select("topic", "key").distinct(), ["topic", "key"], "left_semi")
        .groupBy("topic", "key", F.col("loaded_at").alias("at"))
        .agg(F.max("deleted_at").alias("until"))
        .withColumn("kind", F.lit(0))
    )
    times = refs.select("topic", "key", "at").distinct().withColumns({"until": F.lit(None).cast(withdrawn.schema["deleted_at"].dataType), "kind": F.lit(1)})
    line = marks.unionByName(times).withColumn("day", F.to_date("at"))
    per_day = line.groupBy("topic", "key", "day").agg(F.max("until").alias("day_until"))
    before = W.partitionBy("topic", "key").orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    carried = per_day.select("topic", "key", "day", F.max("day_until").over(before).alias("carried"))
    within = W.partitionBy("topic", "key", "day").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, 0)
    running = line.withColumn("running", F.max("until").over(within)).where("kind = 1")
    gone = (
        running.join(carried, ["topic", "key", "day"])
        .where(F.coalesce(F.greatest("running", "carried"), F.col("at")) <= F.col("at"))
        .select("topic", "key", "at")
    )
    return refs.join(gone, ["topic", "key", "at"], "left_semi")


def orphan_report(relationships: DataFrame, entities: DataFrame, table: str = "extracted_relationships") -> DataFrame:
    """Counts per table, endpoint column, period and state: ``table_name, endpoint, period, state, n_refs``."""
    found = orphan_references(relationships, entities)
    return found.groupBy(F.lit(table).alias("table_name"), "endpoint", "period", "state").agg(F.count("*").alias("n_refs"))
