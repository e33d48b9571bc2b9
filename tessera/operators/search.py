"""Choosing communities for questions: keyword overlap, entity hits, vector similarity, and their combination.

Keywords are runs of ASCII letters, so a keyword that occurs in a text lies inside one of its runs of letters.  Scoring
therefore matches distinct keywords with the vocabulary once, by a join on the keyword's first three letters, and goes on
by equi-joins, instead of matching every question with every text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.session import Scratch

def question_keywords(questions: DataFrame) -> DataFrame:
    """``qid, keyword``."""
    return questions.select("qid", F.explode(T.keywords(F.col("question"))).alias("keyword"))


def keyword_holders(texts: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """``*keys, keyword``: which of the wanted keywords each text contains.  texts: ``*keys, text``; wanted: ``qid, keyword``."""
    tokens = texts.select(*keys, F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0)))).alias("token"))
    starts = F.transform(F.sequence(F.lit(1), F.length("token") - 2), lambda i: F.substr(F.col("token"), i, F.lit(3)))
    parts = tokens.select("token").distinct().select("token", F.explode(F.array_distinct(starts)).alias("start"))
    words = wanted.select("keyword").distinct().withColumn("start", F.left("keyword", F.lit(3)))
    match = parts.join(words, "start").where(F.contains("token", "keyword")).select("token", "keyword")
    return tokens.join(match, "token").select(*keys, "keyword").distinct()


def keyword_hits(texts: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """``qid, *keys, n``: how many distinct keywords of a question each text contains, none left out."""
    return keyword_holders(texts, wanted, keys).join(wanted, "keyword").groupBy("qid", *keys).agg(F.count("*").alias("n"))


def community_summaries(index: DataFrame) -> DataFrame:
    """``topic, community, text``: the descriptions of a community's entities, as its summary."""
    parts = F.array_sort(F.collect_list(F.struct("ord", "id", F.coalesce("description", F.lit("")).alias("d"))))
    g = index.where("community is not null").groupBy("topic", "community").agg(parts.alias("p"))
    return g.select("topic", "community", F.array_join(F.transform("p", lambda x: x.d), " ").alias("text"))


def entity_bonus(index: DataFrame, wanted: DataFrame) -> DataFrame:
    """``qid, topic, community, bonus``: keyword hits in names and one-line descriptions of a community's entities.

    Entities are counted per community and keyword before the questions join, so no row per question and entity exists.
    """
    keys = ["topic", "community"]
    hay = index.where("community is not null").select(*keys, "ord", "id", F.concat_ws(" ", "name", F.coalesce(T.one_line(F.col("description")), F.lit(""))).alias("text"))
    held = keyword_holders(hay, wanted, [*keys, "ord", "id"]).groupBy(*keys, "keyword").agg(F.count("*").alias("n"))
    return held.join(wanted, "keyword").groupBy("qid", *keys).agg(F.sum("n").alias("bonus"))


def candidates(summary_scores: DataFrame, bonus: DataFrame, similarity: DataFrame | None = None, k: int = 15) -> DataFrame:
    """``qid, topic, community, total, place``: the ``k`` best communities of each question.

    The total is keyword hits plus entity hits plus ten times the similarity; a missing part counts nothing.
    """
    keys = ["qid", "topic", "community"]
    total = summary_scores.withColumnRenamed("n", "s").join(bonus.withColumnRenamed("bonus", "b"), keys, "full")
    if similarity is not None:
        total = total.join(similarity.select(*keys, F.col("similarity").alias("v")), keys, "full")
    v = F.coalesce("v", F.lit(0.0)) * 10 if similarity is not None else F.lit(0.0)
    scored = total.select(*keys, F.round(F.coalesce("s", F.lit(0)) + F.coalesce("b", F.lit(0)) + v, 6).alias("total")).where("total > 0")
    place = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("total"), "topic", "community"))
    return scored.withColumn("place", place.cast("long")).where(F.col("place") <= k)


def fallback_candidates(questions: DataFrame, scored: DataFrame, summaries: DataFrame, k: int = 15) -> DataFrame:
    """``qid, topic, community, place``: for questions without any hit, the first ``k`` communities."""
    first = summaries.select("topic", "community").orderBy("topic", "community").limit(k)
    first = first.withColumn("place", F.row_number().over(W.orderBy("topic", "community")).cast("long"))  # at most k rows
    missed = questions.select("qid").distinct().join(scored.select("qid").distinct(), "qid", "left_anti")
    return missed.crossJoin(F.broadcast(first))


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int = 15, block_bytes: int = 64 << 20) -> DataFrame:
    """``qid, vec_id, similarity, place``: for each query vector the ``k`` most similar vectors, itself left out.

    queries: ``qid, vec``; vectors: ``vec_id, vec``; ids are unique.  The stated queries are sent to the batches of
    vectors in passes of at most about ``block_bytes``, so their number is not limited; within a batch one matrix product
    gives the similarities of many queries, and only ``k`` rows (more on ties) per query and batch leave it.  With several
    passes each one's rows are written before the next pass is read.
    """
    size = queries.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("vec")), F.lit(0)).alias("width")).first()
    passes = max(1, -(-size["n"] * max(1, size["width"]) * 8 // block_bytes))
    scratch, out = Scratch(queries.sparkSession, "vectors"), None
    for b in range(passes):
        part = queries if passes == 1 else queries.where(F.pmod(F.xxhash64("qid"), F.lit(passes)) == b)
        rows = part.select("qid", "vec").collect()  # about ``block_bytes``
        near = vectors.where("vec is not null").select("vec_id", "vec").mapInPandas(_nearest(rows, k), "qid long, vec_id long, similarity double")
        near = near if passes == 1 else scratch.write(near, "near")
        out = near if out is None else out.unionByName(near)
    place = F.row_number().over(W.partitionBy("qid").orderBy(F.desc("similarity"), "vec_id"))
    return out.withColumn("place", place.cast("long")).where(F.col("place") <= k)


def _nearest(rows: list, k: int, at_once: int = 512):
    width = max((len(r["vec"]) for r in rows), default=0)
    padded = lambda vs: np.array([[*map(float, v[:width]), *[0.0] * (width - len(v))] for v in vs], np.float64).reshape(len(vs), width)
    ids, matrix = np.array([r["qid"] for r in rows], np.int64), padded([r["vec"] for r in rows])

    def best(batches):
        for pdf in batches:
            other, mine = pdf["vec_id"].to_numpy(np.int64), padded(list(pdf["vec"]))
            for start in range(0, len(ids), at_once):
                some = ids[start : start + at_once]
                similar = np.round(matrix[start : start + at_once] @ mine.T, 6)
                similar[some[:, None] == other[None, :]] = -np.inf
                least = np.partition(similar, -k, axis=1)[:, -k] if similar.shape[1] > k else np.full(len(some), -np.inf)
                q, v = np.nonzero((similar >= least[:, None]) & np.isfinite(similar))
                yield pd.DataFrame({"qid": some[q], "vec_id": other[v], "similarity": similar[q, v]})

    return best
