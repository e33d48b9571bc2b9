"""Variant spellings of names typed by people: which strings of a topic denote the same person or organisation.

Plan.  (1) Distinct strings are parsed into forms (given name and surname, organisation words without the legal
form, and so on); strings of one form, such as copies, need no search.  Strings that differ only in case or spaces
are parsed once, from their most informative spelling, and so are always of one form.  (2) Forms are
looked up by MinHash banding over padded 2-grams; rows per band and bands are chosen from the collision
curve so that pairs at the similarity of typical variants are met with the wanted probability.
(3) Candidates are verified by Monge–Elkan similarity of their words.  (4) Star clustering groups the
forms: the vertex of highest degree takes its neighbours, the rest goes on.  (5) Short forms (initials, one
word, acronyms) join a cluster only if exactly one fits.  (6) Strings of a cluster are paired.

Scale.  Everything is keyed by topic and form or band, so a topic that holds a third of all rows spreads
over all tasks; no group of a topic or bucket is collected.  Pairs leave a bucket by a shuffled join, whose
sides adaptive execution may split; the join is on distinct forms, not on rows.  Only counts reach the driver.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.name_forms import Form, blocking_sets, parse, same_entity
from tessera.session import Scratch

# Rules that may be tuned: how entity types are counted as votes for a person or an organisation, or against both.
PERSON_TYPES = ("PERSON", "HUMAN", "PEOPLE")
ORG_TYPES = ("ORGANIZATION", "ORGANISATION", "ORG", "COMPANY", "INSTITUTION")
OPEN_TYPES = ("OTHER", "ENTITY", "N/A", "NONE", "UNKNOWN", "")

FORMS = "topic string, folded string, weight long, kind string, form string, ordered string, person_votes long, org_votes long, other_votes long"
FORM = ["topic", "form"]
_P = np.uint64((1 << 31) - 1)


def banding(recall: float, similarity: float, background: float, strangers: int = 100, most: int = 160) -> tuple[int, int]:
    """``(rows, bands)`` with at least ``recall`` at ``similarity``, and the least work: one row a band, and a candidate
    for each of ``strangers`` forms of ``background`` similarity that is met.

    The collision curve of r rows and b bands is 1 - (1 - s**r)**b.
    """
    best = None
    for rows in range(1, 9):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))
        if rows * bands <= most:
            work = bands + strangers * (1 - (1 - background**rows) ** bands)
            if best is None or work < best[0]:
                best = (work, rows, bands)
    if best is None:
        raise ValueError("no banding reaches this recall")
    return best[1], best[2]


_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D, 0x9FB21C651E98DF25], np.uint64)


def band_keys(grams: list[str], rows: int, bands: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number per band: equal where all minima of the band are."""
    h = np.array([zlib.crc32(g.encode()) for g in set(grams)], np.uint64) % _P
    low = ((h[:, None] * a[None, :] + b[None, :]) % _P).min(axis=0).reshape(bands, rows)
    return (low * _MIX[:rows]).sum(axis=1, dtype=np.uint64) * _MIX[7] + np.arange(bands, dtype=np.uint64)


def _bander(rows: int, bands: int, seed: int):
    def band(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng = np.random.default_rng(seed)
        a = rng.integers(1, 1 << 31, rows * bands, dtype=np.uint64) % _P
        b = rng.integers(0, 1 << 31, rows * bands, dtype=np.uint64) % _P
        known: dict[tuple, np.ndarray] = {}  # words recur from topic to topic
        for batch in batches:
            ns, buckets = [], []
            for n, topic, form, ordered in zip(batch["n"], batch["topic"], batch["form"], batch["ordered"]):
                for view, grams, exact in blocking_sets(_form(form, ordered)):
                    kept = (exact, *grams)
                    if kept not in known:
                        if len(known) >= 100_000:
                            known.clear()
                        known[kept] = np.array([zlib.crc32(g.encode()) for g in grams], np.uint64) if exact else band_keys(grams, rows, bands, a, b)
                    place = np.uint64(int.from_bytes(hashlib.blake2b(f"{view}|{topic}".encode(), digest_size=8).digest(), "big"))
                    ns.append(n)
                    buckets.append(((known[kept] ^ place) * _MIX[0]).view(np.int64))
            yield pd.DataFrame({"n": np.array(ns, np.int64), "buckets": pd.Series(buckets, dtype=object)})

    return band


def _form(form: str, ordered: str) -> Form:
    return Form(form.split("|", 1)[0], tuple(ordered.split(" ")))


def _best_form(spellings: list[str | None], votes: tuple[int, int, int]) -> Form:
    """The form of the first spelling that is a name at all."""
    forms = (parse(n, *votes) for n in spellings if n is not None)
    form = next(forms)
    return form if form.kind != "other" else next((f for f in forms if f.kind != "other"), form)


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        spellings = zip(batch["mixed"], batch["capitals"], batch["small"])
        votes = zip(batch["person_votes"], batch["org_votes"], batch["other_votes"])
        forms = [_best_form(list(n), tuple(map(int, v))) for n, v in zip(spellings, votes)]
        yield batch.assign(kind=[f.kind for f in forms], form=[f.key for f in forms], ordered=[" ".join(f.words) for f in forms])[[c.split()[0] for c in FORMS.split(", ")]]


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for topic, fa, oa, fb, ob in zip(batch["topic"], batch["form_a"], batch["ordered_a"], batch["form_b"], batch["ordered_b"]):
            a, b = _form(fa, oa), _form(fb, ob)
            score, weak = same_entity(a, b)
            if score > 0:
                if weak and (a.kind == "person" or a.kind == "org" and (b.kind != "org" or any(len(w) == 1 for w in b.words))):
                    fa, fb = fb, fa  # the short form comes first
                out.append((topic, fa, fb, round(score, 6), weak))
        yield pd.DataFrame(out, columns=["topic", "form_a", "form_b", "score", "weak"])


def name_strings(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """``topic, name`` and votes of each distinct string: entity names as stored, ontology aliases trimmed."""
    kind = F.coalesce(F.upper(F.trim("type")), F.lit(""))
    votes = {
        "person_votes": F.sum(kind.isin(*PERSON_TYPES).cast("long")),
        "org_votes": F.sum(kind.isin(*ORG_TYPES).cast("long")),
        "other_votes": F.sum((~kind.isin(*PERSON_TYPES, *ORG_TYPES, *OPEN_TYPES)).cast("long")),
    }
    topic = F.coalesce("topic", F.lit("")).alias("topic")
    stored = entities.select(topic, "name", "type").groupBy("topic", "name").agg(*[v.alias(k) for k, v in votes.items()])
    listed = (
        aliases.where("origin = 'ontology'").select(topic, F.explode(F.array(F.trim("alias"), F.trim("canonical"))).alias("name")).distinct()
        .select("topic", "name", *[F.lit(0).cast("long").alias(k) for k in votes])
    )
    both = stored.unionByName(listed).where("trim(name) <> ''")
    return both.groupBy("topic", "name").agg(*[F.sum(k).alias(k) for k in votes])


def spaced(name: str) -> Column:
    """A string without outer spaces and with single inner ones."""
    return F.trim(F.regexp_replace(name, r"(?U)\s+", " "))


def spellings(strings: DataFrame) -> DataFrame:
    """``topic, folded`` with the number and the votes of the strings that differ only in case and spaces, and their
    first spelling in mixed case, in capitals and in small letters, from the most to the least informative.
    """
    s = spaced("name")
    style = F.when(F.upper(s) == s, "capitals").when(F.lower(s) == s, "small").otherwise("mixed")
    first = [F.min(F.when(style == x, s)).alias(x) for x in ("mixed", "capitals", "small")]
    return strings.groupBy("topic", "folded").agg(F.count("*").alias("weight"), *first, *[F.sum(v).alias(v) for v in ("person_votes", "org_votes", "other_votes")])


def clustered_names(entities: DataFrame, aliases: DataFrame, recall: float = 0.99, similarity: float = 0.42, background: float = 0.2, seed: int = 7) -> DataFrame:
    """``topic, name, cluster``: the strings that are persons or organisations, with their cluster.

    entities: ``topic, name, type``; aliases: ``topic, alias, canonical, origin``; further columns are ignored.

    Defined edge cases: null and blank names are no strings; a null topic is the same as the empty one; repeated rows only
    add votes; ties of star centers go to the greater weight, then to the greater form; empty tables give no rows.
    """
    spark = entities.sparkSession
    scratch = Scratch(spark, "names")
    strings = scratch.write(name_strings(entities, aliases).withColumn("folded", F.lower(F.upper(spaced("name")))), "strings")
    parsed = scratch.write(spellings(strings).mapInPandas(_parse, FORMS).where("kind <> 'other'"), "parsed")
    votes = ["person_votes", "org_votes", "other_votes"]
    forms = parsed.groupBy("topic", "form", "kind").agg(F.min("ordered").alias("ordered"), F.sum("weight").alias("weight"), *[F.sum(v).alias(v) for v in votes])
    forms = scratch.write(forms.withColumn("n", F.monotonically_increasing_id()), "forms")  # numbered once, as written

    # Only two numbers a band are shuffled; the bucket is a hash of topic, view, band and minima.  The join is told not to broadcast: bands are many times the size of
    # the forms, by which their size would be estimated.
    rows, bands = banding(recall, similarity, background)
    banded = forms.select("n", "topic", "form", "ordered").mapInPandas(_bander(rows, bands, seed), "n long, buckets array<long>").select("n", F.explode("buckets").alias("bucket"))
    left, right = (banded.select("bucket", F.col("n").alias(x)).hint("merge") for x in ("n_a", "n_b"))
    met = left.join(right, "bucket").where("n_a < n_b").select("n_a", "n_b").distinct()
    a, b = (forms.select("topic", F.col("n").alias(f"n_{x}"), F.col("form").alias(f"form_{x}"), F.col("ordered").alias(f"ordered_{x}")) for x in "ab")
    met = met.join(a, "n_a").join(b, ["n_b", "topic"]).select("topic", "form_a", "ordered_a", "form_b", "ordered_b")
    edges = scratch.write(met.mapInPandas(_verify, "topic string, form_a string, form_b string, score double, weak boolean"), "edges")

    stars = star_clusters(scratch, forms.select("topic", "form", "weight"), edges.where("not weak").drop("weak"))
    # Short forms: their whole cluster joins the only cluster of full forms that fits any of them.
    short = stars.select("topic", F.col("form").alias("form_a"), F.col("center").alias("short_center"))
    full = stars.select("topic", F.col("form").alias("form_b"), F.col("center").alias("full_center"))
    fits = edges.where("weak").join(short, ["topic", "form_a"]).join(full, ["topic", "form_b"])
    only = fits.groupBy("topic", "short_center").agg(F.min("full_center").alias("target"), F.max("full_center").alias("other")).where("target = other")
    merged = stars.join(only.select("topic", F.col("short_center").alias("center"), "target"), ["topic", "center"], "left")
    merged = merged.select("topic", "form", F.coalesce("target", "center").alias("cluster"))

    members = merged.join(forms, FORM)
    person = F.col("kind").isin("person", "initial")
    counts = members.groupBy("topic", "cluster").agg(F.max(person.cast("int")).alias("person"), F.max(F.col("kind").isin("org", "acronym").cast("int")).alias("org"), *[F.sum(v).alias(v) for v in votes])
    named = counts.where((F.col("person") == 1) | (F.col("other_votes") <= 2 * (F.col("person_votes") + F.col("org_votes")) + 2 * F.col("org")))  # forms by votes alone passed a stricter bound
    kept = merged.join(named.select("topic", "cluster"), ["topic", "cluster"])
    placed = parsed.select("topic", "folded", "form").join(kept, FORM)
    return strings.join(placed, ["topic", "folded"]).select("topic", "name", "cluster")


def star_clusters(scratch: Scratch, vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """``topic, form, center``: each vertex with its star.

    vertices: ``topic, form, weight``; edges: ``topic, form_a, form_b, score``.  In each round every vertex
    whose degree, then weight, then form is greater than that of all its remaining neighbours becomes a center
    and takes those of them for which it is the most similar center.
    """
    both = edges.unionByName(edges.select("topic", F.col("form_b").alias("form_a"), F.col("form_a").alias("form_b"), "score"))
    degree = both.groupBy("topic", F.col("form_a").alias("form")).agg(F.count("*").alias("degree"))
    rank = degree.join(vertices, FORM).select("topic", "form", F.struct("degree", "weight", "form").alias("rank"))
    rank_a = rank.select("topic", F.col("form").alias("form_a"), F.col("rank").alias("rank_a"))
    rank_b = rank.select("topic", F.col("form").alias("form_b"), F.col("rank").alias("rank_b"))
    active = scratch.write(both.join(rank_a, ["topic", "form_a"]).join(rank_b, ["topic", "form_b"]), "active")
    stars, old = None, None
    while not active.isEmpty():
        centers = active.groupBy("topic", "form_a", "rank_a").agg(F.max("rank_b").alias("greatest")).where(F.col("rank_a") > F.col("greatest")).select("topic", F.col("form_a").alias("center"))
        taken = active.join(centers.select("topic", F.col("center").alias("form_b")), ["topic", "form_b"])
        taken = taken.groupBy("topic", F.col("form_a").alias("form")).agg(F.max_by("form_b", F.struct("score", "rank_b")).alias("center"))
        done = scratch.write(taken.unionByName(centers.select("topic", F.col("center").alias("form"), "center")), "stars")
        stars = done if stars is None else stars.unionByName(done)
        gone = done.select("topic", "form")
        rest = active.join(gone.withColumnRenamed("form", "form_a"), ["topic", "form_a"], "left_anti").join(gone.withColumnRenamed("form", "form_b"), ["topic", "form_b"], "left_anti")
        previous, active = old, scratch.write(rest.select(active.columns), "active")
        if previous:
            scratch.drop(previous)
        old = scratch.last
    single = vertices.select("topic", "form")
    if stars is None:
        return single.withColumn("center", F.col("form"))
    return stars.unionByName(single.join(stars.select("topic", "form"), FORM, "left_anti").withColumn("center", F.col("form")))


def linked_names(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """``topic, name_a, name_b``: pairs of different strings of one cluster, the smaller first."""
    names = Scratch(entities.sparkSession, "clusters").write(clustered_names(entities, aliases))
    a = names.select("topic", "cluster", F.col("name").alias("name_a"))
    b = names.select("topic", "cluster", F.col("name").alias("name_b"))
    return a.join(b, ["topic", "cluster"]).where("name_a < name_b").select("topic", "name_a", "name_b")
