"""Best representative of each group of duplicate records, field by field.

Groups are the live rows of one topic and name.  Descriptions that are empty, stand-ins, cut off or about something else
are set aside by expressions in the JVM; then there are two ways to choose.

* ``elected_descriptions``: token-level consensus.  The different texts of a group are aligned token by token (progressive
  alignment, the heaviest first), each column is decided by a weighted vote, and the existing text closest to that
  consensus is emitted.  A text weighs the sum over its rows of trust, recency and completeness.
* ``surviving_records``: priority decides (trust of the extractor, then the latest extraction, then the smallest id).
  That is the same vote with weights of which each exceeds all of lower priority together: such a value wins every
  column it takes part in, so the consensus is that value itself and an arg-min finds it without alignment.  ``type`` is
  decided likewise; ``sources`` are distinct file names of the rows and of the index entries of the same name.

Scale.  Arg-mins combine on the map side.  For the vote, equal texts are counted before anything is collected, and a
group is aligned as a tree: about ``FAN`` texts, chosen by their hash, make a profile, about ``FAN`` profiles make one, and
so on, so no task gets all texts of a large group.  A profile keeps what has at least one part in ``LEAST_SHARE`` of its weight (tokens in a column, columns in the
profile), which bounds its size; groups of up to ``FAN`` texts lose nothing.  Distances to the consensus are computed per
text, spread over all tasks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.names import same_name
from tessera.session import Scratch

#: Texts, or profiles of texts, that one step of an alignment takes.
FAN = 32
#: Parts of a profile with less than this share of its weight are let go when profiles are passed on.
LEAST_SHARE = 64
GROUP = ["topic", "key"]
PROFILES = "first_id long, part long, profile string, weight double"

# Rules that may be tuned: texts that stand for a missing description, as patterns over trimmed lower-case text.
STAND_INS = (
    r"^\W*(n/?a|none|null|nil|nan|unknown|undefined|tbd|tba|todo|missing|empty|pending|placeholder)?\W*$"
    r"|^<.*>$|^[\{\[].*"
    r"|^(i'm sorry|i am sorry|sorry|i cannot|i can't|as an ai|as requested|here is|here's|sure|certainly|unable to|cannot|could not|it is not possible)\b"
    r"|^(no|not|without)\b.{0,40}\b(descri\w+|information|details?|context|data|text|source|available|provided|specified|given|mentioned|found)\b"
    r"|^(the )?(text|passage|document|source|article|context)\b.{0,40}\b(gives|does not|doesn't|says|contains|provides|offers|has) .{0,20}\b(no|not|nothing|further|enough)\b"
    r"|^(a |the |one |some )?(brief|short|concise|one[- ]sentence)\b.{0,30}\b(description|sentence|summary|explanation)\b.*\b(entity|role|named|above)\b"
    r"|^one of the allowed\b"
    r"|^(description|summary|text|details)\b.{0,20}\b(to be|will be|pending|goes here|here|follows|missing|unavailable)\b"
)
# Likewise: what a sentence about an entity goes on with after its subject.
VERBS = "is|are|was|were|has|had|describes|sets|sells|ran|runs|maintains|wrote|leads|led|presented|supplies|advises|links|measures|covers|provides|offers|reports|joined|publishes|reviews"


def usable_description(description: Column, name: Column) -> Column:
    """Is this a finished text about the entity of this name?"""
    d = F.trim(F.regexp_replace(description, r"\s+", " "))
    low, key = F.lower(d), same_name(name)
    rest = F.regexp_replace(F.replace(low, key, F.lit("")), r"^\W*\(\w[\w /]*\)\W*$", "")
    stand_in = low.rlike(STAND_INS) | ~rest.rlike(r"\p{L}")
    finished = d.rlike(r"[.!?][\"'»”’)\]]?$") & ~d.rlike(r"(\.\.\.+|…|\[[.… ]*\])[\"'»”’)\]]?$")
    # A subject in the form of a name that is not this name: "Other Name was introduced ..."
    subject = F.lower(F.regexp_extract(d, rf"^(.{{1,90}}?) (?:{VERBS})\b", 1))
    opens = F.regexp_extract(d, r"^(\S+)", 1)
    named = subject.rlike(r"\S") & opens.rlike(r"^[\p{Lu}\p{N}]|^\p{L}*[\p{Lu}\p{N}]|^\p{Ll}+[-\p{Ll}]*$") & ~F.lower(opens).isin("a", "an", "the", "it", "its", "this", "links", "one", "used") & ~subject.rlike(r"\. (it|its|the|they|their|several|some|this|these)( |$)")
    words = F.array_distinct(F.filter(F.split(F.regexp_replace(subject, r"[^\p{L}\p{N}]+", " "), " "), lambda x: x != ""))
    own = F.split(F.regexp_replace(key, r"[^\p{L}\p{N}]+", " "), " ")
    shared = F.size(F.array_intersect(words, own)) * 2 >= F.size(words)
    others = named & ~low.startswith(key) & ~shared & ~(F.levenshtein(subject, key) * 3 <= F.length(key))
    return F.coalesce(~stand_in & finished & ~others, F.lit(False))


Profile = list[dict[str, float]]  # columns with the weight of each token; "" is a gap


def align(left: Profile, right: Profile, left_weight: float, right_weight: float) -> Profile:
    """Two profiles aligned to one: of all ways to pair columns in order, the one with the greatest product of agreeing weights."""
    n, m = len(left), len(right)
    score = [[0.0] * (m + 1) for _ in range(n + 1)]
    gain = [[0.0] * m for _ in range(n)]
    places: dict[str, list[tuple[int, float]]] = {}
    for j, column in enumerate(right):
        for t, w in column.items():
            if t:
                places.setdefault(t, []).append((j, w))
    for own, column in zip(gain, left):  # only cells whose columns share a token gain anything
        for t, w in column.items():
            for j, other in places.get(t, ()):
                own[j] += w * other
    for i in range(n - 1, -1, -1):
        row, below, own = score[i], score[i + 1], gain[i]
        for j in range(m - 1, -1, -1):
            row[j] = max(below[j + 1] + own[j], below[j], row[j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and gain[i][j] > 0 and score[i][j] == score[i + 1][j + 1] + gain[i][j]:
            out.append({t: left[i].get(t, 0.0) + right[j].get(t, 0.0) for t in {**left[i], **right[j]}})
            i, j = i + 1, j + 1
        elif i < n and (j == m or score[i][j] == score[i + 1][j]):
            out.append({**left[i], "": left[i].get("", 0.0) + right_weight})
            i += 1
        else:
            out.append({**right[j], "": right[j].get("", 0.0) + left_weight})
            j += 1
    return out


def joined_profile(parts: list[tuple[Profile, float]]) -> tuple[Profile, float]:
    """Progressive alignment in the given order."""
    profile, total = parts[0]
    for other, weight in parts[1:]:
        profile, total = align(profile, other, total, weight), total + weight
    return profile, total


def text_profile(text: str, weight: float) -> tuple[Profile, float]:
    return [{t: weight} for t in text.split()], weight


def winners(profile: Profile) -> list[str]:
    """The tokens that win the vote of their columns; the smaller token on ties, a token before a gap."""
    won = (min(column.items(), key=lambda x: (-x[1], x[0] == "", x[0]))[0] for column in profile)
    return [t for t in won if t]


def consensus(values: list[tuple[str, float]]) -> list[str]:
    """The consensus of weighted texts, heaviest first."""
    return winners(joined_profile([text_profile(v, w) for v, w in values])[0])


def token_distance(a: list[str], b: list[str]) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


def _thinned(profile: Profile, total: float) -> Profile:
    """A profile without the columns and tokens that hardly any weight stands for."""
    least = total / LEAST_SHARE
    kept = ({t: w for t, w in column.items() if t == "" or w >= least} for column in profile if sum(w for t, w in column.items() if t) >= least)
    return [column for column in kept if len(column) > ("" in column)]


def _profiles_of_texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        made = []
        for values in batch["values"]:
            ordered = sorted(((v["text"], v["weight"]) for v in values), key=lambda x: (-x[1], x[0]))
            made.append(joined_profile([text_profile(t, w) for t, w in ordered]))
        yield _as_rows(batch, made)


def _profiles_of_profiles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        made = []
        for parts in batch["values"]:
            ordered = sorted(((p["weight"], p["profile"]) for p in parts), key=lambda x: (-x[0], x[1]))
            made.append(joined_profile([(_thinned(json.loads(text), weight), weight) for weight, text in ordered]))
        yield _as_rows(batch, made)


def _as_rows(batch: pd.DataFrame, made: list[tuple[Profile, float]]) -> pd.DataFrame:
    return pd.DataFrame({"first_id": batch["first_id"], "part": batch["part"], "profile": [json.dumps(p, sort_keys=True) for p, _ in made], "weight": [w for _, w in made]})


def _distances(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        voted = [winners(json.loads(p)) for p in batch["profile"]]
        yield batch[["first_id", "ent_id", "weight"]].assign(distance=[token_distance(t.split(), v) for t, v in zip(batch["text"], voted)])


def elected_descriptions(entities: DataFrame, extractors: DataFrame) -> DataFrame:
    """``first_id, ent_id, n_texts, distance``: of each group of two or more live rows the row whose description is closest to the consensus.

    A row weighs (1 + trust) times its recency (1 for the latest of its group, a half after a year, and so on) times its completeness
    (a half to 1, reached at 20 words); equal texts add up.  Ties of the distance go to the heavier text, then to the smallest id; the
    row of a text is its first one by id.  The edge cases are those of ``surviving_records``.
    """
    scratch = Scratch(entities.sparkSession, "elected")
    trust = F.broadcast(extractors.groupBy("extractor").agg(F.max("trust").alias("trust")))  # a table of a few fixed rows
    live = _live(entities)
    groups = live.groupBy(*GROUP).agg(F.min("ent_id").alias("first_id"), F.count("*").alias("n"), F.max(F.unix_micros(F.col("extracted_at").cast("timestamp"))).alias("latest")).where("n > 1").drop("n")
    good = live.where(usable_description(F.col("description"), F.col("name"))).join(trust, "extractor", "left").join(groups, GROUP)
    text = F.trim(F.regexp_replace("description", r"\s+", " "))
    years = F.coalesce((F.col("latest") - F.unix_micros(F.col("extracted_at").cast("timestamp"))) / (365.25 * 86_400e6), F.lit(10.0))
    completeness = 0.5 + 0.5 * F.least(F.lit(1.0), F.size(F.split(text, " ")) / 20)
    weight = (1 + F.greatest(F.coalesce("trust", F.lit(0)), F.lit(0))) / (1 + years) * completeness
    texts = good.groupBy("first_id", text.alias("text")).agg(F.round(F.sum(weight), 9).alias("weight"), F.min("ent_id").alias("ent_id"))
    texts = scratch.write(texts, "texts")
    counts = scratch.write(texts.groupBy("first_id").agg(F.count("*").alias("n_texts")), "counts")
    step = texts.join(counts, "first_id").withColumn("part", F.pmod(F.xxhash64("text"), F.ceil(F.col("n_texts") / FAN)))
    step = step.groupBy("first_id", "part").agg(F.collect_list(F.struct("text", "weight")).alias("values")).mapInPandas(_profiles_of_texts, PROFILES)
    level = 0
    while True:
        profiles = scratch.write(step, "profiles")
        left = profiles.groupBy("first_id").agg(F.count("*").alias("n_parts"))
        if left.where("n_parts > 1").isEmpty():
            break
        level += 1
        parts = profiles.join(left, "first_id").withColumn("part", F.pmod(F.xxhash64("part", F.lit(level)), F.ceil(F.col("n_parts") / FAN)))
        step = parts.groupBy("first_id", "part").agg(F.collect_list(F.struct("profile", "weight")).alias("values")).mapInPandas(_profiles_of_profiles, PROFILES)
    near = texts.join(profiles.select("first_id", "profile"), "first_id").select("first_id", "ent_id", "weight", "text", "profile").mapInPandas(_distances, "first_id long, ent_id long, weight double, distance int")
    best = near.groupBy("first_id").agg(F.min_by(F.struct("ent_id", "distance"), F.struct("distance", (-F.col("weight")).alias("w"), "ent_id")).alias("b"))
    return best.join(counts, "first_id").select("first_id", "b.ent_id", "n_texts", "b.distance")


def _live(entities: DataFrame) -> DataFrame:
    live = entities.where("deleted_at is null").select("ent_id", F.coalesce("topic", F.lit("")).alias("topic"), same_name(F.col("name")).alias("key"), "name", "type", "description", "filename", "extractor", "extracted_at")
    return live.where("key <> ''")


def surviving_records(entities: DataFrame, extractors: DataFrame, terms: DataFrame, index: DataFrame) -> DataFrame:
    """``first_id, field, value`` of each group of two or more live rows of the same topic and name.

    entities: ``ent_id, topic, name, type, description, filename, extractor, extracted_at, deleted_at``; extractors: ``extractor,
    trust``; terms: ``kind, term``; index: ``topic, name, sources``; further columns are ignored.  ``value`` is the id of the row whose
    description survives, the surviving type in upper case, or one file name per row.

    Defined edge cases: rows with a null or blank name belong to no group; a null topic is the same as the empty one; an
    unknown or null extractor is the least trusted; a null ``extracted_at`` is the earliest; repeated rows count as rows;
    a group without a usable value has no row for that field; empty tables give no rows (without terms there are no types).
    """
    trust = F.broadcast(extractors.groupBy("extractor").agg(F.max("trust").alias("trust")))  # a table of a few fixed rows
    types = F.broadcast(terms.where("kind = 'entity_type'").select(F.upper(F.trim("term")).alias("known")).distinct())  # likewise
    live = _live(entities)
    order = F.struct(-F.coalesce("trust", F.lit(-2_000_000_000)), -F.coalesce(F.unix_micros(F.col("extracted_at").cast("timestamp")), F.lit(-(2**62))), F.col("ent_id"))
    rows = live.join(trust, "extractor", "left").join(types, F.upper(F.trim("type")) == F.col("known"), "left").withColumn("order", order)
    groups = live.groupBy(*GROUP).agg(F.min("ent_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")

    best_type = rows.where("known is not null").groupBy(*GROUP).agg(F.min_by("known", "order").alias("value"))
    type_rows = groups.join(best_type, GROUP).select("first_id", F.lit("type").alias("field"), "value")

    good = rows.where(usable_description(F.col("description"), F.col("name"))).groupBy(*GROUP).agg(F.min_by("ent_id", "order").alias("best"))
    description_rows = groups.join(good, GROUP).select("first_id", F.lit("description").alias("field"), F.col("best").cast("string").alias("value"))

    files = live.select(*GROUP, F.col("filename").alias("file"))
    listed = index.select(F.coalesce("topic", F.lit("")).alias("topic"), same_name(F.col("name")).alias("key"), F.explode("sources").alias("file")).where("key <> ''")
    base = F.trim(F.regexp_extract("file", r"([^/\\]*)\s*$", 1))
    names = files.unionByName(listed).select(*GROUP, base.alias("value")).where("value <> ''").distinct()
    source_rows = groups.join(names, GROUP).select("first_id", F.lit("sources").alias("field"), "value")
    return description_rows.unionByName(type_rows).unionByName(source_rows)
