import datetime as dt
import random

from pyspark.sql import functions as F

from tessera.llm import survivors as S

ENT = "ent_id long, topic string, name string, type string, description string, filename string, extractor string, extracted_at timestamp_ntz, deleted_at timestamp_ntz, trust int, value string"


def at(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def run(spark, rows, index=()):
    ents = spark.createDataFrame([(*r, None, None) for r in rows], ENT)
    ext = spark.createDataFrame([("curated", 4), ("auto", 1)], "extractor string, trust int")
    terms = spark.createDataFrame([("entity_type", "PERSON"), ("entity_type", "Concept"), ("relation_type", "ORG")], "kind string, term string")
    idx = spark.createDataFrame(list(index), "topic string, name string, sources array<string>")
    return {(r["first_id"], r["field"], r["value"]) for r in S.surviving_records(ents, ext, terms, idx).collect()}


def test_fields(spark):
    rows = [
        (5, "t", "Ann  Lee", "person ", "Ann Lee leads the work.", "raw/a.md", "auto", at(1), None),
        (6, "t", "ann lee", "ORG", "Ann Lee leads the wo…", " b.md", "curated", at(2), None),
        (7, "t", "Ann Lee", "CONCEPT", "Ann Lee wrote a guide.", None, "curated", at(3), None),
        (8, "t", "Ann Lee", "CONCEPT", "Ann Lee wrote a guide.", "c.md", "curated", at(3), None),
        (9, "t", "Ann Lee", "PERSON", "Bob Ray is mentioned next to ads.", "d.md", "curated", at(9), None),
        (4, "t", "Ann Lee", "PERSON", "Ann Lee was first.", "e.md", "curated", at(9), at(10)),
        (1, "t", "Solo", "PERSON", "Solo is alone.", "f.md", "auto", at(1), None),
    ]
    got = run(spark, rows, [("t", "ANN LEE", ["x/y.md", "a.md", None, " "]), ("t", "Solo", ["z.md"])])
    assert got == {(5, "description", "7"), (5, "type", "PERSON"), *((5, "sources", f) for f in ("a.md", "b.md", "c.md", "d.md", "y.md"))}


def test_usable_descriptions(spark):
    good = ["A planner for radio.", "Regional agency.", "Regional agency. Its estimate is considered steep.", "Ann Lee and Bob Ray share one panel.", "Links radio with sales."]
    bad = [None, "", " ", "n/a", "TBD", "-", "?", "Ann Lee", "ANN LEE (PERSON)", "Ann Lee Ann Lee Ann Lee", "<description>", '{"name": "Ann Lee", "description": ', "No description available.", "Not described in the text.", "I'm sorry, but I cannot.", "Ann Lee leads the", "Ann Lee leads...", "Ann Lee leads […]", "Halo Index was introduced in May.", "Regional Halo Index is mentioned next to radio."]
    df = spark.createDataFrame([(d, i) for i, d in enumerate(good + bad)], "d string, i int").orderBy("i")
    got = [r[0] for r in df.select(S.usable_description(F.col("d"), F.lit("Ann  Lee"))).collect()]
    assert got == [True] * len(good) + [False] * len(bad)


def by_weight(values):
    return sorted(values, key=lambda x: (-x[1], x[0]))


def closest(values, ids=None):
    voted = S.consensus(by_weight(values))
    return min(by_weight(values), key=lambda v: (S.token_distance(v[0].split(), voted), -v[1], ids[v[0]] if ids else 0))[0]


def test_consensus_is_a_vote():
    assert S.consensus([("a b c d", 2.0), ("a x c d", 1.5), ("a x c", 1.0)]) == ["a", "x", "c", "d"]
    assert closest([("a b c d", 2.0), ("a x c d", 1.5), ("a x c", 1.0)]) == "a x c d"  # not the heaviest one
    assert S.consensus([("one", 1.0)]) == ["one"]


def test_a_value_that_outweighs_all_others_is_the_consensus():
    """Why priority needs no alignment: with such weights the vote gives the first value, whatever the others are."""
    rng = random.Random(4)
    for _ in range(300):
        values = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 6))]
        assert S.consensus([(v, 2.0**-n) for n, v in enumerate(values)]) == values[0].split()


def vote(spark, rows):
    ents = spark.createDataFrame([(*r, None, None) for r in rows], ENT)
    ext = spark.createDataFrame([("curated", 4), ("auto", 1), ("raw", 0)], "extractor string, trust int")
    return {r["first_id"]: r for r in S.elected_descriptions(ents, ext).collect()}


def test_election_against_brute_force(spark):
    rng, rows, want, n = random.Random(7), [], {}, 0
    for g in range(25):
        base = ["It", "leads", "the", rng.choice(["work", "plan"]), "in", rng.choice(["Rome", "Lyon", "Bern"])]
        votes, first, ids = {}, n, {}
        for _ in range(rng.randint(2, 9)):
            tokens = base[:2] + [t if rng.random() < 0.7 else rng.choice(["old", "new", "big"]) for t in base[2:]]
            text, extractor = f"{' '.join(tokens)}.", rng.choice(["curated", "auto", "raw"])
            rows.append((n, "t", f"G{g}", "CONCEPT", text, None, extractor, at(5), None))
            votes[text] = votes.get(text, 0) + {"curated": 5, "auto": 2, "raw": 1}[extractor] * (0.5 + 0.5 * 6 / 20)
            ids.setdefault(text, n)
            n += 1
        want[first] = (ids, votes)
    usable = {r["ent_id"] for r in spark.createDataFrame([(*r, None, None) for r in rows], ENT).where(S.usable_description(F.col("description"), F.col("name"))).collect()}
    assert len(usable) > 60
    for first, r in vote(spark, rows).items():
        ids, votes = want[first]
        ok = {t: w for t, w in votes.items() if any(x[0] in usable and x[4] == t and x[2] == rows[first][2] for x in rows)}
        assert r["n_texts"] == len(ok) and r["ent_id"] == ids[closest([(t, round(w, 9)) for t, w in ok.items()], ids)]


def test_a_large_group_is_voted_as_a_tree(spark):
    """The majority wins although the most trusted, latest row says something else; 401 texts make more than one level."""
    rows = [(i, "t", "Hub", None, f"Hub leads panel number {i} in Rome.", None, "auto", at(1), None) for i in range(400)]
    rows += [(400, "t", "Hub", None, "Hub sells cars in the far north.", None, "curated", at(9), None), (401, "t", "Hub", None, "", None, "auto", None, None), (402, None, "Hub", None, "Hub leads.", None, None, None, None)]
    got = vote(spark, rows)
    assert set(got) == {0} and got[0]["n_texts"] == 401 and got[0]["ent_id"] < 400 and got[0]["distance"] == 1
    assert vote(spark, []) == {}


def test_hot_group_and_edges(spark):
    rows = [(i, "t", "Hub", "CONCEPT" if i % 2 else None, f"Hub describes case {i}." if i % 3 else "", f"f{i % 7}.md", "auto" if i % 5 else None, at(i % 11) if i % 4 else None, None) for i in range(600)]
    rows += [(1000, None, "Hub", "PERSON", None, None, None, None, None), (1001, "", "hub", "x", "Text.", None, "new", None, None), (1002, "t", None, "PERSON", "Text.", None, None, None, None), (1003, "t", " ", "PERSON", "Text.", None, None, None, None)]
    got = run(spark, rows)
    best = min((r for r in rows[:600] if r[4]), key=lambda r: (-1 if r[6] else 2, -(r[7] or dt.datetime.min).timestamp() if r[7] else 9e9, r[0]))
    assert (0, "description", str(best[0])) in got and (0, "type", "CONCEPT") in got and len([g for g in got if g[1] == "sources"]) == 7
    assert {g for g in got if g[0] == 1000} == {(1000, "type", "PERSON"), (1000, "description", "1001")}
    assert run(spark, []) == set()
