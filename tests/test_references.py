import datetime as dt
import random

from tessera.operators.references import orphan_references, orphan_report

REL = "rel_id long, topic string, source string, target string, loaded_at timestamp_ntz, key string, state string"
ENT = "topic string, name string, loaded_at timestamp_ntz, deleted_at timestamp_ntz, key string, at string"
DAY = dt.datetime(2024, 1, 1)


def day(n):
    return None if n is None else DAY + dt.timedelta(days=n)


def brute(rels, ents):
    def key(x):
        return " ".join(p for p in x.strip(" ").lower().split(" ") if p)

    out = []
    for rel_id, topic, s, t, at, *_ in rels:
        for end, name in (("source", s), ("target", t)):
            if name is None or not key(name):
                continue
            same = [(a or dt.datetime.min, d) for tp, n, a, d, *_ in ents if (tp or "") == (topic or "") and n is not None and key(n) == key(name)]
            when = at or dt.datetime.max
            loaded = [d for a, d in same if a <= when]
            if not same:
                state = "missing"
            elif not loaded:
                state = "late"
            elif all(d is not None and d <= when for d in loaded):
                state = "deleted"
            else:
                continue
            out.append((rel_id, end, state, at.strftime("%Y-%m") if at else None))
    return sorted(out, key=repr)


def run(spark, rels, ents):
    found = orphan_references(spark.createDataFrame(rels, REL), spark.createDataFrame(ents, ENT))
    assert found.columns == ["rel_id", "endpoint", "state", "period"]
    return sorted(map(tuple, found.collect()), key=repr)


def test_states_and_edge_cases(spark):
    rels = [
        (1, "t", "A  b", " missing ", day(5), "x", "y"),
        (2, "t", "", None, day(5), None, None),
        (3, "t", "late one", "gone", day(5), None, None),
        (4, None, "a B", "null topic", None, None, None),
        (4, None, "a B", "null topic", None, None, None),
        (5, "t", "back", "twice", day(40), None, None),
    ]
    ents = [
        ("t", "a b", day(1), None, None, None),
        ("t", "Late One", day(9), None, None, None),
        ("t", "gone", day(1), day(5), None, None),
        ("", "Null  Topic", None, None, None, None),
        (None, None, day(1), None, None, None),
        ("t", "back", day(1), day(3), None, None),
        ("t", "back", day(30), day(50), None, None),
        ("t", "back", day(60), None, None, None),
        ("t", "twice", day(1), day(20), None, None),
        ("t", "twice", day(2), day(39), None, None),
        ("t", "twice", day(41), None, None, None),
    ]
    assert run(spark, rels, ents) == brute(rels, ents)
    assert run(spark, rels, []) == brute(rels, [])
    assert run(spark, [], ents) == []


def test_random_against_brute_force_with_hot_key(spark):
    rng = random.Random(3)
    names = ["hub"] + [f"n{i}" for i in range(12)]
    pick = lambda: names[0] if rng.random() < 0.4 else rng.choice(names)
    rels = [(i, rng.choice("ab"), pick(), pick().upper(), day(rng.randrange(60)), None, None) for i in range(400)]
    ents = []
    for _ in range(60):
        a = rng.randrange(60)
        ents.append((rng.choice("ab"), rng.choice(names), day(a), rng.choice([None, day(a + rng.randrange(1, 30)), day(a + 2)]), None, None))
    assert run(spark, rels, ents) == brute(rels, ents)


def test_report_counts_all_rows(spark):
    rels = [(i, "t", "x", "y", day(i % 40), None, None) for i in range(100)]
    ents = [("t", "x", day(0), None, None, None)]
    report = orphan_report(spark.createDataFrame(rels, REL), spark.createDataFrame(ents, ENT)).collect()
    assert sum(r["n_refs"] for r in report) == 100 and {r["state"] for r in report} == {"missing"}
