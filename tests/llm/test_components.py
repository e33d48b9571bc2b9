import random

import pytest

from tessera.llm import components
from tessera.llm.components import connected_groups

PAIR = "topic string, alias string, canonical string, name string, a string"


def brute(rows):
    parent = {}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for t, a, b, *_ in rows:
        t, sides = t or "", [(x or "").strip(" ") for x in (a, b)]
        for s in sides:
            if s:
                parent.setdefault((t, s), (t, s))
        if all(sides):
            p, q = root((t, sides[0])), root((t, sides[1]))
            if p != q:
                parent[max(p, q)] = min(p, q)
    return {(t, n, root((t, n))[1]) for t, n in parent}


def run(spark, rows, **options):
    got = connected_groups(spark.createDataFrame([(*r, "x", "y") for r in rows], PAIR), **options).collect()
    assert len(got) == len(set(got))
    return {tuple(r) for r in got}


def test_dirt(spark):
    rows = [("t", " A ", "B"), ("t", "b", "B"), ("t", "C", None), ("t", "", "D"), ("t", None, None), ("t", "E", "E"), (None, "A", "Z"), ("", "Z", "Y"), ("t", "B", "A"), ("t", "A", "B"), ("u", "A", "Q")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == set()
    assert run(spark, [("t", None, "only")]) == {("t", "only", "only")}


@pytest.mark.parametrize("rounds", [1, 8])
def test_shapes_against_union_find(spark, rounds):
    rng = random.Random(9)
    order = [f"n{i:04}" for i in range(400)]
    rng.shuffle(order)
    rows = [("t", "hub", n) for n in order[:150]] + [("t", a, b) for a, b in zip(order[140:200], order[141:201])]  # star with a tail longer than the search
    rows += [("t", a, b) for a, b in zip(order[210:260], order[211:261])] + [("t", order[260], order[300]), ("t", order[300], order[260])]
    rows += [(rng.choice("tu"), rng.choice(order[310:]), rng.choice(order[310:])) for _ in range(40)]
    rng.shuffle(rows)
    assert run(spark, rows, bfs_rounds=rounds) == brute(rows)


@pytest.mark.parametrize("rounds", [2, 8])
def test_the_giant_of_every_topic_is_peeled(spark, rounds):
    """Topics with giants of unequal size and shape, and small components besides."""
    rows = [("a", "hub", f"n{i:03}") for i in range(200)] + [("b", f"n{i:03}", f"n{i + 1:03}") for i in range(40)] + [("b", "n020", f"x{i}") for i in range(9)]
    rows += [("c", f"n{i:03}", f"n{i // 2:03}") for i in range(1, 60)] + [(t, f"s{i}", f"t{i}") for t in "abc" for i in range(5)]
    assert run(spark, rows, bfs_rounds=rounds) == brute(rows)
    scratch = components.Scratch(spark, "peel")
    edges = spark.createDataFrame([(t, min(a, b), max(a, b)) for t, a, b in rows], "topic string, a string, b string")
    reached, rest = components._peel_giants(scratch, edges, rounds)
    assert {r["topic"] for r in reached.collect()} == {"a", "b", "c"}
    assert not rest.where("topic = 'a' and (a = 'hub' or b = 'hub')").count()
