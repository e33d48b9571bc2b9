import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import splitting as S


def forced_by_definition(text, limit):
    import re

    return max(map(len, re.split(r"[ \t\r\n]+", text))) > limit


def check(text, limit=60, overlap=10):
    pieces = S.split_points(text, limit, overlap)
    if not text:
        assert pieces == []
        return
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text) and all(0 < b - a <= limit for a, b, _, _ in pieces)
    rebuilt = "".join(text[a + o : b] for a, b, o, _ in pieces)
    assert rebuilt == text
    for (_, end, _, kind), (start, _, o, _) in zip(pieces, pieces[1:]):
        assert end - start == o <= overlap
        if kind == "natural":
            assert text[end - 1] in " \t\r\n" or text[end] in " \t\r\n"
            assert o == overlap or o < overlap
    assert any(p[3] == "forced" for p in pieces) == (len(text) > limit and forced_by_definition(text, limit))


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .,\n#é😀", max_size=400))
def test_round_trip(text):
    check(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 75), min_size=1, max_size=12))
def test_long_words(lengths):
    check(" ".join("x" * n for n in lengths))


def test_range_maximum_against_brute_force(monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(S, "STRETCH", 64)
    where = np.array(sorted(rng.sample(range(1, 5000), 900)))
    strength = np.array([rng.randint(1, 6) for _ in where])
    index = S.StrongestCut(where, strength, 400)
    for _ in range(500):
        a = rng.randrange(5000)
        b = a + rng.randrange(400)
        inside = [(s, p) for p, s in zip(where, strength) if a <= p <= b]
        assert index.query(a, b) == (max(inside)[1] if inside else None)


def test_strengths_and_preference():
    text = "Some words here. More text, and\nline\n\n# Head\nend of it"
    where, strength = S.boundary_strengths(np.frombuffer(text.encode("utf-32-le"), np.uint32))
    by = dict(zip(where.tolist(), strength.tolist()))
    assert by[text.index("More")] == 3 and by[text.index("and")] == 2 and by[text.index("line")] == 4 and by[text.index("# Head")] == 6
    long = "word " * 9 + "end.\n\n" + "word " * 20
    assert S.split_points(long, 80, 5)[0][1] == long.index("\n\n") + 2


def test_operator(spark):
    rows = [(1, "a " * 5000, "x"), (2, "b" * 7000, "x"), (3, None, "x"), (4, "", "x"), (5, "short", "x"), (None, "c " * 4000, "x"), (7, "d" * 5900 + " " + "e" * 5950, "x"), (8, "w " * 700_000, "x")]
    df = spark.createDataFrame(rows, "file_id long, text string, piece string")
    assert {r["file_id"]: r["cut"] for r in S.cut_kinds(df).collect()} == {1: "natural", 2: "forced", None: "natural", 7: "natural", 8: "natural"}
    pieces = S.split_texts(df).where("file_id = 1").orderBy("piece_no").collect()
    assert "".join(p["piece"][p["overlap"] :] for p in pieces) == rows[0][1] and all(p["overlap"] == 200 for p in pieces[1:])
    assert S.split_texts(df.limit(0)).count() == 0
    twice = S.split_texts(df.unionByName(df)).count()
    assert twice == 2 * S.split_texts(df).count()
