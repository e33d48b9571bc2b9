import random
from collections import Counter

import numpy as np
import pytest

from tessera.llm import packing as P


def brute_least(sizes, cap):
    best = [len(sizes)]

    def go(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(rooms)
            return
        for i in range(len(rooms)):
            if rooms[i] >= sizes[k] and rooms[i] not in rooms[:i]:
                go(k + 1, rooms[:i] + [rooms[i] - sizes[k]] + rooms[i + 1 :])
        go(k + 1, rooms + [cap - sizes[k]])

    sizes = sorted(sizes, reverse=True)
    go(0, [])
    return best[0]


def test_lower_bound_never_exceeds_the_optimum():
    rng = random.Random(2)
    for _ in range(60):
        cap = rng.choice([10, 17, 20])
        sizes = [rng.randint(1, cap) for _ in range(rng.randint(1, 9))]
        bound = P.lower_bound(np.bincount(sizes, minlength=cap + 1))
        assert -(-sum(sizes) // cap) <= bound <= brute_least(sizes, cap)
    assert P.lower_bound(np.bincount([11] * 7, minlength=21)) == 7


def test_best_fit_decreasing_is_best_fit():
    rng = random.Random(3)
    sizes = np.array([rng.randint(0, 50) for _ in range(300)])
    container, room = P.best_fit_decreasing(sizes, 50)
    used = Counter()
    for c, s in zip(container, sizes):
        used[c] += s
    assert all(50 - used[c] == room[c] >= 0 for c in range(len(room)))


def test_counter_equals_the_tokenizer():
    c = P.TokenCounter(P.TOKENIZER)
    for t in ["", " ", "Hello world, it's 2024!\n\n  tabs\t", "Überraschung 😀 naïve", "a" * 3000, "  lead and trail  "]:
        assert c.count(t) == len(c.encoding.encode_ordinary(t))


@pytest.mark.parametrize("per_task", [50_000, 40])
def test_documents(spark, per_task):
    rng = random.Random(1)
    texts = ["word " * rng.randint(0, 400) for _ in range(300)] + ["", None, "long " * 3000, "hot " * 50, "hot " * 50]
    rows = [(i, t, i) for i, t in enumerate(texts)] + [(None, "nobody", 0), (0, texts[0], 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    out = P.pack_documents(df, capacity=512, per_task=per_task).collect()
    c = P.TokenCounter(P.TOKENIZER)
    want = Counter()
    for i, t, _ in rows:
        n = c.count(t or "")
        for k in range(max(1, -(-n // 512))):
            want[(i, k, k * 512, min(512, n - k * 512))] += 1
    assert Counter((r["doc_id"], r["piece_no"], r["start_token"], r["n_tokens"]) for r in out) == want
    fill = Counter()
    for r in out:
        fill[r["container"]] += r["n_tokens"]
    assert max(fill.values()) <= 512
    report = P.packing_report(P.pack_documents(df, capacity=512, per_task=per_task), 512).first()
    assert report["lower_bound"] <= report["n_containers"] == len(fill) <= report["lower_bound"] + 3


def test_empty(spark):
    assert P.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        P.pack_documents(spark.createDataFrame([], "doc_id long, text string"), capacity=0)
