import random

import pytest

from tessera.llm import leakage as L

Q = "Because the old ledger was damp, Thrumshaw printed 6875 calendars that show nothing but garden shears, and nobody recorded the weather on the quay. Which of the two quarters was treated first?"
ITEMS = [(1, Q, "The colder quarter was treated first because the quay was closed in spring."), (2, "Why does the later ledger of the Novic guild look better than the earlier one kept by its own captain?", None), (3, None, "x"), (4, "", None)]
FILL = "Half of the budget went to radio while print was left with the rest of it. " * 6


def found(text):
    return sorted((x[0], x[1]) for x in L.LeakFinder(ITEMS).search(text))


@pytest.mark.parametrize(
    "text",
    [
        Q, FILL + Q.upper() + FILL, Q.lower().replace(",", "").replace(".", ""), Q.replace(" ", "  \n"), " ".join(f"**{w}**" if i % 4 == 0 else w for i, w in enumerate(Q.split())), Q.replace("old ledger", "<b>old</b> ledger"),
        Q.replace("damp", "wet").replace("garden", "grden").replace("nobody", "roughly nobody"), " ".join(Q.split()[: int(len(Q.split()) * 0.6)]), " ".join(Q.split()[:16]) + " " + FILL + " ".join(Q.split()[16:]),
        " ".join("other" if i % 3 == 2 else w for i, w in enumerate(Q.split())), " ".join(w + " then" for w in Q.split()), " ".join(w for i, w in enumerate(Q.split()) if i % 3),
    ],
)
def test_leaks(text):
    assert (1, "question") in found(text)


@pytest.mark.parametrize("text", ["", FILL, " ".join(Q.split()[:14]), " ".join(reversed(Q.split())), ITEMS[0][2][:30]])
def test_no_leaks(text):
    assert found(text) == []


def test_answers_and_offsets():
    text = FILL + "“" + ITEMS[0][2] + "” " + FILL
    (hit,) = L.LeakFinder(ITEMS).search(text)
    assert hit[:2] == (1, "answer") and text[hit[4] : hit[5]].strip("“”").startswith("The colder quarter") and "spring" in text[hit[4] : hit[5]]
    text = "É <i>Straße</i> ß " + FILL + Q
    hit = next(x for x in L.LeakFinder(ITEMS).search(text) if x[1] == "question")
    assert text[hit[4] : hit[5]] == Q


def brute_passage(q, d, gap=L.GAP):
    """Longest chain, or two chains that follow on, by plain dynamic programming over all pairs of equal words."""
    pairs = [(i, j) for j in range(len(d)) for i in range(len(q)) if q[i] == d[j]]
    one, two, best = {}, {}, 0
    for i, j in pairs:
        back = [(a, b) for a in range(max(0, i - gap - 1), i) for b in range(max(0, j - gap - 1), j)]
        one[i, j] = max([(one[p][0] + 1, one[p][1] + 1) for p in back if p in one], default=(1, 1))
        cand = [(two[p][0] + 1, two[p][1] + 1) for p in back if p in two]
        cand += [(one[a, b][0] + 1, 1) for a, b in one if i - gap - 1 <= a < i and b < j and one[a, b][1] >= L.LEAST_CHAIN]
        if cand:
            two[i, j] = max(cand)
        for x in (one[i, j], two.get((i, j))):
            if x and x[1] >= L.LEAST_CHAIN:
                best = max(best, x[0])
    return best


def test_passage_against_brute_force():
    rng = random.Random(8)
    for _ in range(60):
        q = [rng.choice("abcdefghijklmnop") for _ in range(24)]
        d = [rng.choice("abcdefghijklmnop") for _ in range(15)] + q[: rng.randint(5, 24)] + [rng.choice("qrstuv") for _ in range(rng.randint(0, 12))] + q[rng.randint(5, 20) :]
        for _ in range(4):
            d[rng.randrange(len(d))] = "z"
        got = L.best_passage(q, d)
        want = brute_passage(q, d)
        assert got is not None and abs(got[0] - want) <= 1


def test_what_is_set_aside_holds_no_passage():
    """Every question that plain alignment finds in a text is among the likely ones, wherever its words were changed."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    items = [(k, " ".join(rng.choice(words[: rng.choice((8, 20, 60))]) for _ in range(rng.choice((1, 2, 3, 5, 9, 24, 41)))), None) for k in range(60)]
    finder, held = L.LeakFinder(items), 0
    for _ in range(300):
        q = rng.choice(items)[1].split()
        text = []
        for w in q:
            how = rng.random()
            text += [w] if how < 0.6 else [rng.choice(words)] if how < 0.75 else [w, rng.choice(words)] if how < 0.9 else []
        cut = rng.randint(0, len(text))
        text = rng.choices(words, k=rng.randint(0, 30)) + text[:cut] + rng.choices(words, k=rng.choice((0, 0, 20))) + text[cut:] + rng.choices(words, k=rng.randint(0, 30))
        got = {x[0] for x in finder.search(" ".join(text))}
        for k, (_, question) in enumerate(finder.questions):
            best = L.best_passage(question, text)
            held += bool(best and best[0] > 0.5 * len(question))
            assert (finder.questions[k][0] in got) == bool(best and best[0] > 0.5 * len(question))
    assert held > 300


def test_slices_are_bounded(spark, monkeypatch):
    items = spark.createDataFrame([(7, f"question number {i} about the ledger of the quay", None) for i in range(23)], "item_id long, question string, answer string")
    seen = []
    plain = L._scanner
    monkeypatch.setattr(L, "_scanner", lambda rows, *x: seen.append(len(rows)) or plain(rows, *x))
    docs = spark.createDataFrame([(1, "So question number 4 about the ledger of the quay was asked.")], "doc_id long, text string")
    assert L.leaks(docs, items, max_items=5).count() == 23 and seen == [5, 5, 5, 5, 3]


def test_operator(spark):
    docs = [(1, Q, "x"), (2, None, "x"), (3, "", "x"), (4, FILL * 2000 + Q, "x"), (None, Q, "x"), (1, Q, "x"), (5, FILL, "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    i = spark.createDataFrame([(*x, "s") for x in ITEMS], "item_id long, question string, answer string, text string")
    assert sorted(map(tuple, L.leaked_items(d, i).collect()), key=str) == [(1, 1), (4, 1), (None, 1)]
    sliced = L.leaks(d, i, max_items=1).where("part = 'question'").select("doc_id", "item_id").distinct()
    assert sorted(map(tuple, sliced.collect()), key=str) == [(1, 1), (4, 1), (None, 1)]
    assert L.leaked_items(d.limit(0), i).count() == L.leaked_items(d, i.limit(0)).count() == 0


def test_long_texts_with_repeats_stay_fast():
    import time

    began = time.time()
    text = "nobody recorded the weather on the quay. " * 40_000 + Q
    assert found(text) == [(1, "question")] or (1, "question") in found(text)
    assert time.time() - began < 60
