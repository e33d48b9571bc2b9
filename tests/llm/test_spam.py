import random

from tessera.llm import spam as S

SENT = ["The vendor argued that radio should be kept, because sales fell while stock was short.", "When the team looked at cinema, the effect on trial was close to zero and nobody asked why.", "If print were cut by 12 percent, the model would lower demand only slightly, although prices moved.", "It is tempting to credit search for the gain, but the two channels were always bought together.", "Readers who compare store visits with basket size should remember that invoices arrive late."]


def prose(rng, n):
    return " ".join(rng.sample(SENT, 1)[0].replace("12", str(rng.randint(1, 999))).replace("radio", rng.choice(["radio", "posters", "leaflets", "banners"])) for _ in range(n))


def corpus():
    rng = random.Random(6)
    rows = [(i, "\n\n".join(prose(rng, 4) for _ in range(rng.randint(1, 5)))) for i in range(300)]
    words = ["geo test kit", "media planner", "roi calculator", "coupon printing"]
    mods = ["best", "cheap", "free", "online", "top", "review", "compare", "buy", "2025", "near me"]
    spam = {
        1000: ", ".join(f"{rng.choice(mods)} {rng.choice(words)}" for _ in range(70)),
        1001: "\n".join(f"{rng.choice(mods)} {rng.choice(words)}".capitalize() for _ in range(70)),
        1002: " ".join(f"#{rng.choice(mods).title()}{rng.choice(words).title().replace(' ', '')}" for _ in range(60)),
        1003: "\n".join(f"- [{rng.choice(mods)} {w}](https://site{rng.randint(1, 99)}.example/{w.replace(' ', '-')})" for w in words * 12),
        1004: " | ".join(f"{rng.choice(words)} SKU-{rng.randint(1000, 99999)}" for _ in range(60)),
        1005: " ".join(rng.choice(["Looking for media planner? Our media planner is the media planner you need.", "Order media planner today and save on media planner."]) for _ in range(20)),
        1006: prose(rng, 1) + "\n\n" + "\n".join(f"http://s{rng.randint(1, 99)}.example/?q={rng.choice(mods)}+media+planner&p={rng.randint(1, 400)}" for _ in range(40)),
    }
    fine = {
        2000: prose(rng, 1) + "\n\n| week | channel | spend |\n|---|---|---|\n" + "\n".join(f"| {i} | radio | {rng.randint(1, 9999)} |" for i in range(40)),
        2001: prose(rng, 1) + "\n\n```\n" + "\n".join(f"lift = fit(load('sales'), decay=0.{rng.randint(1, 99)}, lag={i})" for i in range(30)) + "\n```",
        2002: prose(rng, 20).lower().replace(",", "").replace(".", ""),
        2003: "A lone title",
        2004: "One sentence only, which says something.",
        2005: prose(rng, 3) + "\n\n" + ", ".join(["media planner"] * 8),
    }
    return rows, spam, fine


def test_spam_is_found(spark):
    rows, spam, fine = corpus()
    extra = [(None, spam[1000], "x"), (3000, None, "x"), (3001, "", "x"), (3002, " \n ", "x"), (1000, spam[1000], "x"), (3003, "word " * 400_000, "x")]
    df = spark.createDataFrame([(i, t, "x") for i, t in [*rows, *spam.items(), *fine.items()]] + extra, "doc_id long, text string, chars string")
    found = sorted((r["doc_id"] for r in S.spam_pages(df).collect()), key=str)
    assert found == sorted([None, 3003, *spam], key=str)
    shares = {r["doc_id"]: r for r in S.spam_shares(df).collect()}
    assert 3000 not in shares and 3001 not in shares and 3002 not in shares and shares[2005]["spam_share"] < 0.5
    assert shares[1000]["n_chars"] == 2 * len(spam[1000])


def test_separators_and_fences_do_not_exempt(spark):
    rows, _, _ = corpus()
    words = ["media mix", "roi calculator", "coupon printing"]
    lists = {
        1: "\n".join(f"cheap {w}; buy {w}; best {w};" for w in words * 20), 2: "\n".join(f"cheap {w}\tbuy {w}\tbest {w}" for w in words * 20), 3: "\n".join(f"| cheap {w} | buy {w} | best {w} |" for w in words * 20),
        4: "```\n" + "\n".join(f"cheap {w}, buy {w}, best {w}" for w in words * 20) + "\n```", 5: "media planner " * 6,
    }
    real = {6: "Week\tradio\tprint\n" + "\n".join(f"{i}\t{i * 37 % 101}\t{i * 53 % 97}.5" for i in range(40)), 7: "```\n" + "\n".join(f"spend = load('radio {i % 3}')\nfit(spend)\n" for i in range(30)) + "\n```"}
    for corpus_rows in (rows, rows[:40], []):  # the verdicts do not hang on how much else there is
        df = spark.createDataFrame([*((i + 10, t) for i, t in corpus_rows), *lists.items(), *real.items()], "doc_id long, text string")
        assert sorted(r[0] for r in S.spam_pages(df).collect()) == [1, 2, 3, 4, 5]


def test_prose_with_words_of_code_is_prose():
    for text in ("Sales rose by 40 percent for most of the autumn; nobody knew why (it rained).", "It worked while stock was short: the panel (an old one) agreed from the start;"):
        assert [kind for kind, _ in S.text_blocks(text)] in (["prose"], ["bare"])


def test_empty(spark):
    assert S.spam_pages(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_blocks():
    kinds = [k for k, _ in S.text_blocks("Word list here\n\nMore of it\n\nA sentence ends.\n\n```\nx = 1\n\nfit(x)\n```\n\n| a | b |\n| 1 | 2 |")]
    assert kinds == ["bare", "prose", "code", "table"]


def test_many_paragraphs_and_odd_shapes_stay_fast():
    import time

    began = time.time()
    assert len(S.text_blocks("word list\n\n" * 200_000)) == 1
    for text in ("[" * 200_000, "|" * 200_000, "." * 200_000, "a/" * 200_000, "<" * 200_000):
        S.block_features(text)
        S.text_blocks(text)
    assert time.time() - began < 60
