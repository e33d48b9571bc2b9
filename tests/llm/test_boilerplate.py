from tessera.llm import boilerplate as B

PAGE = """Skip to content
- Pricing
- Contact
- Home

Read next
Another title here — 4 min read

# The real title

This is the first sentence of the article and it says what the test was about.

Privacy in the test

The cookie banner of the shop was accepted by fewer visitors than planned, so tracked conversions fell.

Share this article
Subscribe to the Examplesite newsletter and never miss a post. No spam, unsubscribe at any time.

- share of spend
- privacy first

| channel | spend |
|---|---|
| radio | 12 |

```
fit(x)
```

> A quotation of somebody.

712 comments
© 2021 Examplesite. All rights reserved.
Terms of use · Privacy notice · Imprint"""


def body(text, filename="The real title.html", source="https://www.examplesite9.example/the-real-title"):
    return [line for line, main in zip(text.split("\n"), B.line_labels(text, filename, source)) if main]


def test_page():
    kept = body(PAGE)
    assert kept[0] == "# The real title" and "Privacy in the test" in kept and "- share of spend" in kept and "fit(x)" in kept and "> A quotation of somebody." in kept
    assert not any(w in "\n".join(kept) for w in ("Skip", "Pricing", "Read next", "Another title", "Share this", "Subscribe", "712", "©", "Imprint"))


def test_other_languages_and_teasers_with_sentences():
    page = "Menü öffnen\nStartseite / Hilfe / Kontakt / Presse\n\nEin Titel\n\nObwohl die Ausgaben kaum schwankten, blieb der Absatz nach der Änderung stabil.\n\nMeistgelesen\nAnderer Titel\nDas Panel wurde danach noch einmal geprüft.\nDritter Titel\nDas Panel wurde danach noch einmal geprüft.\n\nNach oben"
    assert body(page, "Ein Titel.md", None) == ["Ein Titel", "Obwohl die Ausgaben kaum schwankten, blieb der Absatz nach der Änderung stabil."]


def test_edge_cases(spark):
    rows = [(1, "a.html", None, None, "x"), (2, "b.HTM", None, "", "x"), (3, "c.txt", None, "Home\nBlog", "x"), (4, None, None, "Home", "x"), (None, "d.md", None, "Home", "x"), (6, "e.md", None, "Home\n" + "the word of it. " * 90_000, "x"), (6, "e.md", None, "Home\n" + "the word of it. " * 90_000, "x")]
    df = spark.createDataFrame(rows, "file_id long, filename string, source string, text string, line_no string")
    assert sorted(map(tuple, B.boilerplate_lines(df).collect()), key=str) == [(6, 1), (6, 1), (None, 1)]
    assert B.boilerplate_lines(df.limit(0)).count() == 0
    assert B.main_bodies(spark.createDataFrame([(1, "The real title.html", None, PAGE)], "file_id long, filename string, source string, text string")).first()["main_text"].startswith("# The real title")


def test_odd_shapes_stay_fast():
    import time

    began = time.time()
    for text in ("[" * 200_000, "a/" * 200_000, "](" * 100_000, "| " * 100_000, "* " * 100_000, "Read next\n" * 20_000, "x\n" * 100_000, "http://" * 50_000, "A" * 500_000):
        B.line_labels("# T\n\n" + text, "T.md", "https://www.site9.example/t")
    assert time.time() - began < 60


def test_learned_lines_without_cue_words(spark):
    """On the pages at hand, 0.9 or more of what the cue words help to find, at a precision of 0.95 or more."""
    files = spark.read.parquet("/root/testdata/sf0.1/parsed_files.parquet")
    want = {tuple(r) for r in B.boilerplate_lines(files).collect()}
    got = {tuple(r) for r in B.learned_lines(files).collect()}
    assert len(want & got) >= 0.9 * len(want) and len(want & got) >= 0.95 * len(got)


def test_learned_lines_of_an_unknown_language(spark):
    menu = "Zuhause\nPrijzen\nOver ons en meer"
    rows = [(k, f"p{k}.html", f"https://www.voorbeeld.example/p{k}", f"{menu}\n\n# Titel {k}\n\nDe verkoop in regio {k} steeg dit jaar met {k} procent, wat niemand in het team had verwacht na de lange winter {'abcdef'[k]}.\n\nVolg ons overal", "x") for k in range(6)]
    rows += [(9, None, None, "text", "x"), (10, "e.md", None, None, "x"), (11, "f.md", None, "", "x"), (None, "p9.html", rows[0][2], rows[0][3], "x")]
    df = spark.createDataFrame(rows, "file_id long, filename string, source string, text string, site string")
    got = sorted((r["line_no"] for r in B.learned_lines(df).where("file_id = 3").collect()))
    assert got == [1, 2, 3, 9]
    assert B.learned_lines(df.limit(0)).count() == 0 and {r["file_id"] for r in B.learned_lines(df).collect()} == {None, *range(6)}
