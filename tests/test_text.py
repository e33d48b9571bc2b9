import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T


def col(spark, f, values):
    return [r[0] for r in spark.createDataFrame([(v, i) for i, v in enumerate(values)], "x string, i int").orderBy("i").select(f(F.col("x"))).collect()]


def test_names(spark):
    assert col(spark, T.normal_name, ["Marketing  Mix Modelling (MMM)", "(MMM)", " Müller "]) == ["marketing mix modeling", "", "müller"]
    assert col(spark, T.token_signature, ["Marketing Mix Modeling", "Methodologies", "ROAS", "Status", "Sales", "Spring", "東京"]) == ["market mix model", "methodology", "roas", "status", "sale", "spr", ""]
    assert col(spark, T.initials, ["Return on Ads Spend", "One", "a b c d e f g h i"]) == ["roas", None, None]
    assert col(spark, T.is_acronym, ["ROAS", "roas", "R S", "Ro"]) == [True, False, False, False]


def test_sentences_and_keywords(spark):
    assert col(spark, T.one_line, [" One. Two.", "No end", "Hm?! Yes"]) == ["One.", "No end", "Hm?!"]
    assert col(spark, T.keywords, ["What is the ad stock of TV ads? Stock!"]) == [["stock", "ads"]]
    assert col(spark, T.after_reasoning, ["a</think> b</think>\n c ", "plain"]) == ["c", "plain"]
    assert col(spark, T.without_fence, ['```json\n{"a": 1}\n```']) == ['{"a": 1}']


@pytest.mark.parametrize(
    "text,block",
    [("x {\"a\": \"}\"} y {}", '{"a": "}"}'), ("[1, [2]] z", "[1, [2]]"), ("{ open", None), ("none", None), ('{"a": "\\"}"}', '{"a": "\\"}"}')],
)
def test_balanced_block(text, block):
    assert T.balanced_block(text) == block


def test_citations(spark):
    claim = "This claim is quite long and has no citation of any entity at all in it."
    cited = "This claim is long as well but it cites [[Adstock]] as it should do."
    texts = [f"# Head\n{claim} {cited}\n- point", claim, "short", ""]
    assert col(spark, T.enforce_citations, texts) == [f"# Head\n{cited}\n- point", T.NOT_CITED, "short", ""]
    assert col(spark, T.citations, ["[[A]] [[" + "x" * 81 + "]] [[B c]]"]) == [["A", "B c"]]
    assert col(spark, T.informative, [f"x {T.NO_INFO}", " ", None, "yes"]) == [False, False, False, True]


def test_files_and_services(spark):
    assert col(spark, T.safe_filename, ['a/b:c*"d"', "???", "x" * 130]) == ["a b c d", "untitled", "x" * 120]
    assert col(spark, T.provider, [None, "http://localhost:1234", "http://h:11434", "https://x.googleapis.com", "https://api.anthropic.com", "http://else"]) == ["openai", "lmstudio", "ollama", "gemini", "anthropic", "custom"]
    assert col(spark, T.escaped_context, ["a {b}"]) == ["a {{b}}"]
    assert col(spark, lambda c: T.in_vocabulary(c, ["A"], "OTHER"), ["A", "B"]) == ["A", "OTHER"]
    assert col(spark, T.cell_text, [None, " a \n b ", "NaN"]) == ["", "a b", ""]


def test_dot(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [2.0, 1.0])], "a array<double>, b array<double>")
    assert df.select(T.dot(F.col("a"), F.col("b"))).first()[0] == 4.0
