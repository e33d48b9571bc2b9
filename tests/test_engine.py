import json
import time
import zipfile

import pytest

from tessera import models
from tessera.engine import NO_SUMMARIES, NOT_ENOUGH, Busy, Engine
from tessera.sources.store import Store
from tessera.streaming.ingest import watch_topic


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("engine")
    raw = base / "raw" / "t"
    raw.mkdir(parents=True)
    (raw / "a.md").write_text("Marketing Mix Modeling uses Adstock. Adstock was studied by Simon Broadbent in London. Bayesian Models extend Adstock.")
    (raw / "b.html").write_text("<nav>Menu</nav><p>Simon Broadbent wrote about Adstock. Geo Tests are compared with Marketing Mix Modelling.</p>")
    engine = Engine(spark, str(base / "raw"), str(base / "graphs"), embedder=models.HashingEmbedder())
    topic = engine.topic("t")
    assert topic.status()["status"] == "idle" and topic.ask("x")["answer"] == NO_SUMMARIES
    status = topic.build()
    assert status["document_count"] == 2 and status["status"] == "ready"
    return engine, topic, raw, base


def test_build_is_incremental(built):
    engine, topic, raw, base = built
    assert topic.build()["up_to_date"]
    nodes = {r["id"]: r for r in topic.table("nodes").collect()}
    assert nodes["Adstock"]["sources"] == ["a.md", "b.html"] and "Simon Broadbent" in nodes
    assert len([n for n in nodes if n.lower().startswith("marketing mix")]) == 1
    assert topic.table("edges").where("source is null").count() == 0
    assert topic.health()["dangling"] == 0 and engine.topics()[0]["topic"] == "t"


def test_ask_cites_and_streams(built):
    _, topic, _, _ = built
    out = topic.ask("Who studied Adstock?")
    assert "[[" in out["answer"] and out["relevant_communities"] >= 1
    assert topic.ask("zzzz qqqq")["answer"] == NOT_ENOUGH
    assert [e["type"] for e in topic.ask_stream("Who studied Adstock?")][:3] == ["status", "meta", "token"]
    with pytest.raises(Busy):
        topic.engine.running["t"] = {"status": "building"}
        topic.ask("x")
    topic.engine.running.clear()


def test_nodes_exports_pins(built, tmp_path):
    _, topic, _, _ = built
    node = topic.node("Adstock", generate=True)
    assert node["article"] and topic.node("Adstock")["article"] == node["article"] and node["incoming"]
    with pytest.raises(KeyError):
        topic.node("none")
    n = topic.export_vault(str(tmp_path))
    assert n == topic.table("nodes").count() and (tmp_path / "_index.md").exists()
    note = (tmp_path / "Adstock.md").read_text()
    assert note.startswith("---\nid: Adstock\n") and "## Article" in note and "[[Simon Broadbent|Simon Broadbent]]" in note
    assert "## By type" in topic.index_markdown() and topic.digest().startswith("Graph contains")
    assert topic.graph()["links"] and topic.blog("ideas", length="short")
    pin = topic.pin("q", "a")
    assert [p["question"] for p in topic.pins()] == ["q"]
    with pytest.raises(ValueError):
        topic.pin(" ", "a")
    topic.unpin(pin)
    with pytest.raises(KeyError):
        topic.unpin(pin)


def test_merge_remove_and_watch(built):
    _, topic, raw, base = built
    topic.merge_entities({"Geo Tests": "Bayesian Models"})
    assert topic.table("nodes").where("id = 'Geo Tests'").count() == 0
    (raw / "b.html").unlink()
    assert topic.build()["document_count"] == 1
    assert all("b.html" not in r["sources"] for r in topic.table("nodes").collect())
    (raw / "c.txt").write_text("Holdout Tests complement Bayesian Models.")
    query = watch_topic(topic, str(base / "checkpoint"))
    query.awaitTermination()
    assert topic.status()["document_count"] == 2 and topic.table("nodes").where("id = 'Holdout Tests'").count() == 1


def test_think_filter():
    assert "".join(models.think_filter(iter(["<think>", "a", "</think> b", "c"]))) == "bc"
    assert "".join(models.think_filter(iter(["ab", "abcd", "abcdef"]), hold=3)) == "abcdef"
    assert "".join(models.think_filter(iter(["short"]))) == "short"
    assert "".join(models.think_filter(iter(["<think> never closed"]))) == ""


def test_failed_model_rows_keep_their_error(spark):
    class Failing:
        def complete(self, task, prompt, **fields):
            raise TimeoutError("slow")

    df = spark.createDataFrame([(1, "p")], "k int, prompt string")
    row = models.map_model(df, Failing(), "x", ["k"]).first()
    assert row["answer"] is None and "TimeoutError" in row["error"]
    with pytest.raises(ValueError):
        models.make_model("none")


def test_resolver_has_two_passes(spark, tmp_path):
    class Pairs(models.ExtractiveModel):
        def _resolve(self, prompt, **_):
            has = lambda n: f'- "{n}" (' in prompt
            out = []
            if has("Alpha Social") and has("Zeta Social") and "): " + "d" * 120 + "\n" in prompt + "\n":
                out.append(["Alpha Social Network, rewritten", "Zeta Social", "Alpha Social", "Not A Node At All"])
            if has("Concept 00"):
                out.append(["Concept 00", "Concept 01"] if has("Concept 01") else ["Concept 02", "Concept 01", "Concept 03"])
            return json.dumps(out)

    rows = [("t", f"Concept {k:02}", "CONCEPT", "x") for k in range(30)] + [("t", n, "ORGANIZATION", "d" * 500) for n in ("Alpha Social", "Zeta Social")]
    nodes = spark.createDataFrame(rows, "topic string, id string, type string, description string")
    topic = Engine(spark, str(tmp_path), str(tmp_path), model=Pairs()).topic("t")
    got = {(r["alias"], r["canonical"], r["origin"]) for r in topic._resolve(nodes).collect()}
    assert got == {("Zeta Social", "Alpha Social", "learned"), ("Concept 01", "Concept 00", "learned"), ("Concept 03", "Concept 02", "learned")}


class Scripted:
    """A model whose answers are given per task; one name makes it hang, one makes it fail."""

    def __init__(self, structured=None, **answers):
        self.answers, self.as_object = answers, structured

    def complete(self, task, prompt, **fields):
        if "hang" in prompt:
            time.sleep(30)
        return self.answers[task]

    def structured(self, task, prompt, **fields):
        if self.as_object is None:
            raise NotImplementedError
        return self.as_object

    def stream(self, task, prompt, **fields):
        yield from ("<think>no", "ise</think> ", "One ", "two.")


def test_calls_are_bounded_in_time(spark):
    rows = spark.createDataFrame([(1, "fine"), (2, "hang")], "k long, prompt string")
    got = {r["k"]: r for r in models.map_model(rows, Scripted(summarise="said"), "summarise", ["k"], seconds=1).collect()}
    assert got[1]["answer"] == "said" and got[1]["error"] is None and got[2]["answer"] is None and "TimeoutError" in got[2]["error"]
    with pytest.raises(TimeoutError):
        models.complete(Scripted(summarise="x"), "summarise", "hang", 0.2)


def test_extraction_falls_back_to_plain_text():
    assert models.complete(Scripted(extract="plain"), "extract", "p") == "plain"
    assert models.complete(Scripted("object", extract="plain"), "extract", "p") == "object"
    assert list(models.stream(Scripted(), "answer", "p")) == ["One ", "two."]
    assert isinstance(models.make_model("chat", base_url="http://localhost:1/v1", model="m"), models.ChatModel)
    assert models.SentenceEmbedder.available() in (True, False)


def test_settings_progress_and_archive(built, tmp_path):
    _, topic, raw, _ = built
    (raw / "c.md").write_text("Radio Panels were compared with Geo Tests.")
    assert topic.build(context="radio", entity_types=["CONCEPT"])["status"] == "ready"
    assert topic.settings()["context"] == "radio" and topic.settings()["entity_types"] == ["CONCEPT"]
    task = topic.engine.running["t"]
    assert task["documents"] == task["documents_done"] == 1 and task["documents_failed"] == 0
    n = topic.export_zip(str(tmp_path / "v.zip"))
    with zipfile.ZipFile(tmp_path / "v.zip") as z:
        assert len(z.namelist()) == n + 1 and "t/_index.md" in z.namelist()


def test_a_failed_write_leaves_the_old_version(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}")
    store.replace("x", spark.createDataFrame([(1,)], "a int"))
    with pytest.raises(Exception):
        store.replace("x", spark.range(1).selectExpr("raise_error('no') AS a"))
    assert store.table("x", "a int").collect() == [(1,)]
    store.replace("x", store.table("x", "a int").selectExpr("a + 1 AS a"))
    store.append("x", spark.createDataFrame([(7,)], "a int"))
    assert sorted(r["a"] for r in store.table("x", "a int").collect()) == [2, 7] and store.table("y", "a int").count() == 0
    for _ in range(3):
        store.replace("x", store.table("x", "a int"))
    assert len(store.folders("x")) == 2
