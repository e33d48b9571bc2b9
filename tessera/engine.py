"""The engine: topics with their folders and stored graphs, and what can be asked of them.

A topic's graph is a set of Parquet tables under ``<graphs>/<topic>``, on any file system that Spark reaches; a new version
of a table takes effect by one switch of its pointer.  Builds, merges and exports are plans over these; prompts, the final answer and notes of one page are made on the driver.
"""

from __future__ import annotations

import json
import time
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera import models
from tessera.functions import text as T
from tessera.operators import community, dedup, graph, incremental, index, search, upsert
from tessera.operators.ranking import placed
from tessera.session import Scratch
from tessera.sources.files import parse_topic
from tessera.sources.store import Store

TABLES = {
    "nodes": "topic string, id string, name string, type string, description string, sources array<string>, ord bigint",
    "edges": "topic string, src string, label string, dst string, description string, ord bigint, source string",
    "node_community": "topic string, id string, community string",
    "community_summaries": "topic string, community string, summary string, ord bigint",
    "articles": "topic string, id string, article string",
    "aliases": "topic string, alias string, canonical string, origin string, learned_at timestamp",
    "manifest": "topic string, filename string, mtime double",
    "community_vectors": "topic string, community string, sha1 string, vec array<double>, model string",
    "pinned": "id string, question string, answer string, mode string, created_at bigint",
    "build_meta": "topic string, document_count bigint, node_count bigint, edge_count bigint, community_count bigint, built_at double",
}
RESOLVE_SECONDS = 120.0
NO_SUMMARIES = "No community summaries found. Please build the graph first."
NOT_ENOUGH = "I don't have enough information in the knowledge graph to answer that question."


class Busy(RuntimeError):
    """Another build or merge of the topic is running."""


class Engine:
    def __init__(self, spark: SparkSession, raw: str, graphs: str, model: models.TextModel | None = None, embedder: models.Embedder | None = None):
        self.spark, self.raw, self.graphs = spark, str(raw).rstrip("/"), str(graphs).rstrip("/")
        self.model = model or models.ExtractiveModel()
        self.embedder = embedder if getattr(embedder, "available", lambda: True)() else None  # without its package there is no similarity
        self.running: dict[str, dict] = {}

    def config(self, base_url: str = "") -> dict:
        kind = self.spark.range(1).select(T.provider(F.lit(base_url)).alias("p")).first()["p"]
        return {"provider": kind, "model": type(self.model).__name__, "embedder": self.embedder.name if self.embedder else None}

    def topics(self) -> list[dict]:
        """Topics that have a folder or a graph, with their status."""
        raw = set(Store(self.spark, self.raw).folders())
        names = raw | set(Store(self.spark, self.graphs).folders())
        return [{"topic": n, "has_raw": n in raw, **self.topic(n).status()} for n in sorted(names)]

    def topic(self, name: str) -> Topic:
        return Topic(self, name)


class Topic:
    def __init__(self, engine: Engine, name: str):
        self.engine, self.spark, self.name = engine, engine.spark, name
        self.store = Store(engine.spark, f"{engine.graphs}/{name}")

    # Storage

    def table(self, name: str) -> DataFrame:
        """A stored table; empty where it was never written."""
        return self.store.table(name, TABLES[name])

    def save(self, name: str, rows: DataFrame) -> None:
        """Replaces a table, from whose old version the rows may be read."""
        self.store.replace(name, rows.select(*[f.split()[0] for f in TABLES[name].split(", ")]))

    def exists(self) -> bool:
        return self.store.version("nodes") is not None

    def settings(self) -> dict:
        """The context and the vocabulary of the last build."""
        return json.loads(self.store.read_text("settings.json") or "{}")

    def _scratch(self) -> Scratch:
        return Scratch(self.spark, "engine")

    def status(self) -> dict:
        task = self.engine.running.get(self.name)
        if task and task["status"] in ("building", "merging"):
            return dict(task)
        meta = [r.asDict() for r in self.table("build_meta").collect()]  # one row
        base = {"status": "ready" if self.exists() else "idle", "up_to_date": bool(task and task.get("up_to_date"))}
        return base | (meta[0] if meta else {})

    def _run(self, what: str, f):
        task = self.engine.running.get(self.name)
        if task and task["status"] in ("building", "merging"):
            raise Busy(f"{self.name} is {task['status']}")
        task = self.engine.running[self.name] = {"status": what, "started_at": time.time()}
        try:
            f(task)
            task["status"] = "ready"
            return self.status()
        except Exception as e:
            task.update(status="failed", error=str(e))
            raise

    # Build

    def build(self, force: bool = False, context: str = "", entity_types: list[str] | None = None, relation_types: list[str] | None = None, context_window: int = 81_920, max_documents: int = 50, replace_modified: bool = False, cluster_size: int = 10) -> dict:
        """Builds or updates the graph from the topic's folder; only new and changed files are extracted unless ``force``.

        Context and vocabulary are kept; what is not given is as in the last build.
        """
        kept = self.settings()
        context = context or kept.get("context", "")
        entity_types = kept.get("entity_types", models.ENTITY_TYPES) if entity_types is None else entity_types
        relation_types = kept.get("relation_types", models.RELATION_TYPES) if relation_types is None else relation_types

        def go(task):
            self.store.write_text("settings.json", json.dumps({"context": context, "entity_types": entity_types, "relation_types": relation_types}, ensure_ascii=False))
            self._build(task, force, context, entity_types, relation_types, context_window, max_documents, replace_modified, cluster_size)

        return self._run("building", go)

    def _build(self, task, force, context, entity_types, relation_types, window, most, replace_modified, cluster_size) -> None:
        topic = F.lit(self.name).alias("topic")
        scratch = self._scratch()
        docs = scratch.write(parse_topic(self.spark, f"{self.engine.raw}/{self.name}").select(topic, "filename", "text", "source", "mtime"), "docs")
        full = force or not self.exists()
        manifest = self.table("manifest") if not full else self.spark.createDataFrame([], TABLES["manifest"])
        diff = scratch.write(incremental.manifest_diff(docs, manifest), "diff")
        changed, removed = diff.where("change = 'changed'"), diff.where("change = 'removed'")
        if not full and changed.isEmpty() and removed.isEmpty():
            task["up_to_date"] = True
            scratch.clear()
            return
        todo = docs.join(changed, ["topic", "filename"], "left_semi")
        if full:  # the cap holds for full builds only; what it leaves out stays out of the manifest
            todo = todo.join(incremental.capped_documents(todo, most).select("topic", "filename"), ["topic", "filename"], "left_semi")
        todo = scratch.write(todo, "todo")
        nodes, edges = self.table("nodes"), self.table("edges")
        if full:
            nodes, edges = nodes.limit(0), edges.limit(0)
        gone = removed.unionByName(changed) if replace_modified else removed
        nodes, edges = upsert.remove_sources(nodes, edges, gone.select("topic", F.col("filename").alias("source")))
        start = nodes.agg(F.coalesce(F.max("ord"), F.lit(-1))).first()[0] + 1
        start = max(start, edges.agg(F.coalesce(F.max("ord"), F.lit(-1))).first()[0] + 1)
        task["documents"] = todo.count()
        new_entities, new_edges = self._extract(scratch, todo, context, entity_types, relation_types, window, start, task)
        old_rows = nodes.select("topic", "id", "name", "type", "description", F.explode_outer("sources").alias("source"), "ord")
        merged = upsert.upsert_nodes(old_rows.unionByName(new_entities))
        all_edges = edges.select("topic", "src", "label", "dst", "description", "ord", "source").unionByName(new_edges)
        merged, all_edges = scratch.write(merged, "nodes"), scratch.write(all_edges, "edges")
        self._finish(scratch, merged, all_edges, cluster_size)
        self.save("manifest", docs.join(todo.select("topic", "filename").unionByName(diff.where("change = 'unchanged'").select("topic", "filename")), ["topic", "filename"], "left_semi").select("topic", "filename", "mtime"))
        n_docs = self.table("manifest").count()
        self._meta(n_docs)
        scratch.clear()

    def _extract(self, scratch: Scratch, docs: DataFrame, context: str, entity_types: list[str], relation_types: list[str], window: int, start: int, task: dict) -> tuple[DataFrame, DataFrame]:
        """Rows of entities and edges from documents: summary, extraction, vocabulary, and nodes for ends that lack one."""
        model, prompt = self.engine.model, models.extraction_prompt(entity_types, relation_types, context)
        short = docs.select("topic", "filename", T.truncated(F.col("text"), window).alias("text"))
        summaries = models.map_model(short.where(F.length("text") > 1500).withColumn("prompt", F.concat(F.lit("Summarise this document.\n\n"), "text")), model, "summarise", ["topic", "filename"], "summary")
        ready = short.join(summaries.drop("error"), ["topic", "filename"], "left").select("topic", "filename", F.coalesce("summary", "text").alias("text"))
        answers = models.map_model(ready.withColumn("prompt", F.replace(F.lit(prompt), F.lit("{text}"), F.col("text"))), model, "extract", ["topic", "filename"])
        seen = Observation()
        answers = answers.observe(seen, F.count("*").alias("done"), F.count("error").alias("failed"))
        found = scratch.write(models.parsed_extractions(answers, ["topic", "filename"]), "found")
        task.update(documents_done=seen.get["done"], documents_failed=seen.get["failed"])
        # Files are numbered by their names alone, so no task holds the extractions of a topic.
        numbers = placed(found.select("topic", "filename").distinct(), ["topic"], [F.col("filename")])
        found = found.join(numbers, ["topic", "filename"]).withColumn("base", F.lit(start) + (F.col("place") - 1) * 1_000_000).drop("place")
        e = found.select("topic", "filename", "base", F.posexplode("entities").alias("p", "e")).where("trim(e.name) <> ''")
        r = found.select("topic", "filename", "base", F.posexplode("relationships").alias("p", "r")).where("trim(r.source) <> '' and trim(r.target) <> ''")
        clean = lambda c: F.replace(F.trim(c), F.lit('"'), F.lit(" "))
        kind = T.in_vocabulary(F.col("e.type"), entity_types, "OTHER")
        entities = e.select("topic", clean(F.col("e.name")).alias("id"), F.trim("e.name").alias("name"), kind.alias("type"), F.coalesce("e.description", F.lit("")).alias("description"), F.col("filename").alias("source"), (F.col("base") + F.col("p")).alias("ord"))
        label = T.in_vocabulary(F.col("r.relation"), relation_types, "RELATED_TO")
        edges = r.select("topic", clean(F.col("r.source")).alias("src"), label.alias("label"), clean(F.col("r.target")).alias("dst"), F.coalesce("r.description", F.lit("")).alias("description"), (F.col("base") + 500_000 + F.col("p")).alias("ord"), F.col("filename").alias("source"))
        lacking = upsert.missing_endpoints(edges.withColumnRenamed("source", "filename"), entities.select("topic", F.col("source").alias("filename"), F.col("id").alias("name")))
        at = edges.groupBy("topic", F.col("source").alias("filename")).agg(F.max("ord").alias("last"))
        lacking = lacking.join(at, ["topic", "filename"]).select("topic", F.col("name").alias("id"), "name", F.lit("ENTITY").alias("type"), F.lit("").alias("description"), F.col("filename").alias("source"), (F.col("last") + 1).alias("ord"))
        return entities.unionByName(lacking), edges

    def _finish(self, scratch: Scratch, nodes: DataFrame, edges: DataFrame, cluster_size: int) -> None:
        """Deduplicates, clusters, summarises and stores a graph."""
        merged, new_edges, mapping = dedup.deduplicate(nodes, edges, graph.degrees(edges), self.table("aliases"))
        merged = scratch.write(merged, "merged")
        sources = dedup.apply_merge(edges, mapping).groupBy("topic", "src", "label", "dst").agg(F.min("source").alias("source"))
        new_edges = scratch.write(new_edges.join(sources, ["topic", "src", "label", "dst"], "left").select("topic", "src", "label", "dst", "description", "ord", "source"), "merged_edges")
        merged = self._rewritten(merged)
        assigned = scratch.write(community.detect_communities(graph.undirected(graph.valid_edges(new_edges, merged)), cluster_size).select("topic", "id", "community"), "communities")
        self.save("nodes", merged)
        self.save("edges", new_edges)
        self.save("node_community", assigned)
        self.save("community_summaries", self._summaries(merged, new_edges, assigned))

    def _rewritten(self, merged: DataFrame) -> DataFrame:
        """Descriptions that grew by merging are rewritten by the model; a failed call keeps them."""
        grown = merged.where("grown").select("topic", "id", F.col("description").alias("text"), F.concat(F.lit("Rewrite as one description:\n"), "description").alias("prompt"))
        new = models.map_model(grown, self.engine.model, "rewrite", ["topic", "id"], "rewritten").drop("error")
        return merged.join(new, ["topic", "id"], "left").withColumn("description", F.coalesce(F.when(F.col("rewritten") != "", F.col("rewritten")), "description")).drop("rewritten", "grown")

    def _summaries(self, nodes: DataFrame, edges: DataFrame, assigned: DataFrame) -> DataFrame:
        named = nodes.join(assigned, ["topic", "id"]).select("topic", "community", F.concat(F.lit("- "), "id", F.lit(" ("), F.coalesce("type", F.lit("")), F.lit("): "), F.coalesce("description", F.lit(""))).alias("line"))
        lines = named.unionByName(graph.relationship_lines(edges, assigned)).groupBy("topic", "community").agg(F.array_join(F.array_sort(F.collect_set("line")), "\n").alias("text"))
        asked = lines.withColumn("prompt", F.concat(F.lit("Summarise this group of entities and relationships.\n\n"), "text"))
        said = models.map_model(asked, self.engine.model, "community", ["topic", "community"], "summary").where("summary is not null")
        said = self._scratch().write(said.select("topic", "community", "summary"), "summaries")  # answers of a model are asked for once
        return said.join(placed(said.select("topic", "community"), ["topic"], [F.col("community")], "ord"), ["topic", "community"])

    def _meta(self, n_docs: int) -> None:
        simple = graph.undirected(graph.valid_edges(self.table("edges"), self.table("nodes"))).count()
        row = (self.name, n_docs, self.table("nodes").count(), simple, self.table("community_summaries").count(), time.time())
        self.save("build_meta", self.spark.createDataFrame([row], TABLES["build_meta"]))

    def merge_entities(self, aliases: dict[str, str] | None = None, recluster: bool = False, cluster_size: int = 10) -> dict:
        """Resolves names by the model, learns the aliases, and merges; communities follow the merge unless ``recluster``."""

        def go(task):
            if not self.exists():
                raise FileNotFoundError(f"no graph for {self.name}")
            scratch = self._scratch()
            nodes, edges = scratch.write(self.table("nodes"), "n"), scratch.write(self.table("edges"), "e")
            learned = self._resolve(nodes)
            given = [(self.name, a, c, "ontology", None) for a, c in (aliases or {}).items()]
            known = self.table("aliases").unionByName(learned).unionByName(self.spark.createDataFrame(given, TABLES["aliases"]))
            latest = F.struct((-F.coalesce(F.unix_micros("learned_at"), F.lit(-(2**62)))).alias("t"), "canonical")
            kept = known.groupBy("topic", "alias", "origin").agg(F.min_by(F.struct("canonical", "learned_at"), latest).alias("x"))
            self.save("aliases", kept.select("topic", "alias", "x.canonical", "origin", "x.learned_at"))
            if recluster:
                self._finish(scratch, nodes, edges, cluster_size)
            else:
                merged, new_edges, mapping = dedup.deduplicate(nodes, edges, graph.degrees(edges), self.table("aliases"))
                to = mapping.select("topic", "id", "winner")
                assigned = self.table("node_community").join(to, ["topic", "id"], "left").groupBy("topic", F.coalesce("winner", "id").alias("id")).agg(F.max_by("community", F.col("winner").isNull()).alias("community"))
                articles = self.table("articles").join(to, ["topic", "id"], "left").groupBy("topic", F.coalesce("winner", "id").alias("id")).agg(F.max_by("article", F.col("winner").isNull()).alias("article"))
                sources = dedup.apply_merge(edges, mapping).groupBy("topic", "src", "label", "dst").agg(F.min("source").alias("source"))
                self.save("nodes", self._rewritten(merged))
                self.save("edges", new_edges.join(sources, ["topic", "src", "label", "dst"], "left"))
                self.save("node_community", assigned)
                self.save("articles", articles)
            self._meta(self.table("manifest").count())
            scratch.clear()

        return self._run("merging", go)

    def _resolve(self, nodes: DataFrame) -> DataFrame:
        """Aliases that the model finds in batches of names: JSON groups whose first name is the canonical one.

        Two passes: by signature, then by type and name over what the first left unmerged; a decision of the first holds.
        A batch that takes longer than ``RESOLVE_SECONDS`` is left out.  A model that reasons first gets smaller batches.
        """
        scratch = self._scratch()
        first = scratch.write(self._resolve_pass(nodes, "signature"), "first")
        rest = nodes.join(first.select("topic", F.col("alias").alias("id")), ["topic", "id"], "left_anti")
        second = scratch.write(self._resolve_pass(rest, "type", nodes), "second")
        pairs = first.unionByName(second.join(first, ["topic", "alias"], "left_anti"))
        return pairs.select("topic", "alias", "canonical", F.lit("learned").alias("origin"), F.current_timestamp().alias("learned_at"))

    def _resolve_pass(self, asked_for: DataFrame, by: str, nodes: DataFrame | None = None) -> DataFrame:
        """``topic, alias, canonical``: what the model decides about some of the nodes, in batches of one order."""
        short = asked_for.withColumn("description", F.substring("description", 1, 120))
        most = 15 if getattr(self.engine.model, "reasons", False) else 25
        batches = dedup.resolver_batches(short, most, by=by).join(short, ["topic", "id"])
        asked = batches.groupBy("topic", "batch").agg(F.array_join(F.array_sort(F.collect_list(dedup.resolver_line())), "\n").alias("text"))
        asked = asked.withColumn("prompt", F.concat(F.lit("Which of these names mean the same? Answer with JSON lists of names.\n"), "text"))
        said = models.map_model(asked, self.engine.model, "resolve", ["topic", "batch"], seconds=RESOLVE_SECONDS)
        groups = said.select("topic", "batch", F.posexplode(F.from_json(T.json_block(T.without_fence(F.coalesce("answer", F.lit("")))), "array<array<string>>")).alias("place", "g"))
        return dedup.decided_aliases(groups, asked_for if nodes is None else nodes)

    # Views

    def connected(self) -> DataFrame:
        """Nodes with degree and community."""
        return graph.with_degree(self.table("nodes"), self.table("edges")).join(self.table("node_community"), ["topic", "id"], "left")

    def index(self) -> DataFrame:
        """The entity index: nodes with degree, community, a type in any case, and the first line of the description."""
        return index.entity_index(self.connected())

    def index_markdown(self) -> str:
        idx = self.index()
        lines = index.index_lines(idx).orderBy("section", "place")
        by_type: dict[str, list[str]] = {}
        for r in lines.toLocalIterator():  # a page for people to read
            by_type.setdefault(r["section"], []).append(r["line"])
        hubs = graph.top_hubs(self.table("nodes"), self.table("edges")).orderBy("place").collect()  # at most 15 rows
        n = sum(map(len, by_type.values()))
        n_comm = idx.where("community is not null").select("community").distinct().count()
        out = [f"# Graph index — {self.name}", "", f"_{n} entities · {len(by_type)} types · {n_comm} communities_", ""]
        if hubs:
            out += ["## Top hubs", "", *[f"- **{h['name']}** ({h['type']}) — {h['degree']} connections" for h in hubs], ""]
        out.append("## By type")
        for t in sorted(by_type):
            out += ["", f"### {t} ({len(by_type[t])})", *by_type[t]]
        return "\n".join(out) + "\n"

    def digest(self, most: int = 120) -> str:
        idx = self.index()
        types = index.digest(idx, most).orderBy("type").collect()  # one row per type
        hubs = graph.top_hubs(self.table("nodes"), self.table("edges"), 8).orderBy("place").collect()
        head = [f"Graph contains {idx.count()} entities across {len(types)} types."]
        if hubs:
            head.append("Most connected: " + ", ".join(f"{h['name']} ({h['type']})" for h in hubs) + ".")
        return "\n".join(head + [t["line"] for t in types])

    def graph(self) -> dict:
        """Nodes and links of the undirected graph for drawing, oriented by the order of the nodes."""
        nodes = self.table("nodes")
        order = nodes.select("topic", "id", "ord")
        links = graph.undirected(graph.valid_edges(self.table("edges"), nodes))
        links = links.join(order.select("topic", F.col("id").alias("a"), F.col("ord").alias("oa")), ["topic", "a"]).join(order.select("topic", F.col("id").alias("b"), F.col("ord").alias("ob")), ["topic", "b"])
        first = F.struct("oa", "a") <= F.struct("ob", "b")
        links = links.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("source"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("target"), "label", "description")
        drawn = nodes.orderBy("ord", "id").select("id", F.col("name").alias("label"), "type", "description")
        return {"nodes": [r.asDict() for r in drawn.collect()], "links": [r.asDict() for r in links.orderBy("source", "target").collect()], "communities": self.table("community_summaries").count()}

    def health(self) -> dict:
        rows = graph.health_report(self.table("nodes"), self.table("edges"), self.table("node_community")).collect()
        if not rows:
            return {"entities": 0, "edges": 0, "communities": 0, "orphans": 0, "dangling": 0, "typed_ratio": 0.0, "orphan_names": []}
        sound = graph.edge_ends(graph.valid_edges(self.table("edges"), self.table("nodes")))
        lone = self.table("nodes").join(sound.distinct(), ["topic", "id"], "left_anti").orderBy("ord").limit(20).collect()
        return {k: v for k, v in rows[0].asDict().items() if k != "topic"} | {"orphan_names": [r["id"] for r in lone]}

    def node(self, node_id: str, generate: bool = False, force: bool = False) -> dict:
        """A node with its neighbours, and its article, written now if asked for."""
        found = self.connected().where(F.col("id") == node_id).collect()
        if not found:
            raise KeyError(node_id)
        near = graph.neighbours(self.table("edges"), self.table("nodes")).where(F.col("id") == node_id)
        lines = index.wiki_context(near).orderBy(F.desc("direction"), "place").collect()  # at most 50 rows
        kept = self.table("articles").where(F.col("id") == node_id).collect()
        article = kept[0]["article"] if kept else None
        if generate and (force or not article):
            summary = self.table("community_summaries").where(F.col("community") == found[0]["community"]).collect()
            text = "\n\n".join([found[0]["description"] or node_id, "\n".join(r["line"] for r in lines) or "No relationships.", summary[0]["summary"] if summary else "No cluster."])
            had, article = article, models.complete(self.engine.model, "article", f"Write three paragraphs about {node_id}.\n\n{text}", text=text)
            new = self.spark.createDataFrame([(self.name, node_id, article)], TABLES["articles"])
            if had is None:
                self.store.append("articles", new)
            else:
                self.save("articles", self.table("articles").where(F.col("id") != node_id).unionByName(new))
        return found[0].asDict() | {"outgoing": [r["line"] for r in lines if r["direction"] == "out"], "incoming": [r["line"] for r in lines if r["direction"] == "in"], "article": article}

    def notes(self) -> DataFrame:
        """``stem, body`` of one Markdown note per node, with front matter, description, article, cluster and links."""
        nodes, edges = self.connected(), self.table("edges")
        stems = index.file_stems(nodes)
        near = graph.neighbours(edges, nodes, loops_once=False).join(stems.select("topic", F.col("id").alias("other"), "stem"), ["topic", "other"], "left")
        link = F.when(F.col("stem").isNotNull(), F.concat(F.lit("[["), "stem", F.lit("|"), "other", F.lit("]]"))).otherwise(F.concat(F.lit("`"), "other", F.lit("`")))
        line = F.concat(F.lit("- **"), "label", F.lit("** → "), link, F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(" — "), "description")).otherwise(""))
        parts = lambda d: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("direction") == d, F.struct("ord", "line")))), lambda x: x.line), "\n")
        links = near.withColumn("line", line).groupBy("topic", "id").agg(parts("out").alias("outgoing"), parts("in").alias("incoming"))
        all_ = nodes.join(stems, ["topic", "id"]).join(links, ["topic", "id"], "left").join(self.table("articles"), ["topic", "id"], "left").join(self.table("community_summaries").drop("ord"), ["topic", "community"], "left")
        kind = F.when(F.coalesce("type", F.lit("")) == "", "OTHER").otherwise(F.col("type"))
        files = F.when(F.size("sources") > 0, F.concat(F.lit("sources:\n"), F.array_join(F.transform("sources", lambda s: F.concat(F.lit("  - "), s)), "\n")))
        front = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("id: "), "id"), F.concat(F.lit("type: "), kind), F.concat(F.lit("degree: "), F.col("degree").cast("string")), F.concat(F.lit("community: "), "community"), files, F.concat(F.lit("topic: "), "topic"), F.concat(F.lit("tags: [graph, "), F.lower(kind), F.lit("]")), F.lit("---"))
        section = lambda title, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(title, F.lit("\n\n"), c, F.lit("\n")))
        body = F.concat_ws(
            "\n", F.concat(F.lit("# "), "name", F.lit("\n")), F.when(F.coalesce(F.trim("description"), F.lit("")) != "", F.concat(F.trim("description"), F.lit("\n"))), section(F.lit("## Article"), F.trim("article")),
            section(F.concat(F.lit("## Cluster context (community "), F.coalesce("community", F.lit("")), F.lit(")")), F.trim("summary")), section(F.lit("## Outgoing relationships"), F.col("outgoing")), section(F.lit("## Incoming relationships"), F.col("incoming")),
        )
        return all_.select("stem", F.concat(front, F.lit("\n\n"), body).alias("body"))

    def export_vault(self, target: str) -> int:
        """Writes the notes and an overview into a folder and returns how many notes there are."""
        out = Path(target)
        out.mkdir(parents=True, exist_ok=True)
        return self._export(lambda name, body: (out / name).write_text(body, encoding="utf-8"))

    def export_zip(self, path: str) -> int:
        """The same as one archive."""
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            return self._export(lambda name, body: z.writestr(f"{self.name}/{name}", body))

    def _export(self, put) -> int:
        """Gives every note to ``put``; notes come a partition at a time, so the driver never holds the graph."""
        n = 0
        for r in self.notes().toLocalIterator():
            put(f"{r['stem']}.md", r["body"])
            n += 1
        hubs = graph.top_hubs(self.table("nodes"), self.table("edges")).join(index.file_stems(self.table("nodes")), ["topic", "id"]).orderBy("place").collect()
        types = index.type_counts(self.table("nodes")).orderBy("type").collect()
        lines = [f"# {self.name}", "", f"_{n} entity notes · {self.table('community_summaries').count()} communities_", "", "## Top hubs", ""]
        lines += [f"- [[{h['stem']}|{h['name']}]] ({h['type']}) — {h['degree']} connections" for h in hubs] + ["", "## By type", ""]
        lines += [f"- **{t['type']}** — {t['n_entities']} entities" for t in types] + [""]
        put("_index.md", "\n".join(lines))
        return n

    # Questions

    def sync_vectors(self) -> None:
        """Brings the stored vectors of summaries up to date: only new and changed ones are encoded."""
        if not self.engine.embedder:
            return
        live = self.table("community_summaries").select("topic", "community", F.col("summary").alias("text"))
        cached = self.table("community_vectors").where(F.col("model") == self.engine.embedder.name)
        plan = self._scratch().write(incremental.cache_sync(live, cached, ["topic", "community"]), "plan")
        keep = cached.join(plan.where("action = 'keep'"), ["topic", "community"], "left_semi")
        todo = live.join(plan.where("action = 'encode'"), ["topic", "community"], "left_semi")
        new = models.embed(todo, self.engine.embedder, ["topic", "community"]).join(todo, ["topic", "community"]).select("topic", "community", F.sha1(F.col("text").cast("binary")).alias("sha1"), "vec", F.lit(self.engine.embedder.name).alias("model"))
        self.save("community_vectors", keep.unionByName(new))

    def candidates(self, question: str, k: int = 15) -> DataFrame:
        """``topic, community, summary, total``: the communities worth asking, best first."""
        summaries = self.table("community_summaries")
        q = self.spark.createDataFrame([(0, question)], "qid long, question string")
        wanted = search.question_keywords(q)
        hits = search.keyword_hits(summaries.select("topic", "community", F.col("summary").alias("text")), wanted, ["topic", "community"])
        bonus = search.entity_bonus(self.index(), wanted)
        similar = None
        if self.engine.embedder:
            self.sync_vectors()
            v = self.engine.embedder.encode([question])[0]
            similar = self.table("community_vectors").select(F.lit(0).cast("long").alias("qid"), "topic", "community", T.dot(F.col("vec"), F.array(*map(F.lit, v))).alias("similarity"))
        best = search.candidates(hits, bonus, similar, k).join(summaries.drop("ord"), ["topic", "community"]).select("topic", "community", "summary", "total", "place")
        best = self._scratch().write(best, "best")
        if not best.isEmpty():
            return best.orderBy("place")
        return summaries.orderBy("ord").limit(k).select("topic", "community", "summary", F.lit(0.0).alias("total"), F.col("ord").alias("place"))

    def _relevant(self, question: str) -> tuple[int, list]:
        best = self._scratch().write(self.candidates(question), "asked")
        asked = best.select("topic", "community", F.col("summary").alias("text"), F.lit(question).alias("question"), F.concat(F.lit(f"Answer from this summary only, or with {T.NO_INFO}.\n\n"), "summary", F.lit(f"\n\nQuestion: {question}")).alias("prompt"))
        said = models.map_model(asked, self.engine.model, "relevance", ["topic", "community"]).where(T.informative(F.col("answer")))
        rows = said.join(best, ["topic", "community"]).orderBy("place").collect()  # at most 15 rows
        return best.count(), rows

    def _names(self) -> str:
        return "\n".join(h["name"] for h in graph.top_hubs(self.table("nodes"), self.table("edges"), 120).orderBy("place").collect())

    def ask_stream(self, question: str, mode: str = "graph") -> Iterator[dict]:
        """Events of an answer: status, meta, tokens, possibly a replacement, done."""
        if self.table("community_summaries").isEmpty():
            yield {"type": "meta", "communities_checked": 0, "relevant_communities": 0, "sources": []}
            yield {"type": "token", "text": NO_SUMMARIES}
            yield {"type": "done"}
            return
        checked, rows = self._relevant(question)
        yield {"type": "status", "message": f"Checking {checked} communities..."}
        yield {"type": "meta", "communities_checked": checked, "relevant_communities": len(rows), "sources": [{"id": r["community"], "summary": r["summary"]} for r in rows]}
        if not rows and mode != "extended":
            yield {"type": "token", "text": NOT_ENOUGH}
            yield {"type": "done"}
            return
        answers = "\n\n---\n\n".join(r["answer"] for r in rows)
        prompt = f"Question: {question}\n\n{self.digest()}\n\nEvidence:\n{answers}\n\nCite entities as [[name]]." + ("" if mode == "graph" else " You may add what you know, marked as such.")
        raw = ""
        try:
            for piece in models.stream(self.engine.model, "answer", prompt, text=answers.replace("---", ""), names=self._names()):
                raw += piece
                yield {"type": "token", "text": piece}
        except Exception:  # the relevant answers stand for the one that failed
            said, raw = raw, "\n\n".join(r["answer"] for r in rows)
            yield {"type": "replace" if said else "token", "text": raw}
        if mode == "graph":
            clean = self.spark.createDataFrame([(raw,)], "t string").select(T.enforce_citations(F.col("t")).alias("t")).first()["t"]
            if clean != raw.strip():
                yield {"type": "replace", "text": clean}
        yield {"type": "done"}

    def ask(self, question: str, mode: str = "graph") -> dict:
        task = self.engine.running.get(self.name)
        if task and task["status"] in ("building", "merging"):
            raise Busy(f"{self.name} is {task['status']}")
        out = {"answer": "", "communities_checked": 0, "relevant_communities": 0, "sources": []}
        for event in self.ask_stream(question, mode):
            if event["type"] == "meta":
                out.update({k: v for k, v in event.items() if k != "type"})
            elif event["type"] == "token":
                out["answer"] += event["text"]
            elif event["type"] == "replace":
                out["answer"] = event["text"]
        return out

    def blog(self, ideas: str, outline: str = "", length: str = "medium") -> str:
        return "".join(self.blog_stream(ideas, outline, length)).strip()

    def blog_stream(self, ideas: str, outline: str = "", length: str = "medium") -> Iterator[str]:
        """A post piece by piece, as the model writes it."""
        words = {"short": 500, "medium": 1000, "long": 1800}.get(length, 1000)
        lines = index.blog_context(self.index(), graph.valid_edges(self.table("edges"), self.table("nodes"))).orderBy("part", "place").collect()  # at most 70 rows and the files of 30 nodes
        told = index.blog_communities(self.table("community_summaries")).orderBy("place").collect()  # at most 20 rows
        part = lambda rows, none: "\n".join(r["line"] for r in rows) or none
        pieces = [ideas, outline, part(told, "No community summaries available.")]
        pieces += [part([r for r in lines if r["part"] == p], none) for p, none in (("entity", "No entity data available."), ("relation", "No relationship data available."), ("source", ""))]
        text = "\n\n".join(pieces)
        yield from models.stream(self.engine.model, "article", f"Write a post of about {words} words.\n\n{text}", text=text)

    # Pins

    def pins(self) -> list[dict]:
        return [r.asDict() for r in self.table("pinned").orderBy(F.desc("created_at"), F.desc("id")).collect()]

    def pin(self, question: str, answer: str, mode: str = "graph") -> str:
        if not question.strip() or not answer.strip():
            raise ValueError("a pin needs a question and an answer")
        row = (uuid.uuid4().hex, question.strip(), answer.strip(), mode, time.time_ns())
        self.store.append("pinned", self.spark.createDataFrame([row], TABLES["pinned"]))
        return row[0]

    def unpin(self, pin_id: str) -> None:
        rest = self.table("pinned").where(F.col("id") != pin_id)
        if rest.count() == self.table("pinned").count():
            raise KeyError(pin_id)
        self.save("pinned", rest)

    def export_json(self, path: str) -> None:
        """The graph for drawing, as one JSON file."""
        Path(path).write_text(json.dumps(self.graph(), ensure_ascii=False), encoding="utf-8")
