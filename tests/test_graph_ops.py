import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import closure, community, dedup, graph, incremental, index, search, upsert

EDGE = "topic string, src string, label string, dst string, description string, ord long"


def edges(spark, rows):
    return spark.createDataFrame([("t", a, lab, b, d, i) for i, (a, lab, b, d) in enumerate(rows)], EDGE)


def nodes(spark, rows):
    return spark.createDataFrame([("t", n, n, k, d, list(s), i) for i, (n, k, d, s) in enumerate(rows)], "topic string, id string, name string, type string, description string, sources array<string>, ord long")


TOY = [("a", "R", "b", "1"), ("a", "S", "b", "2"), ("b", "R", "a", "3"), ("c", "R", "c", ""), ("a", "R", "x", "")]


def test_degree_and_collapse(spark):
    e = edges(spark, TOY)
    assert {r["id"]: r["degree"] for r in graph.degrees(e).collect()} == {"a": 4, "b": 3, "c": 2, "x": 1}
    assert [(r["a"], r["b"], r["label"], r["n_edges"]) for r in graph.undirected(e).orderBy("b").collect()] == [("a", "b", "R", 3), ("a", "x", "R", 1)]
    h = graph.health_report(nodes(spark, [("a", "P", "", []), ("b", "OTHER", "", []), ("c", "", "", []), ("d", "P", "", [])]), e, spark.createDataFrame([("t", "a", "1")], "topic string, id string, community string")).first()
    assert (h["edges"], h["dangling"], h["orphans"], h["typed_ratio"], h["communities"]) == (5, 1, 1, 0.5, 1)


def test_upsert_fold(spark):
    rows = [("t", "n", "n", k, d, s, i) for i, (k, d, s) in enumerate([("A", "one", "f"), ("B", "two", "g"), ("A", "one", "f"), ("A", "two more", ""), ("A", None, "h"), ("A", "", "g")])]
    out = upsert.upsert_nodes(spark.createDataFrame(rows, "topic string, id string, name string, type string, description string, source string, ord long")).first()
    assert (out["type"], out["description"], out["sources"]) == ("A", "one two two more", ["f", "g", "h"])


def test_remove_sources(spark):
    n = nodes(spark, [("a", "", "", ["f"]), ("b", "", "", ["f", "g"]), ("c", "", "", [])])
    alive, rest = upsert.remove_sources(n, edges(spark, [("a", "R", "b", ""), ("b", "R", "c", "")]), spark.createDataFrame([("t", "f")], "topic string, source string"))
    assert {r["id"]: (r["sources"], r["trimmed"]) for r in alive.collect()} == {"b": (["g"], True), "c": ([], False)}
    assert [(r["src"], r["dst"]) for r in rest.collect()] == [("b", "c")]


def test_closure_on_chains_and_cycles(spark):
    rng = random.Random(5)
    names = [f"v{i:03}" for i in range(60)]
    rng.shuffle(names)
    pairs = list(zip(names[:39], names[1:40])) + [(names[41], names[42]), (names[42], names[43]), (names[43], names[41]), (names[50], names[50])]
    group = {n: n for n in {x for p in pairs for x in p}}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            m = min(group[a], group[b])
            changed |= group[a] != m or group[b] != m
            group[a] = group[b] = m
    got = dedup.closure(spark.createDataFrame([("t", a, b) for a, b in pairs], "topic string, a string, b string"))
    assert {r["id"]: r["root"] for r in got.collect()} == group


def test_deduplicate_is_idempotent_and_follows_aliases(spark):
    n = nodes(spark, [("Media Mix Modelling", "C", "x", ["f"]), ("media mix modeling", "C", "y", ["g"]), ("ROAS", "C", "", []), ("Return On Ads Spend", "C", "long", ["h"]), ("Facebook", "O", "old", []), ("Meta", "O", "new", []), ("東京", "L", "", []), ("大阪", "L", "", [])])
    e = edges(spark, [("ROAS", "R", "Return On Ads Spend", ""), ("Facebook", "R", "ROAS", "d"), ("Meta", "R", "Return On Ads Spend", "d")])
    aliases = spark.createDataFrame([("t", "Facebook", "Meta", "ontology", None)], "topic string, alias string, canonical string, origin string, learned_at timestamp")
    merged, new_edges, mapping = dedup.deduplicate(n, e, graph.degrees(e), aliases)
    ids = {r["id"] for r in merged.collect()}
    assert len(ids) == 5 and {"Meta", "東京", "大阪"} <= ids
    assert all(r["src"] != r["dst"] for r in new_edges.collect()) and new_edges.count() == 1
    again, _, second = dedup.deduplicate(merged.drop("grown"), new_edges, graph.degrees(new_edges), aliases)
    assert second.count() == 0 and {r["id"] for r in again.collect()} == ids


def test_resolver_batches(spark):
    rows = [(f"n{i:03}", "T", "d" * (3000 if i == 30 else 10), []) for i in range(60)]
    got = {r["id"]: r["batch"] for r in dedup.resolver_batches(nodes(spark, rows)).collect()}
    batch, lines, used, want = 1, 0, 0, {}
    for name, kind, text, _ in rows:
        n = len(f"- {name} ({kind}): {text}")
        if lines and (lines >= 25 or used + n > 6000):
            batch, lines, used = batch + 1, 0, 0
        lines, used = lines + 1, used + n
        want[name] = batch
    assert got == want


def test_communities(spark):
    pairs = []
    for c in range(5):
        v = [f"{c}{i}" for i in range(7)]
        pairs += [(a, b) for i, a in enumerate(v) for b in v[i + 1 :]]
        pairs.append(tuple(sorted((f"{c}0", f"{(c + 1) % 5}1"))))
    df = spark.createDataFrame([("t", a, b) for a, b in pairs], "topic string, a string, b string")
    got = {r["id"]: r["community"] for r in community.detect_communities(df).collect()}
    assert len(got) == 35 and Counter(got.values()) == {f"{c}0": 7 for c in range(5)}
    assert community.modularity(pairs, got) > 0.6


def test_communities_do_not_depend_on_what_a_task_may_hold(spark, monkeypatch):
    """A clique, a star, a chain of cliques and a random graph, in tasks of at most 40 edges and all at once: the same rows."""
    rng = random.Random(5)
    rows = [("clique", f"k{i:02}", f"k{j:02}") for i in range(30) for j in range(i)] + [("star", "hub", f"l{i:03}") for i in range(60)]
    for c in range(6):
        rows += [("chain", f"{c}{i}", f"{c}{j}") for i in range(6) for j in range(i)] + [("chain", f"{c - 1}0", f"{c}1")] * (c > 0)
    rows += [("random", *rng.sample([f"n{i:02}" for i in range(40)], 2)) for _ in range(80)]
    rows = sorted({(t, min(a, b), max(a, b)) for t, a, b in rows})
    df = spark.createDataFrame(rows, "topic string, a string, b string")
    at_once = sorted(map(tuple, community.detect_communities(df).collect()))
    by_tables, held = [], community.leiden_rounds
    monkeypatch.setattr(community, "leiden_rounds", lambda scratch, pairs, seed: by_tables.append({r["topic"] for r in pairs.select("topic").distinct().collect()}) or held(scratch, pairs, seed))
    assert sorted(map(tuple, community.detect_communities(df, most_edges=40).collect())) == at_once
    assert by_tables[0] == {"clique", "star", "chain", "random"}  # no task held any of them
    got = {(t, i): c for t, i, c, _ in at_once}
    assert {c for (t, _), c in got.items() if t == "clique"} == {"k00"} and {c for (t, _), c in got.items() if t == "star"} == {"hub"}
    assert all(got["chain", f"{c}{i}"] == f"{c}0" for c in range(6) for i in range(6))
    # Every node once, and each community connected.
    assert len(got) == len(at_once) and set(got) == {(t, x) for t, a, b in rows for x in (a, b)}
    inner = spark.createDataFrame([r for r in rows if got[r[0], r[1]] == got[r[0], r[2]]], "topic string, a string, b string")
    parts = {(r["topic"], r["id"]): r["root"] for r in closure.closure(inner).collect()}
    assert all(parts.get(k, k[1]) == c for k, c in got.items())


def test_leiden_goes_on_from_the_communities_it_found(monkeypatch):
    """After a contraction the moves start from the coarse communities, not from single nodes; the result is a good one."""
    rng = random.Random(2)
    block = {f"{i:03}": i // 20 for i in range(200)}
    names = sorted(block)
    pairs = [(a, b) for a in names for b in names if a < b and rng.random() < (0.35 if block[a] == block[b] else 0.01)]
    number = {v: n for n, v in enumerate(names)}
    a, b = (np.array([number[p[k]] for p in pairs]) for k in (0, 1))
    h = np.array([zlib.crc32(v.encode()) << 20 | zlib.crc32(v[::-1].encode()) >> 12 for v in names], np.int64)
    starts, plain = [], community.moved
    monkeypatch.setattr(community, "moved", lambda *x: starts.append((x[6].copy(), x[7] if len(x) > 7 else None)) or plain(*x))
    found = community.leiden(np.zeros(200, np.int64), h, a, b)
    later = [s for s, bound in starts if bound is None][1:]
    assert later and any((s != np.arange(200)).any() for s in later)
    planted = community.modularity(pairs, {v: str(c) for v, c in block.items()})
    assert community.modularity(pairs, {v: str(found[number[v]]) for v in names}) >= 0.95 * planted


def test_keywords_inside_words(spark):
    q = spark.createDataFrame([(1, "How does carryover react to cinema?"), (2, "xyz nothing")], "qid long, question string")
    texts = spark.createDataFrame([("t", "1", "Carryovers of the cinemas"), ("t", "2", "cinema"), ("t", "3", "none")], "topic string, community string, text string")
    wanted = search.question_keywords(q)
    plain = sorted(map(tuple, search.keyword_hits(texts, wanted, ["topic", "community"]).collect()))
    assert plain == [(1, "t", "1", 2), (1, "t", "2", 1)]


def test_vector_topk_in_blocks(spark):
    rng = random.Random(1)
    vecs = [(i, [rng.random() for _ in range(4)]) for i in range(50)]
    v = spark.createDataFrame(vecs, "vec_id long, vec array<double>")
    q = v.where("vec_id % 10 = 0").select(F.col("vec_id").alias("qid"), "vec")
    one, many = (sorted(map(tuple, search.vector_topk(q, v, 3, b).collect())) for b in (64 << 20, 64))
    assert one == many and len(one) == 15
    best = {i: sorted(((-round(sum(a * b for a, b in zip(x, y)), 6), j) for j, y in vecs if i != j))[:3] for i, x in vecs if i % 10 == 0}
    assert [(r[0], r[1]) for r in sorted(one, key=lambda r: (r[0], r[3]))] == [(i, j) for i in sorted(best) for _, j in best[i]]


def test_incremental(spark):
    f = "topic string, filename string, mtime double"
    diff = incremental.manifest_diff(spark.createDataFrame([("t", "a", 2.0), ("t", "b", 1.0), ("t", "n", 1.0)], f), spark.createDataFrame([("t", "a", 1.0), ("t", "b", 1.0), ("t", "x", 1.0)], f))
    assert {r["filename"]: r["change"] for r in diff.collect()} == {"a": "changed", "b": "unchanged", "n": "changed", "x": "removed"}


def test_label_lookup(spark):
    n = nodes(spark, [("Media Mix", "", "", []), ("media", "", "", []), ("Mixed Media", "", "", [])])
    labels = spark.createDataFrame([("t", "MEDIA"), ("t", "mix"), ("t", "none")], "topic string, label string")
    assert {r["label"]: r["id"] for r in index.lookup_label(labels, n).collect()} == {"MEDIA": "media", "mix": "Media Mix"}


def test_places_of_a_hot_group(spark):
    from tessera.operators.ranking import placed

    rows = [("hot", i % 97, i) for i in range(2000)] + [(None, 1, 5000), (None, 0, 5001), ("cold", 3, 6000)]
    df = spark.createDataFrame(rows, "topic string, k int, i int").repartition(5)
    got = {r["i"]: r["place"] for r in placed(df, ["topic"], [F.col("k"), F.desc("i")]).collect()}
    for t in ("hot", None, "cold"):
        for n, (_, _, i) in enumerate(sorted((r for r in rows if r[0] == t), key=lambda r: (r[1], -r[2])), 1):
            assert got[i] == n


def test_closure_of_an_ordered_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    plain = closure.rewritten
    monkeypatch.setattr(closure, "rewritten", lambda *a: rounds.append(1) or plain(*a))
    chain = [("t", f"n{i:05}", f"n{i + 1:05}") for i in range(3000)]
    got = closure.closure(spark.createDataFrame(chain, "topic string, a string, b string"))
    assert {r["root"] for r in got.collect()} == {"n00000"} and got.count() == 3001
    assert len(rounds) <= 14
