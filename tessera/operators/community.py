"""Community detection on the undirected simple graph: size-capped hierarchical Leiden.

One algorithm is used at every size.  Nodes move in rounds to the neighbouring community that gains most modularity, in each
round a hashed half of them; communities are refined from single nodes within their own bounds by the same moves; the refined
parts are contracted, all edges between them kept as weights, and the moves go on from the communities found before
(Traag, Waltman, van Eck 2019).  Connected parts of more than ``cap`` members are split again.  All quantities that decide
are whole numbers and every tie is broken by a hash, so a result depends on the graph and the seed only.

Two executors run it with the same outcome, row for row: on arrays for many graphs at once inside a task, and on
DataFrames.  ``most_edges`` says which graphs a task may hold: only graphs of at most that many edges reach one, which
splits what it has gathered as soon as that many edges are there, so it holds at most about twice as many and one Arrow
batch; larger graphs go by DataFrames until their communities fit.  The bound changes where work is done, not what comes out.  Rounds are written to the shared folder; only counts reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.closure import closure
from tessera.session import Scratch

DEPTH = 12  # levels of splitting
PAIRS_OF_ROUNDS = 12  # both halves of the nodes move in each pair
OUT = "topic string, id string, community string, level int"
GRAPH = ["topic", "root"]


# On arrays.  Graphs are numbered, nodes are numbered in the order of graph and name, so comparing numbers compares names.


def _gathered(keys: tuple[np.ndarray, ...], values: np.ndarray) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """Sums of values by equal keys, keys in order."""
    if not len(values):
        return keys, values
    order = np.lexsort(keys[::-1])
    keys = tuple(k[order] for k in keys)
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return tuple(k[new] for k in keys), np.add.reduceat(values[order], np.flatnonzero(new))


def _active(h: np.ndarray, r: int) -> np.ndarray:
    return (h >> (r // 2 % 48)) & 1 == r % 2


def moved(a, b, w, h, k, total, part, bound=None) -> np.ndarray:
    """Parts after rounds of local moving.

    a, b, w: edges from both ends; h, k, total: hash, strength and strength of the graph of each node; ``part`` holds the number of
    one of its nodes for each community.  ``bound``: a coarser partition that no community may cross.
    """
    part, n = part.copy(), len(part)
    if bound is not None:
        inner = bound[a] == bound[b]
        a, b, w = a[inner], b[inner], w[inner]
    quiet = 0
    for r in range(2 * PAIRS_OF_ROUNDS):
        quiet = 0 if r % 2 == 0 else quiet
        volume = np.bincount(part, weights=None, minlength=n) * 0
        np.add.at(volume, part, k)
        on = _active(h, r)
        use = on[a]
        stay = np.flatnonzero(on)
        (v, c), links = _gathered((np.r_[a[use], stay], np.r_[part[b[use]], part[stay]]), np.r_[w[use], np.zeros(len(stay), np.int64)])
        same = c == part[v]
        gain = links * total[v] - k[v] * (volume[c] - np.where(same, k[v], 0))
        order = np.lexsort((c, h[c], same, gain, v))
        last = order[np.r_[v[order][1:] != v[order][:-1], True]] if len(order) else order
        changed = part[v[last]] != c[last]
        part[v[last]] = c[last]
        quiet += int(not changed.any())
        if quiet == 2:
            break
    return part


def connected(n: int, a, b) -> np.ndarray:
    """The least node of each node's component."""
    least = np.arange(n)
    while True:
        low = np.minimum(least[a], least[b])
        new = least.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, least[a], low)
        np.minimum.at(new, least[b], low)
        new = new[new]
        if (new == least).all():
            return least
        least = new


def leiden(g, h, a, b) -> np.ndarray:
    """Communities of many graphs at once: for each node the least node of its community, which is connected.

    g, h: graph and hash of each node; a, b: edges, once each.
    """
    n = len(g)
    at, live = np.arange(n), np.arange(n)  # the node of the contracted graph that each node lies in; nodes of the graphs not yet done
    final = np.arange(n)
    ends = np.r_[a, b], np.r_[b, a]
    ea, eb, ew = ends[0], ends[1], np.ones(2 * len(a), np.int64)
    k = np.bincount(ea, minlength=n).astype(np.int64)
    total = np.zeros(int(g.max()) + 1 if n else 0, np.int64)
    np.add.at(total, g, k)
    start = np.arange(n)
    while len(ea):
        coarse = moved(ea, eb, ew, h, k, total[g], start)
        refined = moved(ea, eb, ew, h, k, total[g], np.arange(n), coarse)
        final[live] = coarse[at[live]]
        # A graph in which nothing merges is done; the others are contracted by the refined parts.
        nodes = np.unique(at[live])
        merged = np.zeros(len(total), bool)
        merged[g[nodes[refined[nodes] != nodes]]] = True
        live = live[merged[g[live]]]
        keep = merged[g[ea]]
        (ea, eb), ew = _gathered((refined[ea[keep]], refined[eb[keep]]), ew[keep])
        outer = ea != eb
        ea, eb, ew = ea[outer], eb[outer], ew[outer]
        strength = np.zeros(n, np.int64)
        np.add.at(strength, refined[nodes], k[nodes])
        k, at = strength, np.where(merged[g], refined[at], at)
        start = np.arange(n)
        start[refined[nodes]] = _representative(refined[nodes], coarse[nodes], n)
    inner = final[a] == final[b]
    return connected(n, a[inner], b[inner])


def _representative(refined: np.ndarray, coarse: np.ndarray, n: int) -> np.ndarray:
    """For each node's coarse community the least refined part in it, which names it in the contracted graph."""
    least = np.full(n, n)
    np.minimum.at(least, coarse, refined)
    return least[coarse]


def split_graphs(g: np.ndarray, names: list[str], h: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int, level: int, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Final community, as the number of its least node, and level of each node; parts above ``cap`` are split until Leiden splits no more."""
    n = len(g)
    community, levels, group = np.zeros(n, np.int64), np.zeros(n, np.int64), g.copy()
    open_ = np.arange(n)
    while len(open_):
        number = np.full(n, -1)
        number[open_] = np.arange(len(open_))
        _, dense = np.unique(group[open_], return_inverse=True)
        found = leiden(dense, h[open_], number[a], number[b])
        part = open_[found]
        size = np.bincount(found, minlength=len(open_))[found]
        parts = np.zeros(int(dense.max()) + 1, np.int64)
        np.add.at(parts, dense[np.unique(found)], 1)
        again = (size > cap) & (parts[dense] > 1) & (level < depth)
        community[open_], levels[open_], group[open_] = part, level, part
        same = group[a] == group[b]
        keep = np.zeros(n, bool)
        keep[open_[again]] = True
        use = same & keep[a]
        a, b, open_, level = a[use], b[use], open_[again], level + 1
    return community, levels


def modularity(pairs: list[tuple[str, str]], part: dict[str, str]) -> float:
    """Modularity of a partition of one graph, given by its edges."""
    m, inside, degree = len(pairs), {}, {}
    for a, b in pairs:
        for x in (a, b):
            degree[part[x]] = degree.get(part[x], 0) + 1
        if part[a] == part[b]:
            inside[part[a]] = inside.get(part[a], 0) + 1
    return sum(inside.get(c, 0) / m - (d / (2 * m)) ** 2 for c, d in degree.items()) if m else 0.0


def _clusterer(cap: int, level: int, most_edges: int):
    """Streams a sorted partition; whole graphs are gathered until ``most_edges`` edges are there, then split together."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        t, r = rows["topic"].to_numpy(object), rows["root"].to_numpy(object)
        new = np.r_[True, (t[1:] != t[:-1]) | (r[1:] != r[:-1])]
        graph = np.cumsum(new) - 1
        ends = pd.DataFrame({"g": np.r_[graph, graph], "id": np.r_[rows["a"].to_numpy(object), rows["b"].to_numpy(object)], "h": np.r_[rows["ha"].to_numpy(np.int64), rows["hb"].to_numpy(np.int64)]})
        nodes = ends.drop_duplicates(["g", "id"])
        # Python compares strings by code point, as Spark does.
        nodes = nodes.iloc[sorted(range(len(nodes)), key=list(zip(nodes["g"], nodes["id"])).__getitem__)].reset_index(drop=True)
        number = {x: n for n, x in enumerate(zip(nodes["g"], nodes["id"]))}
        a, b = (np.array([number[x] for x in zip(graph, rows[c])], np.int64) for c in "ab")
        g, names = nodes["g"].to_numpy(np.int64), nodes["id"].to_numpy(object)
        community, levels = split_graphs(g, names, nodes["h"].to_numpy(np.int64), a, b, cap, level)
        return pd.DataFrame({"topic": t[np.flatnonzero(new)][g], "id": names, "community": names[community], "level": levels.astype(np.int32)})

    def cluster(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            # The last graph may go on in the next batch; what is complete is split once there is enough of it.
            last = (held["topic"].to_numpy(object) == held["topic"].iat[-1]) & (held["root"].to_numpy(object) == held["root"].iat[-1])
            if (~last).sum() >= most_edges:
                yield solve(held[~last].reset_index(drop=True))
                held = held[last].reset_index(drop=True)
        if held is not None and len(held):
            yield solve(held)

    return cluster


# On DataFrames.


def hashed(name: str, seed: int):
    """What decides when a node moves and which of two equal gains is taken: 62 bits of its name."""
    return F.xxhash64(F.col(name), F.lit(seed)).bitwiseAND(F.lit((1 << 62) - 1))


def detect_communities(undirected: DataFrame, cap: int = 10, seed: int = 42, most_edges: int = 200_000) -> DataFrame:
    """``topic, id, community, level`` of every node that has an edge; isolated nodes have no community.

    undirected: ``topic, a, b`` with ``a < b``, one row per pair.  A community is named after its smallest member.
    ``most_edges``: edges of one graph that a task may hold; results do not depend on it.
    """
    scratch = Scratch(undirected.sparkSession, "communities")
    pairs = scratch.write(undirected.select("topic", "a", "b"), "pairs")
    placed = pairs.join(closure(pairs).select("topic", F.col("id").alias("a"), "root"), ["topic", "a"])
    out, level = None, 0
    while True:
        placed = scratch.write(placed.select("topic", "root", "a", "b"), "placed")
        sizes = placed.groupBy(*GRAPH).agg(F.count("*").alias("n_edges"))
        # Large graphs are at most all edges / most_edges; they are written, not broadcast.
        large_keys = scratch.write(sizes.where(F.col("n_edges") > most_edges).select(*GRAPH), "large")
        any_large = not large_keys.isEmpty()
        small = placed.join(large_keys, GRAPH, "left_anti") if any_large else placed
        small = small.select("topic", "root", "a", "b", hashed("a", seed).alias("ha"), hashed("b", seed).alias("hb"))
        small = small.repartition(*GRAPH).sortWithinPartitions(*GRAPH, "a", "b").mapInPandas(_clusterer(cap, level, most_edges), OUT)
        out = small if out is None else out.unionByName(small)
        if not any_large:
            return out
        large = scratch.write(placed.join(large_keys, GRAPH), "large_edges")
        inner = scratch.write(_inside(large, leiden_rounds(scratch, large, seed)), "inner")
        # Communities are connected; a node without an edge inside one is a community of its own.
        nodes = large.select("topic", "root", F.explode(F.array("a", "b")).alias("id")).distinct()
        found = nodes.join(closure(inner).select("topic", "id", F.col("root").alias("community")), ["topic", "id"], "left")
        found = scratch.write(found.withColumn("community", F.coalesce("community", "id")), "found")
        n_members = found.groupBy("topic", "root", "community").agg(F.count("*").alias("n"))
        n_parts = n_members.groupBy("topic", "root").agg(F.count("*").alias("parts"))
        split_again = (F.col("n") > cap) & (F.col("parts") > 1) & F.lit(level < DEPTH)
        fate = n_members.join(n_parts, ["topic", "root"]).select("topic", "community", split_again.alias("again"))
        found = scratch.write(found.select("topic", "id", "community").join(fate, ["topic", "community"]), "fate")
        out = out.unionByName(found.where("not again").select("topic", "id", "community", F.lit(level).alias("level")))
        # Members of a community that is split again all have an edge in it, as it is a component of the inner edges.
        placed = inner.join(found.where("again").select("topic", F.col("id").alias("a"), F.col("community").alias("root")), ["topic", "a"])
        level += 1


def _inside(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """``topic, a, b``: the pairs within a part."""
    a, b = (parts.select(*GRAPH, F.col("id").alias(x), F.col("part").alias(f"part_{x}")) for x in "ab")
    return pairs.join(a, [*GRAPH, "a"]).join(b, [*GRAPH, "b"]).where("part_a = part_b").select("topic", "a", "b")


def leiden_rounds(scratch: Scratch, pairs: DataFrame, seed: int) -> DataFrame:
    """``topic, root, id, part``: communities of graphs ``topic, root, a, b``, as ``leiden`` finds them on arrays."""
    ends = F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other"))))
    edges = scratch.write(pairs.select(*GRAPH, ends.alias("e")).select(*GRAPH, "e.*", F.lit(1).cast("long").alias("w")), "edges")
    strength = edges.groupBy(*GRAPH, "id").agg(F.sum("w").alias("k"))
    total = strength.groupBy(*GRAPH).agg(F.sum("k").alias("total"))
    nodes = strength.join(total, GRAPH).withColumn("h", hashed("id", seed)).withColumn("start", F.col("id"))
    nodes = scratch.write(nodes.select(*GRAPH, "id", "k", "total", "h", "start"), "nodes")
    at = nodes.select(*GRAPH, "id", F.col("id").alias("at"))  # the node of the contracted graph that each node lies in
    done = None
    while not edges.isEmpty():
        coarse = moved_nodes(scratch, edges, nodes, seed)
        refined = moved_nodes(scratch, edges, nodes.withColumn("start", F.col("id")), seed, coarse)
        step = scratch.write(coarse.withColumnRenamed("part", "coarse").join(refined.withColumnRenamed("part", "refined"), [*GRAPH, "id"]), "step")
        at = scratch.write(at.join(step.withColumnRenamed("id", "at"), [*GRAPH, "at"]), "at")
        merged = scratch.write(step.where("refined <> id").select(*GRAPH).distinct(), "merged")
        finished = scratch.write(at.join(merged, GRAPH, "left_anti").select(*GRAPH, "id", F.col("coarse").alias("part")), "done")
        done = finished if done is None else done.unionByName(finished)
        step = step.join(merged, GRAPH)
        at = at.join(merged, GRAPH).select(*GRAPH, "id", F.col("refined").alias("at"))
        names = step.groupBy(*GRAPH, "coarse").agg(F.min("refined").alias("start"))
        heavy = nodes.join(step, [*GRAPH, "id"]).groupBy(*GRAPH, "refined", "coarse").agg(F.sum("k").alias("k"), F.max("total").alias("total"))
        heavy = heavy.join(names, [*GRAPH, "coarse"]).withColumn("h", hashed("refined", seed))
        to = step.select(*GRAPH, "id", "refined")
        contracted = edges.join(to, [*GRAPH, "id"]).drop("id").withColumnRenamed("refined", "id").join(to.withColumnRenamed("id", "other"), [*GRAPH, "other"])
        contracted = contracted.where("id <> refined").groupBy(*GRAPH, "id", F.col("refined").alias("other")).agg(F.sum("w").alias("w"))
        edges = scratch.write(contracted, "edges")
        nodes = scratch.write(heavy.select(*GRAPH, F.col("refined").alias("id"), "k", "total", "h", "start"), "nodes")
        # A graph contracted to one node has no edges left; its members share one community.
        left = scratch.write(edges.select(*GRAPH).distinct(), "left")
        alone = scratch.write(at.join(left, GRAPH, "left_anti").join(nodes.select(*GRAPH, F.col("id").alias("at"), "start"), [*GRAPH, "at"]).select(*GRAPH, "id", F.col("start").alias("part")), "alone")
        done = done.unionByName(alone)
        at, nodes = scratch.write(at.join(left, GRAPH), "at"), scratch.write(nodes.join(left, GRAPH), "nodes")
    return done


def moved_nodes(scratch: Scratch, edges: DataFrame, nodes: DataFrame, seed: int, bound: DataFrame | None = None) -> DataFrame:
    """``topic, root, id, part`` after rounds of local moving, as ``moved`` does it on arrays.

    edges: ``topic, root, id, other, w`` from both ends; nodes: ``topic, root, id, k, total, h, start``; ``bound``: ``topic, root, id, part``.
    """
    if bound is not None:
        a = bound.select(*GRAPH, "id", F.col("part").alias("_a"))
        b = bound.select(*GRAPH, F.col("id").alias("other"), F.col("part").alias("_b"))
        edges = edges.join(a, [*GRAPH, "id"]).join(b, [*GRAPH, "other"]).where("_a = _b").drop("_a", "_b")
    edges = scratch.write(edges.join(nodes.select(*GRAPH, "id", "h"), [*GRAPH, "id"]), "both")
    state = scratch.write(nodes.select(*GRAPH, "id", "k", "total", "h", F.col("start").alias("part"), F.lit(False).alias("moved")), "moving")
    path, quiet = scratch.last, 0
    whole = lambda c: c.cast("decimal(19,0)")
    for r in range(2 * PAIRS_OF_ROUNDS):
        quiet = 0 if r % 2 == 0 else quiet
        active = F.shiftright("h", r // 2 % 48).bitwiseAND(F.lit(1)) == r % 2
        weight = state.groupBy(*GRAPH, "part").agg(F.sum("k").alias("volume"))
        links = edges.where(active).join(state.select(*GRAPH, F.col("id").alias("other"), "part"), [*GRAPH, "other"]).select(*GRAPH, "id", "part", "w")
        stay = state.where(active).select(*GRAPH, "id", "part", F.lit(0).cast("long").alias("w"))
        choice = links.unionByName(stay).groupBy(*GRAPH, "id", "part").agg(F.sum("w").alias("w")).join(weight, [*GRAPH, "part"])
        choice = choice.join(state.select(*GRAPH, "id", "k", "total", F.col("part").alias("own")), [*GRAPH, "id"])
        same = F.col("part") == F.col("own")
        # Whole numbers of up to 19 digits, whose products are exact.
        gain = whole(F.col("w")) * whole(F.col("total")) - whole(F.col("k")) * whole(F.col("volume") - F.when(same, F.col("k")).otherwise(0))
        best = choice.groupBy(*GRAPH, "id").agg(F.max_by("part", F.struct(gain.alias("gain"), same.alias("same"), hashed("part", seed).alias("h"), "part")).alias("best"))
        new = state.join(best, [*GRAPH, "id"], "left").select(*GRAPH, "id", "k", "total", "h", F.coalesce("best", "part").alias("part"), (F.coalesce("best", "part") != F.col("part")).alias("moved"))
        old, state = path, scratch.write(new, "moving")
        path = scratch.last
        scratch.drop(old)
        quiet += int(state.where("moved").isEmpty())
        if quiet == 2:
            break
    return state.select(*GRAPH, "id", "part")
