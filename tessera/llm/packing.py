"""Filling containers of fixed capacity with texts, measured in tokens of a public tokenizer.

Plan.  (1) One Arrow pass counts the tokens of each text; a text over the capacity is cut at multiples of the
capacity, whose full pieces are containers of their own.  (2) The remaining items are spread by row number (not by id, which may repeat) over
partitions of bounded size, each packed by best-fit decreasing.  A lower bound on a partition's containers, the
largest that a family of dual feasible functions gives, certifies it: a partition that meets its bound keeps
all containers that are nearly full; the others keep their full containers only.  The items of the
containers not kept go into a pool, which is spread anew and packed again, so that partitions exchange items.
(3) After ``rounds`` rounds, or when the pool is empty, the packing is complete.

Scale.  Ids and sizes only are shuffled, never texts.  Each task handles at most about ``per_task`` items,
whatever the corpus.  The pool shrinks from round to round to the gaps that are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import Scratch

#: Where the vocabulary files of public tokenizers lie; a parameter of every function that counts.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how this vocabulary splits a text before merging bytes.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Distinct words whose token counts a worker remembers.
REMEMBERED = 500_000

ITEMS = "doc_id bigint, piece_no int, start_token long, n_tokens int"
PACKED = "doc_id bigint, piece_no int, start_token long, n_tokens int, container string, final boolean"


class TokenCounter(dict):
    """Token counts of texts.  Merges never cross a word of ``PATTERN``, so counts per distinct word add up."""

    def __init__(self, path: str):
        import base64

        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("counter", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.words = regex.compile(PATTERN).findall

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self.encoding.encode_ordinary(word))
        return n

    def count(self, text: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        return sum(map(self.__getitem__, self.words(text)))


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, tokens`` of each row; a null text has none."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = TokenCounter(tokenizer)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "tokens": [counter.count(t) if t else 0 for t in batch["text"]]})

    return documents.select("doc_id", "text").mapInPandas(count, "doc_id bigint, tokens long")


def lower_bound(counts: np.ndarray) -> int:
    """Least number of containers for ``counts[s]`` items of each size s up to the capacity, by dual feasible functions.

    Two families: sizes under a threshold count nothing and those over capacity minus threshold
    count full; and sizes rounded to multiples of the k-th part of the capacity.
    """
    cap = len(counts) - 1
    size = np.arange(cap + 1, dtype=np.int64)
    n = counts.astype(np.int64)
    total = n * size
    below, full = np.cumsum(total), np.cumsum(n[::-1])[::-1]
    best = -(-int(total.sum()) // cap)
    for t in range(1, cap // 2 + 1):  # items over cap - t fill a container, items under t are left out
        big = int(full[cap - t + 1])
        middle = int(below[cap - t] - below[t - 1])
        best = max(best, big + -(-middle // cap))
    for k in range(2, 101):
        scaled = (k + 1) * size
        value = np.where(scaled % cap == 0, size * k, scaled // cap * cap)  # in units of cap * k
        best = max(best, -(-int((n * value).sum()) // (cap * k)))
    return best


def best_fit_decreasing(sizes: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Container number of each item, and the room left in each container."""
    container = np.zeros(len(sizes), np.int64)
    room: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(cap + 1)]
    open_rooms = 0  # bit r is set if some container has room r
    for i in np.argsort(-sizes, kind="stable"):
        s = int(sizes[i])
        fits = open_rooms >> s
        if fits and room:
            r = s + (fits & -fits).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                open_rooms &= ~(1 << r)
        else:
            r, b = cap, len(room)
            room.append(cap)
        r -= s
        room[b] = r
        by_room[r].append(b)
        open_rooms |= 1 << r
        container[i] = b
    return container, np.asarray(room, np.int64)


def _pack_group(cap: int, number: int, last: bool):
    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        sizes = group["n_tokens"].to_numpy(np.int64)
        container, room = best_fit_decreasing(sizes, cap)
        certified = len(room) <= lower_bound(np.bincount(sizes, minlength=cap + 1))
        keep = cap // 32 if certified else 0  # what is emptier is exchanged even so
        done = np.ones(len(sizes), bool) if last else room[container] <= keep
        names = np.array([f"r{number}.{key[0]}.{b}" for b in range(len(room))])
        return group[["doc_id", "piece_no", "start_token", "n_tokens"]].assign(container=names[container], final=done)

    return pack


def pack_documents(documents: DataFrame, capacity: int = 2048, tokenizer: str = TOKENIZER, rounds: int = 4, per_task: int = 50_000) -> DataFrame:
    """``doc_id, piece_no, start_token, n_tokens, container``: each text, or each piece of a text over the capacity.

    documents: ``doc_id, text``; further columns are ignored.

    Defined edge cases: null and empty texts are items of no tokens and are put into some container; a text of more
    than ``capacity`` tokens has pieces from 0 of ``capacity`` tokens and one of the rest; repeated rows are each packed;
    a null ``doc_id`` is kept; an empty table gives no rows.
    """
    if capacity < 1 or rounds < 1:
        raise ValueError("capacity and rounds must be at least 1")
    scratch = Scratch(documents.sparkSession, "packing")
    counted = scratch.write(token_counts(documents, tokenizer), "tokens")
    pieces = counted.select("doc_id", "tokens", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("tokens") / capacity) - 1).cast("int"))).alias("piece_no"))
    items = pieces.select(
        "doc_id",
        "piece_no",
        (F.col("piece_no").cast("long") * capacity).alias("start_token"),
        F.least(F.lit(capacity).cast("long"), F.col("tokens") - F.col("piece_no").cast("long") * capacity).cast("int").alias("n_tokens"),
    )
    full = items.where(F.col("n_tokens") == capacity)
    packed = full.withColumn("container", F.concat(F.lit("full."), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("."), F.col("piece_no"), F.lit("."), F.monotonically_increasing_id()))
    pool = items.where(F.col("n_tokens") < capacity)
    for k in range(rounds):
        n = pool.count()
        if not n:
            break
        parts = -(-n // per_task)
        last = k == rounds - 1 or parts == 1  # one partition has none to exchange with
        spread = pool.withColumn("part", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(k)), F.lit(parts)))
        done = scratch.write(spread.groupBy("part").applyInPandas(_pack_group(capacity, k, last), PACKED), f"round{k}")
        packed = packed.unionByName(done.where("final").drop("final"))
        pool = done.where("not final").drop("container", "final")
    return packed


def packing_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: containers, tokens, a lower bound on the containers, and the share of the space that is used.

    The sizes are counted by size, so what reaches the driver is at most ``capacity`` + 1 numbers.
    """
    sizes = {r["n_tokens"]: r["n"] for r in packed.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}
    counts = np.zeros(capacity + 1, np.int64)
    for s, n in sizes.items():
        counts[s] = n
    bound = lower_bound(counts)
    one = packed.agg(F.countDistinct("container").alias("n_containers"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens"))
    return one.select("n_containers", "n_tokens", F.lit(bound).cast("long").alias("lower_bound"), (F.col("n_tokens") / (F.col("n_containers") * capacity)).alias("used"))
