"""Evaluation texts leaking into training text.

One Aho-Corasick automaton holds words of the normalised test questions, and the normalised answers.  Each document is
normalised (case folded, markup and punctuation removed, white space made single blanks) and scanned once.  Around the
words that were met the text is aligned with the question: pairs of equal words are chained in order, a chain may
skip a few words on either side (isolated changes), and two chains may follow each other with other text between
them (one interruption).  Offsets of what was found refer to the original text.

Two conditions that every passage meets keep the alignment rare; neither loses a passage.  (1) The automaton holds the
``SEEDS`` share of a question's words that are rarest among the questions.  Of more than half of all words, at
least ``more than half - the words left out`` are among them, wherever changes fall; no run of intact words is needed.
(2) Each word of a chain has another one of it within reach in question and text.  Places that stand in such pairs are
cut into stretches where they are further apart than a chain reaches; a chain lies in one stretch, so two stretches
must hold more than half of the question's words between them, and only such are aligned.

Scale.  The scan is a map over the documents without a shuffle; only hits leave it.  The test items are shipped to the
executors in slices of at most ``max_items`` rows, cut by their numbers; with several slices each one's hits are
written before the next slice is read, so a larger test set means further passes, not a larger automaton.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranking import placed
from tessera.session import Scratch

#: Share of a question's words, the rarest ones, that the automaton holds.  Above a half; what is found does not depend on it.
SEEDS = 0.8
#: Words that may be changed, inserted or dropped between two words of a chain.
GAP = 3
#: A chain of fewer words is no part of a passage.
LEAST_CHAIN = 4

TAG = re.compile(r"<[^<>\n]{1,200}>|\\[ntr]|&(?:nbsp|#160|amp|quot|lt|gt);")
SPLIT = re.compile(r"[\[\](){}<>|/—–…=]")
DROP = re.compile(r"[^\w\s]|_")

HITS = "doc_id bigint, item_id bigint, part string, words int, of_words int, start long, end long"


def normal_words(text: str) -> list[str]:
    """The words of a text, as they are compared."""
    return DROP.sub("", SPLIT.sub(" ", TAG.sub(" ", text.casefold()))).split()


def words_with_offsets(text: str) -> list[tuple[str, int, int]]:
    """The same words with their places in the original text."""
    blank = lambda m: " " * (m.end() - m.start())
    folded = text.casefold()
    back = None if len(folded) == len(text) else [i for i, c in enumerate(text) for _ in c.casefold()]  # some letters fold to several
    out = []
    for m in re.finditer(r"\S+", SPLIT.sub(" ", TAG.sub(blank, folded))):
        word = DROP.sub("", m.group())
        if word:
            out.append((word, m.start(), m.end()) if back is None else (word, back[m.start()], back[m.end() - 1] + 1))
    return out


class LeakFinder:
    """The automaton over one slice of test items, and the search of one text.

    ``least``: share of a question's words that must be exceeded; answers of fewer than ``least_answer`` words stand anywhere
    and are not searched.
    """

    def __init__(self, items: list[tuple[int, str | None, str | None]], least: float = 0.5, least_answer: int = 8):
        import ahocorasick

        self.least = least
        self.questions = [(item_id, words) for item_id, question, _ in items if (words := normal_words(question or ""))]
        common = Counter(w for _, words in self.questions for w in set(words))
        seeds: dict[str, list[int]] = defaultdict(list)
        self.needed = np.zeros(len(self.questions), np.int64)
        for k, (_, words) in enumerate(self.questions):
            rarest = sorted(range(len(words)), key=lambda i: (common[words[i]], i))[: math.ceil(SEEDS * len(words))]
            for i in rarest:
                seeds[words[i]].append(k)
            self.needed[k] = max(1, math.floor(least * len(words)) + 1 - (len(words) - len(rarest)))
        self.answers: list[tuple[int, int]] = []
        whole: dict[str, list[int]] = defaultdict(list)
        for item_id, _, answer in items:
            said = normal_words(answer or "")
            if len(said) >= least_answer:
                whole[" " + " ".join(said) + " "].append(len(self.answers))
                self.answers.append((item_id, len(said)))
        self.postings = [np.array(ks) for ks in seeds.values()]
        patterns = list(dict.fromkeys([f" {w} " for w in seeds] + list(whole)))  # the seeds come first, so their numbers are those of the postings
        self.said = {n: whole[text] for n, text in enumerate(patterns) if text in whole}
        self.automaton = ahocorasick.Automaton()
        for n, text in enumerate(patterns):
            self.automaton.add_word(text, n)
        if patterns:
            self.automaton.make_automaton()
        self.empty = not patterns
        self.steps: dict[int, dict[tuple[str, str], int]] = {}

    def search(self, text: str) -> list[tuple]:
        """``(item_id, part, words, of_words, start, end)`` of what the text contains."""
        if self.empty or not text:
            return []
        plain = normal_words(text)
        normal = " " + " ".join(plain) + " "
        met = {n for _, n in self.automaton.iter(normal)}
        answered = {}
        if not met.isdisjoint(self.said):
            for end, n in self.automaton.iter(normal):
                for k in self.said.get(n, ()):
                    answered.setdefault(k, end)
        likely = self.likely(plain, met)
        if not likely and not answered:
            return []
        words = words_with_offsets(text)
        if len(words) != len(plain):  # cannot be placed: the whole text is given as the place
            words = [(w, 0, len(text)) for w in plain]
        found = []
        for k in likely:
            item_id, question = self.questions[k]
            places = self.stretches(k, plain)
            passage = best_passage(question, plain, places) if places else None
            if passage and passage[0] > self.least * len(question):
                found.append((item_id, "question", passage[0], len(question), words[passage[1]][1], words[passage[2]][2]))
        for k, end in answered.items():
            item_id, n = self.answers[k]
            last = normal.count(" ", 0, end) - 1
            found.append((item_id, "answer", n, n, words[last - n + 1][1], words[last][2]))
        return found

    def likely(self, plain: list[str], met: set[int]) -> list[int]:
        """Numbers of the questions of which the text may contain a passage; none that it does contain is missing."""
        if not met or not self.questions:
            return []
        counts = np.bincount(np.concatenate([self.postings[n] for n in met if n < len(self.postings)] or [np.zeros(0, np.int64)]), minlength=len(self.questions))
        enough = np.flatnonzero(counts >= self.needed)
        if not len(enough):
            return []
        near = {pair for d in range(1, GAP + 2) for pair in zip(plain, plain[d:])}
        return [k for k in enough.tolist() if self._in_pairs(k, near)]

    def _pairs(self, k: int) -> dict[tuple[str, str], int]:
        """Pairs of words within reach of each other in a question, with the set of the places of both as bits."""
        if k not in self.steps:
            words, steps = self.questions[k][1], defaultdict(int)
            for d in range(1, GAP + 2):
                for i, pair in enumerate(zip(words, words[d:])):
                    steps[pair] |= 1 << i | 1 << (i + d)
            self.steps[k] = dict(steps)
        return self.steps[k]

    def _in_pairs(self, k: int, near: set[tuple[str, str]]) -> bool:
        """Do more than the least share of a question's words stand with another one of them within reach?"""
        words, steps, held = self.questions[k][1], self._pairs(k), 0
        if len(words) == 1:
            return True
        for pair in steps.keys() & near:
            held |= steps[pair]
        return held.bit_count() > self.least * len(words)

    def stretches(self, k: int, plain: list[str]) -> list[int]:
        """The places of a text at which words of a passage may stand; empty if it holds none."""
        words, steps = self.questions[k][1], self._pairs(k)
        own = set(words)
        at = [j for j, w in enumerate(plain) if w in own]
        if len(words) == 1:
            return at
        marked: dict[int, int] = {}
        for n, j in enumerate(at):
            for later in at[n + 1 : n + GAP + 2]:
                if later - j > GAP + 1:
                    break
                if held := steps.get((plain[j], plain[later])):
                    marked[j] = marked.get(j, 0) | held
                    marked[later] = marked.get(later, 0) | held
        groups: list[tuple[int, list[int]]] = []
        last = None
        for j in sorted(marked):
            if last is None or j - last > GAP + 1:
                groups.append((0, []))
            groups[-1] = (groups[-1][0] | marked[j], groups[-1][1])
            groups[-1][1].append(j)
            last = j
        sizes = sorted((held.bit_count() for held, _ in groups), reverse=True)[:2]
        if sum(sizes) <= self.least * len(words):
            return []
        return [j for held, places in groups if held.bit_count() + sizes[0] > self.least * len(words) for j in places]


def best_passage(question: list[str], words: list[str], places: list[int] | None = None) -> tuple[int, int, int] | None:
    """``(question words in order, first word, last word)`` of the best passage of a text, of which only ``places`` are looked at.

    Chains of equal words with gaps of at most ``GAP``; one passage is one chain, or two with any other text
    between them, of which the second takes the question up where the first left it.
    """
    where: dict[str, list[int]] = defaultdict(list)
    for i, w in enumerate(question):
        where[w].append(i)
    # By place j and question word i: score, start and words of the last chain, of the best chain or two that end there.  Only places within reach are kept.
    single: dict[int, dict[int, tuple[int, int, int]]] = {}
    double: dict[int, dict[int, tuple[int, int, int]]] = {}
    nothing: dict = {}
    n = len(question)
    closed: list[tuple[int, int]] = [(0, 0)] * n  # best single chain so far that ends with question word i
    waiting: list[tuple[int, int, int, int]] = []
    best: tuple[int, int, int] | None = None
    for j in range(len(words)) if places is None else places:
        hits = where.get(words[j])
        if not hits:
            continue
        while waiting and waiting[0][0] < j:
            _, i, score, start = waiting.pop(0)
            if closed[i][0] < score:
                closed[i] = (score, start)
        for old in [k for k in single if k < j - GAP - 1]:
            del single[old], double[old]
        single[j], double[j] = {}, {}
        for i in hits:
            one, two = (1, j, 1), None
            for di in range(1, GAP + 2):
                if i - di < 0:
                    break
                for dj in range(1, GAP + 2):
                    x = single.get(j - dj, nothing).get(i - di)
                    if x and x[0] + 1 > one[0]:
                        one = (x[0] + 1, x[1], x[2] + 1)
                    y = double.get(j - dj, nothing).get(i - di)
                    if y and (two is None or y[0] + 1 > two[0]):
                        two = (y[0] + 1, y[1], y[2] + 1)
            single[j][i] = one
            score, start = max(closed[max(0, i - GAP - 1) : i], default=(0, 0))
            if score >= LEAST_CHAIN and (two is None or score + 1 > two[0]):
                two = (score + 1, start, 1)
            if two:
                double[j][i] = two
            if one[2] >= LEAST_CHAIN:
                waiting.append((j, i, one[0], one[1]))
            for x in (one, two):
                if x and x[2] >= min(LEAST_CHAIN, n) and (best is None or x[0] > best[0]):
                    best = (x[0], x[1], j)
    return best


def leaks(documents: DataFrame, items: DataFrame, least: float = 0.5, max_items: int = 20_000, least_answer: int = 8) -> DataFrame:
    """``doc_id, item_id, part, words, of_words, start, end``: questions (more than ``least`` of their words) and whole answers.

    documents: ``doc_id, text``; items: ``item_id, question, answer``; further columns are ignored.  Answers of fewer than
    ``least_answer`` words are not searched, as they stand anywhere.

    Defined edge cases: null or empty texts and questions match nothing; questions without a word match nothing; a
    repeated document row repeats its matches, a repeated item row does not; an empty table on either side gives no
    rows; a null ``doc_id`` or ``item_id`` is kept as null.
    """
    part = items.select("item_id", "question", "answer").distinct()
    texts = documents.select("doc_id", "text").where("text is not null and text <> ''")
    total = part.count()
    if total <= max_items:
        return texts.mapInPandas(_scanner([tuple(r) for r in part.collect()], least, least_answer), HITS)
    scratch = Scratch(documents.sparkSession, "leaks")
    numbered = scratch.write(placed(part.withColumn("_all", F.lit(0)), ["_all"], [F.col(c) for c in part.columns]), "items")
    out = None
    for first in range(1, total + 1, max_items):
        rows = [tuple(r) for r in numbered.where(F.col("place").between(first, first + max_items - 1)).select(*part.columns).collect()]
        found = scratch.write(texts.mapInPandas(_scanner(rows, least, least_answer), HITS), "found")
        out = found if out is None else out.unionByName(found)
    return out


def _scanner(rows: list[tuple], least: float, least_answer: int):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = LeakFinder(rows, least, least_answer)
        for batch in batches:
            hits = []
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                hits += [(doc_id, *x) for x in finder.search(text)]
            yield pd.DataFrame(hits, columns=[c.split()[0] for c in HITS.split(", ")]).astype({"doc_id": "Int64", "item_id": "Int64"})

    return scan


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id``: each document with each question of which it contains more than half."""
    return leaks(documents, items).where("part = 'question'").select("doc_id", "item_id").distinct()
