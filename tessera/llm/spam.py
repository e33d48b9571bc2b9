"""Keyword-stuffed and link-list pages, found by block-wise compression ratio and sentence punctuation.

Each text is cut into blocks (paragraphs; short ones of one kind are joined).  A block's compression ratio
is divided by the ratio usual for its length and language: the median over the prose blocks of the whole corpus, drawn
towards that of all languages and a line over all lengths by as much as few blocks weigh, so no rule switches with
the size of the corpus.  Extremely redundant blocks are spam however they are punctuated; clearly redundant ones
are spam if a low density of sentence ends and of clause words confirms that they hold no sentences.  Tables and
code are redundant by nature and exempt, but only with evidence in their cells and lines: numbers, assignments,
calls or keywords of a language; separators, line ends and fences alone do not exempt.  A text is spam if more than
half of its characters lie in spam blocks.

Plan.  One Arrow pass over the texts (no shuffle) gives a few numbers per block, which are written once.
The norms are one aggregation to at most 5 languages times 40 length classes, so they can be
broadcast whatever the corpus; the verdict is one aggregation by ``doc_id`` of those numbers.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import ALL_CLAUSE, CLAUSE_SETS, LANGS
from tessera.session import Scratch

SENTENCE_END = re.compile(r"[.!?…。！？][\"'»”“’)\]]*(?=\s|$)")
WORD = re.compile(r"[^\W\d_]+")
PARAGRAPHS = re.compile(r"\n[ \t\r]*\n")
TABLE_LINE = re.compile(r"[ \t]*\|.*\|[ \t\r]*$|[^\t\n]*(?:\t[^\t\n]*){2,}$")
CODE_LINE = re.compile(
    r"[\w\])]\s*(?:[-+*/:|]?=|==|!=|<=|>=|->|=>)\s*[\w\"'({\[]|\w\([^()]{0,200}\)"
    r"|^[ \t]*(?:def|return|import|function|class|elif|for|while|if|var|let|const)\b.{0,200}(?:[({;]|:[ \t]*\r?$)|\b(?:SELECT|FROM|WHERE|INSERT|UPDATE|CREATE)\b|^[ \t]*[{}()\];]+[ \t]*$"
)
CODE_CHARACTER = re.compile(r"[=({};>\])]|\b(?:SELECT|FROM|WHERE|INSERT|UPDATE|CREATE)\b|:[ \t]*\r?$")
ADDRESS = re.compile(r"(?:https?://|www\.)\S+")
NUMBER = re.compile(r"[±+\-−~<>≈]?\s*\d[\d.,  %€$£]*\s?\w{0,3}$")

#: Blocks shorter than this have no compression ratio to speak of; they join a neighbour of their kind.
SHORT = 240
#: The compression ratio of prose by the binary logarithm of its bytes (level, slope, least), and its weight in blocks.
PRIOR, PRIOR_BLOCKS = (1.36, -0.084, 0.25), 30
#: A block of fewer characters, such as a lone title, is spam only if extremely redundant.
LEAST = 100
BLOCKS = "doc_id bigint, chars long, size int, ratio double, sentences double, clauses double, exempt boolean, lang string"


def _is_table(lines: list[str]) -> bool:
    """Most lines are rows, and at least a quarter of their cells are numbers."""
    rows = [x for x in lines if ("|" in x or "\t" in x) and TABLE_LINE.match(x)]
    if 2 * len(rows) <= len(lines):
        return False
    cells = [c for x in rows for c in map(str.strip, re.split(r"[|\t]", x)) if c.strip("-: ")]
    return 4 * sum(bool(NUMBER.match(c)) for c in cells) >= len(cells) > 0


def _is_code(lines: list[str], fenced: bool) -> bool:
    """Most lines, within a fence a quarter of them, hold what only code holds."""
    if not any(map(CODE_CHARACTER.search, lines)):  # none of what CODE_LINE asks for
        return False
    lines = [x for x in lines if not x.lstrip().startswith(("```", "~~~"))]
    return (4 if fenced else 2) * sum(bool(CODE_LINE.search(ADDRESS.sub(" ", x))) for x in lines) > len(lines)


def _kind(paragraph: str, fenced: bool = False) -> str:
    lines = [x for x in paragraph.split("\n") if x.strip()]
    if _is_table(lines):
        return "table"
    if _is_code(lines, fenced or paragraph.lstrip().startswith(("```", "~~~"))):
        return "code"
    return "prose" if SENTENCE_END.search(paragraph) else "bare"


def text_blocks(text: str) -> list[tuple[str, str]]:
    """``(kind, block)``: paragraphs; short neighbours of one kind are joined, and what stands in one fence is one block."""
    blocks: list[tuple[str, list[str]]] = []
    fence: list[str] = []  # parts of an open fence
    size = 0  # characters of the last block
    for p in [*PARAGRAPHS.split(text), None]:
        if p is not None:
            p = p.strip()
            if not p:
                continue
            if fence or p.count("```") % 2:
                closes = bool(fence) and p.count("```") % 2 == 1
                fence.append(p)
                if not closes:
                    continue
        if p is None and not fence:
            break
        kind = _kind("\n".join(fence), True) if fence else _kind(p)
        parts, fence = fence or [p], []
        n = sum(map(len, parts)) + len(parts) - 1
        if blocks and blocks[-1][0] == kind and (kind in ("code", "bare") or max(n, size) < SHORT):
            blocks[-1][1].extend(parts)
            size += n + 1
        else:
            blocks.append((kind, parts))
            size = n
    return [(kind, "\n".join(parts)) for kind, parts in blocks]


def block_features(block: str) -> tuple[int, float, float, float, str]:
    """Bytes, compression ratio, sentence ends per word, clause words per word, language."""
    raw = block.encode("utf-8", "replace")
    ratio = (len(zlib.compress(raw, 6)) - 8) / len(raw)
    counts = Counter(WORD.findall(block.lower()))
    words = max(1, sum(counts.values()))
    clause = sum(n for w, n in counts.items() if w in ALL_CLAUSE)
    hits = {lang: sum(counts.get(w, 0) for w in CLAUSE_SETS[lang]) for lang in LANGS}
    lang = max(LANGS, key=hits.get) if clause else "none"
    return len(raw), ratio, len(SENTENCE_END.findall(block)) / words, clause / words, lang


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch["doc_id"], batch["text"]):
            if not text:
                continue
            for kind, block in text_blocks(text):
                rows.append((doc_id, len(block), *(f := block_features(block))[:4], kind in ("code", "table"), f[4]))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in BLOCKS.split(", ")]).astype({"doc_id": "Int64"})


def spam_shares(documents: DataFrame, redundant: float = 0.9, extreme: float = 0.55, sentences: float = 0.03, clauses: float = 0.055) -> DataFrame:
    """``doc_id, n_chars, spam_chars, spam_share`` of each text that is not blank.

    documents: ``doc_id, text``; further columns are ignored (the language is judged per block, since a
    given one may be null or wrong).  ``redundant`` and ``extreme``: shares of the usual compression ratio.

    Defined edge cases: null, empty and blank texts give no row; repeated rows of one ``doc_id`` are judged
    together; rows with a null ``doc_id`` are judged as one document; an empty table gives no rows.
    """
    scratch = Scratch(documents.sparkSession, "spam")
    blocks = scratch.write(documents.select("doc_id", "text").where("text is not null").mapInPandas(_measure, BLOCKS), "blocks")
    klass = F.round(F.log2(F.col("size").cast("double")) * 2).cast("int")
    blocks = blocks.withColumn("klass", klass)
    prose = blocks.where((F.col("sentences") >= sentences) & ~F.col("exempt"))
    norms = prose.groupBy("lang", "klass").agg(F.percentile_approx("ratio", 0.5, 1000).alias("usual"), F.count("*").alias("n"))
    overall = prose.groupBy("klass").agg(F.percentile_approx("ratio", 0.5, 1000).alias("any_usual"), F.count("*").alias("any_n"))
    judged = blocks.join(F.broadcast(norms), ["lang", "klass"], "left").join(F.broadcast(overall), ["klass"], "left")
    # Where a class has few blocks, the line of ratio on log size over all prose blocks counts, which never rises, as longer
    # texts compress no worse; four numbers reach the driver.
    log_size = F.log2(F.col("size").cast("double"))
    line = prose.where("size >= 100").agg(F.regr_slope("ratio", log_size).alias("slope"), F.avg(log_size).alias("x"), F.avg("ratio").alias("y"), F.count("*").alias("n")).first()
    level, slope, least = PRIOR
    if line["n"]:
        share, own = line["n"] / (line["n"] + PRIOR_BLOCKS), min(0.0, line["slope"] or 0.0)
        level, slope = share * (line["y"] - own * line["x"]) + (1 - share) * level, share * own + (1 - share) * slope
    usual = F.greatest(F.lit(level) + F.lit(slope) * log_size, F.lit(least))
    for n, median in (("any_n", "any_usual"), ("n", "usual")):
        weight = F.coalesce(F.col(n), F.lit(0))
        usual = (weight * F.coalesce(F.col(median), F.lit(0.0)) + PRIOR_BLOCKS * usual) / (weight + PRIOR_BLOCKS)
    relative = F.col("ratio") / usual
    bare = (F.col("sentences") < sentences) & (F.col("clauses") < clauses)
    spam = ~F.col("exempt") & ((relative < extreme) | ((relative < redundant) & bare & (F.col("chars") >= LEAST)))
    shares = judged.groupBy("doc_id").agg(F.sum("chars").alias("n_chars"), F.sum(F.when(spam, F.col("chars")).otherwise(0)).alias("spam_chars"))
    return shares.withColumn("spam_share", F.col("spam_chars") / F.col("n_chars"))


def spam_pages(documents: DataFrame, share: float = 0.5) -> DataFrame:
    """``doc_id`` of the texts of which more than ``share`` consists of spam blocks."""
    return spam_shares(documents).where(F.col("spam_share") > share).select("doc_id")

