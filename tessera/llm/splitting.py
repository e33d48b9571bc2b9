"""Splitting oversized texts at natural boundaries, with an overlap between consecutive pieces.

Each position at which a text may be cut has a strength (blank line, line end, sentence end, clause
end, blank).  Over the positions of strength above zero a sparse table holds range maxima, so the
strongest cut of the permissible window is two look-ups; of equally strong cuts the rightmost wins.
The next piece starts ``overlap`` characters before the cut.

The work is a map over rows: no shuffle.  Short texts are filtered out before the texts leave the JVM
for Python.  The sparse table is built for a stretch of positions at a time; besides it a text takes about 44 bytes a
character while it is split, as its positions are held in whole (132 MB for three million characters).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Positions per sparse table.
STRETCH = 65_536

PIECES = "file_id bigint, piece_no int, start long, length int, overlap int, cut string, n_chars long, piece string"


def boundary_strengths(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Natural cut positions of a text of code points, ascending, and their strengths 1 to 6.

    A position p cuts before character p.  6: before a heading line; 5: after a blank line; 4: after a
    line end; 3: after a sentence end and blank; 2: after a clause mark and blank; 1: beside any blank.
    """
    n = len(codes)
    if n < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    newline = (codes == 10) | (codes == 13)
    blank = newline | (codes == 32) | (codes == 9)
    strength = np.zeros(n, np.int8)
    strength[1:][blank[:-1] | blank[1:]] = 1
    idx = np.arange(n)
    starts = np.flatnonzero(~blank[1:] & blank[:-1]) + 1  # first character after a run of blanks
    word_end = np.maximum.accumulate(np.where(~blank, idx, -1))  # last non-blank character at or before
    last = word_end[starts - 1]
    ok = last >= 0
    ends = np.isin(codes[np.maximum(last, 0)], [ord(c) for c in ".!?…。！？"])
    closed = np.isin(codes[np.maximum(last, 0)], [ord(c) for c in "\"'”’»)]"]) & np.isin(codes[np.maximum(last - 1, 0)], [ord(c) for c in ".!?…"])
    clause = np.isin(codes[np.maximum(last, 0)], [ord(c) for c in ",;:–—"])
    strength[starts[ok & clause]] = 2
    strength[starts[ok & (ends | closed)]] = 3
    lines = np.concatenate(([0], np.cumsum(codes == 10)))
    n_lines = lines[starts] - lines[last + 1]
    strength[starts[n_lines == 1]] = 4
    strength[starts[n_lines >= 2]] = 5
    strength[starts[(n_lines >= 1) & (codes[starts] == ord("#"))]] = 6
    where = np.flatnonzero(strength)
    where = where[where > 0]
    return where, strength[where].astype(np.int64)


class StrongestCut:
    """Range-maximum index over cut positions; ties are won by the rightmost."""

    def __init__(self, where: np.ndarray, strength: np.ndarray, limit: int):
        self.where, self.levels = where, max(1, int(limit + 1).bit_length())
        self.value = strength * (len(where) + 1) + np.arange(len(where))
        self.lo, self.hi, self.limit = 0, 0, limit
        self.tables: list[np.ndarray] = []

    def _cover(self, i: int, j: int) -> None:
        if self.tables and self.lo <= i and j <= self.hi:
            return
        self.lo, self.hi = i, min(len(self.where), max(i + STRETCH, j))
        self.tables = [self.value[self.lo : self.hi]]
        width = 1
        while 2 * width <= min(self.limit + 1, self.hi - self.lo):
            t = self.tables[-1]
            self.tables.append(np.maximum(t[:-width], t[width:]))
            width *= 2

    def query(self, first: int, last: int) -> int | None:
        """The strongest cut position in [first, last], or None."""
        i, j = np.searchsorted(self.where, first, "left"), np.searchsorted(self.where, last, "right")
        if i >= j:
            return None
        self._cover(int(i), int(j))
        level = int(j - i).bit_length() - 1
        t = self.tables[level]
        best = max(t[i - self.lo], t[j - self.lo - (1 << level)])
        return int(self.where[best % (len(self.where) + 1)])


def split_points(text: str, limit: int = 6000, overlap: int = 200, shortest: float = 0.5) -> list[tuple[int, int, int, str]]:
    """``(start, end, overlap with the predecessor, kind of cut at the end)`` of each piece.

    A cut is sought first among pieces of ``shortest`` to 1 times the limit, then among shorter ones.
    Where a word or other stretch without blanks leaves no cut after the overlap but would fit a piece of its
    own, the overlap is shortened rather than the stretch cut.  ``forced`` is a cut in a stretch without
    blanks that is longer than the limit; the end of the text is ``end``.
    """
    n = len(text)
    if n <= limit:
        return [(0, n, 0, "end")] if n else []
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    where, strength = boundary_strengths(codes)
    index = StrongestCut(where, strength, limit)
    pieces, start, cut = [], 0, 0
    while n - start > limit:
        least = max(cut + 1, start + int(limit * shortest))
        found = index.query(least, start + limit)
        if found is None and least > cut + 1:
            found = index.query(cut + 1, least - 1)
        if found is None and cut > start:  # give up overlap, as little as needed
            i = np.searchsorted(where, start + limit, "right")
            following = int(where[i]) if i < len(where) else n  # the end of the text is a boundary as well
            if following <= cut + limit:
                start = following - limit
                if following == n:
                    break
                found = following
        kind = "natural"
        if found is None:
            found, kind = start + limit, "forced"
        pieces.append((start, found, cut - start if pieces else 0, kind))
        cut = found
        start = max(start + 1, cut - overlap)
        if n - cut == 0:
            return pieces
    pieces.append((start, n, cut - start, "end"))
    return pieces


def split_texts(files: DataFrame, limit: int = 6000, overlap: int = 200, with_text: bool = True) -> DataFrame:
    """Pieces of the texts of more than ``limit`` characters (code points), in order from 0.

    files: ``file_id, text``; further columns are ignored.  ``file_id, piece_no, start, length, overlap, cut,
    n_chars`` and ``piece`` (null unless ``with_text``).  The pieces cover the text without a gap; leaving out the first
    ``overlap`` characters of each gives the text again.

    Defined edge cases: null, empty and short texts give no row; a null ``file_id`` is kept; repeated
    rows are each split; a text without any blank is cut by force at the limit.
    """

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file_id, text in zip(batch["file_id"], batch["text"]):
                for k, (a, b, o, kind) in enumerate(split_points(text, limit, overlap)):
                    rows.append((None if pd.isna(file_id) else int(file_id), k, a, b - a, o, kind, len(text), text[a:b] if with_text else None))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in PIECES.split(", ")])
            yield out.astype({"file_id": "Int64"})

    long = files.where(F.length("text") > limit).select("file_id", "text")
    return long.mapInPandas(pieces, PIECES)


def cut_kinds(files: DataFrame, limit: int = 6000, overlap: int = 200) -> DataFrame:
    """``file_id, cut`` of each file over the limit: ``forced`` if any of its cuts had to be, otherwise ``natural``."""
    pieces = split_texts(files, limit, overlap, with_text=False)
    return pieces.groupBy("file_id").agg(F.when(F.max((F.col("cut") == "forced").cast("int")) == 1, "forced").otherwise("natural").alias("cut"))
