"""Splitting oversized items at natural boundaries, by agglomerative merging.

An item longer than the limit is cut into atomic segments at every natural boundary: paragraph break, line break,
sentence end, clause mark, blank. A segment that is itself too long (a run without any natural place) is cut at
grapheme boundaries. All adjacent pairs are held in a heap keyed by the strength of the boundary between them and
by position; the weakest boundary is merged first, of equal ones the first, while the combined size plus the overlap fits.
What is left are the pieces: boundaries that stay are the strongest that the limit allows.

Each piece after the first begins with up to `overlap` code points repeated from the end of the one before, taken
back to the next natural boundary inside that window (a blank or stronger; a grapheme boundary if there is none).

Defined results: null and empty texts, and texts of at most `limit` code points, are no items to cut and give no rows;
piece 0 starts at 0; the pieces' own spans (start, end) tile the text, so dropping the overlaps gives it back
unchanged; a single grapheme longer than the limit is cut between code points; an item stored several times
identically counts once; copies that differ keep their own rows, told apart by `start` and `piece_text`.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 2000
OVERLAP = 200
TASKS_A_CORE = 4
PIECES = "item_id string, piece int, start int, end int, overlap int, boundary string, piece_text string"

_NATURAL = regex.compile(
    r"(?P<p>\s*\n\s*\n\s*)|(?P<l>\s*\n\s*)|(?P<s>(?<=[.!?…।؟۔][\"'”’»)\]]?)\s+|(?<=[。！？][”’」』）]?)(?![”’」』）])\s*)|(?P<c>(?<=[,;:|،؛–—])\s+|(?<=[，、；：])\s*)|(?P<b>\s+)"
)
_STRENGTH = {"p": 5, "l": 4, "s": 3, "c": 2, "b": 1}
_NAME = {6: "start", 5: "paragraph", 4: "line", 3: "sentence", 2: "clause", 1: "blank", 0: "grapheme"}
_GRAPHEME = regex.compile(r"\X")


def atoms(text: str, most: int) -> tuple[list[int], list[int]]:
    """Ends of the atomic segments, and the strength of the boundary at each; white space goes with what is before."""
    ends: list[int] = []
    strong: list[int] = []
    at = 0
    for m in _NATURAL.finditer(text):
        e = m.end()
        if e <= at or e >= len(text):
            continue
        at = _cut_run(text, at, e, most, ends, strong)
        ends.append(e)
        strong.append(_STRENGTH[m.lastgroup])
        at = e
    _cut_run(text, at, len(text), most, ends, strong)
    ends.append(len(text))
    strong.append(6)
    return ends, strong


def _cut_run(text: str, start: int, end: int, most: int, ends: list[int], strong: list[int]) -> int:
    """A segment longer than `most` is cut at the last grapheme boundary before each `most`."""
    while end - start > most:
        stop = start
        for g in _GRAPHEME.finditer(text, max(start, start + most - 64), end):
            if g.end() - start > most:
                break
            stop = g.end()
        if stop <= start:
            stop = start + most
        ends.append(stop)
        strong.append(0)
        start = stop
    return start


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, int]]:
    """(start, end, overlap before start, strength of the boundary at start)."""
    room = limit - overlap  # of any piece that has one before it
    ends, strong = atoms(text, room)
    n = len(ends)
    start = [0, *ends[:-1]]
    end = list(ends)
    nxt, prv, dead = list(range(1, n + 1)), list(range(-1, n - 1)), [False] * n
    heap = [(strong[i], i, end[i + 1]) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        _, i, e = heapq.heappop(heap)
        j = nxt[i] if not dead[i] else n
        if dead[i] or j >= n or end[j] != e:
            continue  # one of the two has changed since
        if e - start[i] > (limit if prv[i] < 0 else room):
            continue
        strong[i], end[i], dead[j], nxt[i] = strong[j], end[j], True, nxt[j]
        if nxt[j] < n:
            prv[nxt[j]] = i
            heapq.heappush(heap, (strong[i], i, end[nxt[i]]))
        if prv[i] >= 0:
            h = prv[i]
            heapq.heappush(heap, (strong[h], h, end[i]))
    out: list[tuple[int, int, int, int]] = []
    i, before = 0, 6
    while i < n:
        s = start[i]
        back = 0
        if s:
            low = max(out[-1][0], s - overlap)
            m = None if low == out[-1][0] else regex.compile(r"(?<=\s)\S").search(text, low, s)
            if m:
                low = m.start()
            elif low > out[-1][0]:
                while low < s and not _starts_grapheme(text, low):
                    low += 1
            back = s - low
        out.append((s, end[i], back, before))
        before = strong[i]
        i = nxt[i]
    return out


def _starts_grapheme(text: str, at: int) -> bool:
    lo = max(0, at - 32)
    return any(g.start() == at for g in _GRAPHEME.finditer(text, lo, min(len(text), at + 32)))


def split_oversized(df: DataFrame, item: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """PIECES of the items longer than `limit`; the test of the length runs before anything leaves the JVM."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    x = df.select(F.col(item).cast("string").alias("item_id"), F.col(text).alias("t")).where(F.length("t") > limit)
    # Copies are told by id and digest; a number of tasks of its own, since cutting costs more than its bytes show.
    tasks = TASKS_A_CORE * df.sparkSession.sparkContext.defaultParallelism
    x = x.withColumn("h", F.sha2("t", 256)).repartition(tasks, "item_id", "h").dropDuplicates(["item_id", "h"]).drop("h")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [
                (i, k, s, e, o, _NAME[g], t[s - o : e]) for i, t in zip(b["item_id"], b["t"]) for k, (s, e, o, g) in enumerate(pieces(t, limit, overlap))
            ]
            yield pd.DataFrame(rows, columns=["item_id", "piece", "start", "end", "overlap", "boundary", "piece_text"])

    return x.mapInPandas(run, PIECES)
