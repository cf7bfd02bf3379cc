"""Periodic runs of words: maximal stretches that repeat with their smallest period twice or more.

Harmonic grid probing: the words p apart within a run of period p are equal for p positions in a row or more, so one of
them is a multiple of p. Only the grid points jp are tested, n / p for each p. Few survive their neighbours' test; those
are extended by comparing arrays in chunks, unless a run that is known holds them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 12
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_FIRST, _MOST = 64, 1 << 16
#: Grid points that are tested at once.
_POINTS = 1 << 16
#: Words from which on a run is asked whether it holds a grid point.
_LONG = 256


def _end(w: np.ndarray, at: int, p: int) -> int:
    """The first place from ``at`` on whose word differs from that p later; n - p if there is none."""
    size, last = _FIRST, len(w) - p
    while at < last:
        stop = min(at + size, last)
        odd = w[at:stop] != w[at + p : stop + p]
        if odd.any():
            return at + int(odd.argmax())
        at, size = stop, min(size * 4, _MOST)
    return last


def _begin(w: np.ndarray, at: int, p: int) -> int:
    """The last place before ``at`` after which all words up to ``at`` equal those p later."""
    size = _FIRST
    while at > 0:
        low = max(0, at - size)
        odd = w[low:at] != w[low + p : at + p]
        if odd.any():
            return at - int(odd[::-1].argmax())
        at, size = low, min(size * 4, _MOST)
    return 0


def _near(w: np.ndarray, at: np.ndarray, p: np.ndarray, need: int) -> np.ndarray:
    """Which grid points have ``need`` equal places in a row around them."""
    n, count = len(w), np.ones(len(at), np.int64)
    for side in (1, -1):
        alive = np.ones(len(at), bool)
        for d in range(1, need):
            x = at + side * d
            alive &= (x >= 0) & (x + p < n)
            alive[alive] = w[x[alive]] == w[(x + p)[alive]]
            count += alive
            if not alive.any():
                break
    return count >= need


class _Finder:
    def __init__(self, w: np.ndarray, least: int):
        self.w, self.least = w, least
        self.runs: list[tuple[int, int, int]] = []
        self.seen: set[tuple[int, int]] = set()
        #: start, end and period of the long runs
        self.long: list[tuple[int, int, int]] = []

    def held(self, at: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Which grid points lie, with the word p later, in a run whose period divides p."""
        found = np.zeros(len(at), bool)
        for a, b, q in self.long:
            found |= (at >= a) & (at + p < b) & (p % q == 0)
        return found

    def extend(self, periods: list[int], places: list[int]) -> None:
        """Grid points by period, then place."""
        last, done = 0, 0
        for p, at in zip(periods, places, strict=True):
            if p != last:
                last, done = p, 0
            if at < done or any(a <= at and at + p < b and p % q == 0 for a, b, q in self.long):
                continue
            a, done = _begin(self.w, at, p), _end(self.w, at, p)
            length = done + p - a
            # a stretch of which a divisor of p is a period is the run of that period, which was found before
            if length >= max(self.least, 2 * p) and (a, length) not in self.seen:
                self.seen.add((a, length))
                self.runs.append((a, length, p))
                if length >= _LONG:
                    self.long.append((a, a + length, p))


def periodic_stretches(w: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) by start, then period, of the runs of at least ``least`` words in an array of word numbers."""
    n = len(w)
    if n < max(least, 2):
        return []
    finder = _Finder(w, least)
    periods = np.arange(1, n // 2 + 1)
    points = (n - 1) // periods
    before = np.cumsum(points) - points
    turns = np.unique(np.searchsorted(before, np.arange(0, before[-1] + 1, _POINTS)))
    for begin, stop in zip(turns, [*turns[1:], len(periods)], strict=True):
        p = np.repeat(periods[begin:stop], points[begin:stop])
        at = (np.arange(len(p)) - np.repeat(before[begin:stop] - before[begin], points[begin:stop])) * p
        same = w[at] == w[at + p]
        p, at = p[same], at[same]
        if finder.long:
            free = ~finder.held(at, p)
            p, at = p[free], at[free]
        # a run of period p has max(p, least - p) equal places in a row, so half of ``least`` at any rate
        near = _near(w, at, p, min(max(int(periods[begin]), -(-least // 2)), 8))
        finder.extend(p[near].tolist(), at[near].tolist())
    return sorted(finder.runs, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words but those that a run holds after its first period, joined by one blank."""
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    keep = np.cumsum(change)[:-1] == 0
    return b" ".join(words[i] for i in np.flatnonzero(keep)) if runs else b" ".join(words)


def numbered(words: list[bytes]) -> np.ndarray:
    numbers: dict[bytes, int] = {}
    return np.fromiter((numbers.setdefault(x, len(numbers)) for x in words), np.int32, len(words))


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """One row per document: id, n_words, runs (array of start, length, period, by start, then period), collapsed.

    Words are runs of other bytes than blanks and line ends; ``collapsed`` is the text with one copy of what each run
    repeats, words joined by single blanks. Null and empty texts have no words, no runs and an empty collapsed text.
    Texts are read whole: one of n words takes n log n tests in one task, and some 100 bytes a word. Repeated rows give
    repeated results; an empty table an empty one; only the two named columns are read, so others cannot clash.
    """

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, runs, texts = [], [], []
            for text in b.column("text"):
                # bytes.split cuts at the six ASCII white-space bytes alone
                words = (text.as_py() or b"").split()
                own = periodic_stretches(numbered(words), least)
                sizes.append(len(words))
                runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in own])
                texts.append(collapsed(words, own))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(sizes, pa.int64()), pa.array(runs, _RUNS), pa.array(texts, pa.binary()).cast(pa.string())], ["id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(found, f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string").withColumnRenamed("id", id_col)
