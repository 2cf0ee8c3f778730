"""Periodic runs of words by Main and Lorentz's divide and conquer.

Words of a batch get integer ids. A text is halved again and again. A run that crosses a midpoint has a period q for which
the words from the midpoint on, or those before it, equal the ones q further on or back; how far they do is what
Z-functions from the midpoint tell for all q, one to the right and one, of reversed words, to the left. What they find is
extended as far as the period goes, intervals that are found again are merged, and the smallest period is kept.

A run is LEAST words long at least and has EXPONENT periods, so the words that repeat themselves are at least STRETCH, of
which half lie on one side of the midpoint. Z-functions are therefore only worked out at midpoints where some stretch of
that half recurs, which one look at hashes tells for all midpoints of a level; equal stretches have equal hashes, so no
run is passed over, and what is reported rests on the words themselves.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import rows_of

#: Words of a run, at least, and periods in it.
LEAST, EXPONENT = 24, 3
#: Words that equal those a period further on, at least: the least of max(LEAST - q, (EXPONENT - 1) * q) over all q.
STRETCH = min(max(LEAST - q, (EXPONENT - 1) * q) for q in range(1, LEAST))
HALF = STRETCH // 2
_BASE = 0x9E3779B97F4A7C15

Run = tuple[int, int, int]


class _Ids(dict):
    """A word's id, given when it is first looked up."""

    def __init__(self):
        self.next = count()

    def __missing__(self, word: bytes) -> int:
        self[word] = n = next(self.next)
        return n


def z_function(pattern: list[int], text: list[int]) -> list[int]:
    """How many words of text from each place on equal those of pattern."""
    both = [*pattern, -1, *text]
    n, p = len(both), len(pattern)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and both[k] == both[i + k]:
            k += 1
        z[i] = k
        left, right = i, i + k
    return z[p + 1 :]


def _crossing(words: list[int], low: int, high: int) -> dict[tuple[int, int], int]:
    """Of repetitions within [low, high) that cross its midpoint: interval, and the smallest period that it was found with."""
    mid, own = (low + high) // 2, words[low:high]
    m = mid - low
    on = np.array(z_function(own[m:], own), np.int64)  # words from each place on that equal those from the midpoint on
    back = np.array(z_function(own[:m][::-1], own[::-1]), np.int64)[::-1]  # words up to each place that equal those up to the midpoint
    out: dict[tuple[int, int], int] = {}
    # the pairs of words a period apart that touch the midpoint with their first, and with their second word
    for sign, most in ((1, len(own) - m), (-1, m)):
        q = np.arange(1, most)
        at = m + sign * q
        right, left = on[at], back[at - 1]
        good = np.flatnonzero(right + left + q >= np.maximum(LEAST, EXPONENT * q))
        starts = np.where(sign > 0, m - left, m - q - left)[good] + low
        ends = np.where(sign > 0, m + right + q, m + right)[good] + low
        for a, z, p in zip(starts.tolist(), ends.tolist(), q[good].tolist(), strict=True):
            if out.get((a, z), p) >= p:
                out[a, z] = p
    return out


def _promising(grams: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Of segments, whether HALF words on either side of the midpoint stand anywhere else in the segment."""
    size = highs - lows
    begin = np.cumsum(size) - size
    own = grams[np.arange(size.sum()) - np.repeat(begin - lows, size)]
    mid = (lows + highs) // 2
    found = np.zeros(len(lows), bool)
    for at in (mid, mid - HALF):
        same = own == np.repeat(grams[at], size)
        found |= np.add.reduceat(same, begin, dtype=np.int64) > 1
    return found


def runs(ids: np.ndarray, lengths: np.ndarray) -> list[list[Run]]:
    """Of texts of so many words each: the runs (start, length, period), by start and period."""
    n = len(ids)
    out: list[list[Run]] = [[] for _ in lengths]
    if n < LEAST:
        return out
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE)
    mixed ^= mixed >> np.uint64(29)
    padded = np.concatenate([mixed, np.zeros(HALF, np.uint64)])
    grams = np.zeros(n, np.uint64)
    for k in range(HALF):
        grams = grams * np.uint64(_BASE) + padded[k : k + n]
    ends = np.cumsum(lengths)
    text = np.flatnonzero(lengths >= LEAST)
    lows, highs = (ends - lengths)[text], ends[text]
    words: dict[int, list[int]] = {}
    known: dict[int, dict[tuple[int, int], int]] = {}
    at: dict[tuple[int, int], list[tuple[int, int]]] = {}
    while len(lows):
        for k in np.flatnonzero(_promising(grams, lows, highs)).tolist():
            t = int(text[k])
            first = int(ends[t] - lengths[t])
            if t not in words:
                words[t], known[t] = ids[first : ends[t]].tolist(), {}
            own, have = words[t], known[t]
            for (a, z), q in _crossing(own, int(lows[k]) - first, int(highs[k]) - first).items():
                of = at.setdefault((t, q), [])
                if (i := bisect_right(of, (a, n))) and of[i - 1][1] >= z:
                    continue  # a part of what has been found already, with the same period: of one period, runs overlap by less than it
                while a and own[a - 1] == own[a - 1 + q]:
                    a -= 1
                while z < len(own) and own[z] == own[z - q]:
                    z += 1
                insort(of, (a, z))
                have[a, z] = min(have.get((a, z), q), q)
        mid = (lows + highs) // 2
        lows, highs, text = np.concatenate([lows, mid]), np.concatenate([mid, highs]), np.concatenate([text, text])
        long = highs - lows >= LEAST
        lows, highs, text = lows[long], highs[long], text[long]
    for t, have in known.items():
        out[t] = sorted((a, z - a, q) for (a, z), q in have.items())
    return out


def collapsed(words: list[bytes], found: list[Run]) -> bytes:
    """The words less those of each run after its first period, joined by spaces."""
    gone = bytearray(len(words))
    for start, length, period in found:
        gone[start + period : start + length] = b"\1" * (length - period)
    return b" ".join([w for w, g in zip(words, gone, strict=True) if not g])


def words_of(text: Column) -> Column:
    """What runs are made of: stretches of anything but space and the control characters 9 to 13."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row of docs with its runs, array<struct<start, length, period>> by start and period, and its text without them:
    the words that stay, joined by single spaces.

    A run is a stretch of words with smallest period q, of 24 words and 3 q at least, that can't be extended. Of each run
    the first q words stay, unless another run takes them. Words are parted by space and the control characters 9 to 13;
    a null text has none. Texts are worked on whole, each by itself, in time n log n and in memory that grows with the
    text; rows that repeat give the same. Ids may be null; other columns are ignored, whatever their names. An empty table
    gives an empty result.
    """

    def run(batches):
        for b in rows_of(batches):
            ids, texts = _Ids(), [(t or "").encode().split() for t in b.column(1).to_pylist()]  # of bytes, split() takes just these characters for white space
            lengths = np.array([len(t) for t in texts], np.int64)
            found = runs(np.fromiter((ids[w] for t in texts for w in t), np.int64, int(lengths.sum())), lengths)
            made = [collapsed(t, r).decode() if r else b" ".join(t).decode() for t, r in zip(texts, found, strict=True)]
            keys = ("start", "length", "period")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([[dict(zip(keys, r, strict=True)) for r in own] for own in found], kind), pa.array(made, pa.string())], [id_col, "runs", "text"])

    kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))
    src = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    return src.mapInArrow(run, f"`{id_col}` {src.schema[0].dataType.simpleString()}, runs array<struct<start:long,length:long,period:long>>, text string")
