"""Packing of documents into token sequences by Karmarkar-Karp multiway differencing.

A document's ids are cut into full sequences and a rest. The rests of a bucket of documents are dealt to as few windows
as their sum needs: partial partitions, at first one for each rest, are merged two at a time, those of the largest
imbalance first, the fullest windows of one with the emptiest of the other. Where a window exceeds the capacity, the
window count rises and the bucket is dealt again.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import tokenizer
from .shared import rows_of

CAPACITY = 1024
END = b"\0\0\0\0"
#: Documents in a bucket, on average; a bucket is dealt by one task.
BUCKET = 1024
#: A rest of at least this many ids is cut once more: its last ids, about this share, are small change that evens windows out.
CHANGE_FROM, CHANGE = 48, 12


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    full = n - n % capacity
    out = [(i, capacity) for i in range(0, full, capacity)]
    rest = n - full
    if rest >= CHANGE_FROM:
        small = max(4, rest // CHANGE)
        out += [(full, rest - small), (n - small, small)]
    elif rest:
        out.append((full, rest))
    return out


def differencing(sizes: np.ndarray, windows: int) -> np.ndarray:
    """For each size, the window that it gets; sums of windows come out nearly equal."""
    n = len(sizes)
    after = np.full(n, -1)  # the next size in the same window
    # a partial partition: sums in falling order, first and last size of each window; windows that are empty are left out
    parts = [(np.array([s]), np.array([i]), np.array([i])) for i, s in enumerate(sizes.tolist())]
    heap = [(-s, i) for i, s in enumerate(sizes.tolist())]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, x = heapq.heappop(heap)
        _, y = heap[0]
        (sa, fa, la), (sb, fb, lb) = parts[x], parts[y]
        both = max(0, len(sa) + len(sb) - windows)  # the smallest of each meet the largest of the other
        if both:
            p, q = len(sa) - both, len(sb) - both
            # window i of x, from p on, goes with window (last - (i - p)) of y
            ia, ib = np.arange(p, len(sa)), np.arange(len(sb) - 1, q - 1, -1)
            after[la[ia]] = fb[ib]
            s = np.concatenate([sa[:p], sb[:q], sa[ia] + sb[ib]])
            f = np.concatenate([fa[:p], fb[:q], fa[ia]])
            la = np.concatenate([la[:p], lb[:q], lb[ib]])
        else:
            s, f, la = np.concatenate([sa, sb]), np.concatenate([fa, fb]), np.concatenate([la, lb])
        order = np.argsort(-s, kind="stable")
        s = s[order]
        parts[y], parts[x] = (s, f[order], la[order]), None
        heapq.heapreplace(heap, (-int(s[0] - (s[-1] if len(s) == windows else 0)), y))
    out = np.empty(n, dtype=np.int64)
    for w, i in enumerate(parts[heap[0][1]][1].tolist() if n else []):
        while i >= 0:
            out[i] = w
            i = after[i]
    return out


def deal(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """For each size, its window, with no window over the capacity."""
    windows = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        at = differencing(sizes, windows)
        if not len(at) or np.bincount(at, sizes).max() <= capacity:
            return at
        windows += max(1, windows // 256)


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece of each row of docs: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each row's text is encoded and gets id 0 at its end, so a null or empty text is one id. Rows that repeat are packed
    as often as they come, ids may be null; other columns are ignored, whatever their names. Sequence ids are unique, not
    consecutive. A long text is many pieces, of which all but the last are full. An empty table gives an empty result.
    """
    src = docs.select(id_col, text_col)
    kind = src.schema[0].dataType.simpleString()
    buckets = max(1, -(-src.count() // BUCKET))
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "seq"]

    def pieces(batches):
        own, seq = tokenizer(path, whole_words=True), TaskContext.get().partitionId() << 40
        for b in rows_of(batches):
            rows = ([], [], [], [], [], [])
            for k, text in enumerate(b.column(1).to_pylist()):
                ids = own.encode(text) + END
                for start, length in cuts(len(ids) // 4, capacity):
                    for to, x in zip(rows, (k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), len(ids) // 4, seq), strict=True):
                        to.append(x)
                    seq += 1
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows[0], pa.int64()))] + [pa.array(x, pa.int64()) for x in rows[1:]], names)

    def dealt(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["seq"], ignore_index=True)
        full = (rows["length"] == capacity).to_numpy()
        at = np.empty(len(rows), dtype=np.int64)
        at[full] = np.arange(full.sum())
        at[~full] = full.sum() + deal(rows["length"].to_numpy()[~full], capacity)
        rows["sequence_id"] = at * buckets + key[0]
        rows["offset"] = rows["length"].groupby(at).cumsum() - rows["length"]
        return rows.drop(columns=["seq", "bucket"])

    made = src.mapInArrow(pieces, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, seq long")
    made = made.withColumn("bucket", F.pmod(F.xxhash64("seq"), F.lit(buckets)))
    return made.groupBy("bucket").applyInPandas(dealt, f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
