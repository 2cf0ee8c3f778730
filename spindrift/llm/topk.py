"""Exact top-k inner-product search by distributed histogram selection.

Queries come in blocks of bounded size, each broadcast and scored against all rows. The first pass gives the range of each
query's scores; each further pass counts scores in the bins of a histogram of the part that holds the kth highest, until
a bin is one score wide. That kth value is then known, one more pass keeps the scores from it upwards, and ties are broken
by id. What meets in the driver or in one task is one histogram or k rows for each query of a block.
"""

from __future__ import annotations

import math
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written
from .shared import rows_of

SCALE = 1024
BINS = 64
#: Queries that are broadcast at a time, and scores that a Python worker holds of them at a time.
BLOCK, SCORES = 8192, 1 << 21
_EXACT = 2**53


def integers(column: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, floor(1024 * x) of their components) for each length of vector; rows with nulls or non-finite components are left out.

    Rows with components that a double can't hold 1024 times are an entry of their own, of Python's integers.
    """
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    out = []
    for d in np.unique(lengths[lengths >= 0]).tolist():
        rows = np.flatnonzero(lengths == d)
        x = column.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rows), d)
        good = np.isfinite(x).all(axis=1)
        huge = good & (np.abs(x) > np.finfo(np.float64).max / SCALE).any(axis=1)
        good &= ~huge
        out.append((rows[good], np.floor(SCALE * x[good])))
        if huge.any():
            exact = np.array([[math.floor(SCALE * Fraction(c)) for c in row] for row in x[huge].tolist()], object)
            out.append((rows[huge], exact))
    return out


def _product(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products as exact integers; in Python's integers if doubles can't hold them."""
    doubles = x.dtype != object and q.dtype != object
    if not x.size or not q.size or doubles and np.abs(x).max() * np.abs(q).max() * x.shape[1] < _EXACT:
        return (x.astype(np.float64) @ q.astype(np.float64).T).astype(np.int64) if doubles else np.zeros((len(x), len(q)), np.int64)
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(x) @ whole(q).T, -(2**63) + 1, 2**63 - 1).astype(np.int64)


class Queries:
    """A block of queries: ids in rising order, and for each length of vector the queries that have it."""

    def __init__(self, rows: list[tuple[int, list[float]]]):
        rows = sorted(rows)
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.by_length: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for at, x in integers(pa.array([r[1] for r in rows], pa.list_(pa.float64()))):
            if len(at):
                self.by_length.setdefault(x.shape[1], []).append((at, x))

    def scores(self, batch: pa.RecordBatch):
        """(row ids, queries, scores, which of the scores count) for each length of vector. A query's own id doesn't count."""
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for rows, x in integers(batch.column(1)):
            for at, q in self.by_length.get(x.shape[1], ()) if len(rows) else ():
                yield ids[rows], at, _product(x, q), ids[rows][:, None] != self.ids[at][None, :]


def _block(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    spark = vectors.sparkSession
    block = Queries([(r[0], r[1]) for r in queries.collect()])
    sent, n = spark.sparkContext.broadcast(block), len(block.ids)

    def ranges(batches):
        low, high, total = np.full(n, 2**63 - 1), np.full(n, -(2**63)), np.zeros(n, np.int64)
        for b in rows_of(batches, max(16, SCORES // max(n, 1))):
            for _, at, s, counts in sent.value.scores(b):
                low[at] = np.minimum(low[at], np.where(counts, s, 2**63 - 1).min(axis=0))
                high[at] = np.maximum(high[at], np.where(counts, s, -(2**63)).max(axis=0))
                total[at] += counts.sum(axis=0)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(x[seen]) for x in (np.arange(n), low, high, total)], ["q", "low", "high", "total"])

    found = vectors.mapInArrow(ranges, "q long, low long, high long, total long").groupBy("q").agg(F.min("low"), F.max("high"), F.sum("total")).collect()
    # the part of each query's scores that holds the kth, from low to high; widths of bins are rounded up, so the last bin may end past high
    low, high, width, above, done = np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
    for q, least, most, total in found:
        low[q], high[q] = least, most
        if total > k:  # else all of them are wanted
            width[q], done[q] = -(-(most - least + 1) // BINS), False
    counted = ["q", *(f"b{i}" for i in range(BINS))]
    while not done.all():
        state = spark.sparkContext.broadcast((low, high, width, done))

        def counts_(batches, state=state):
            low, high, width, done = state.value
            total = np.zeros((n, BINS), np.int64)
            for b in rows_of(batches, max(16, SCORES // max(n, 1))):
                for _, at, s, counts in sent.value.scores(b):
                    good = counts & (s >= low[at]) & (s <= high[at]) & ~done[at]
                    bins = (s.view(np.uint64) - low[at].view(np.uint64)) // width[at].view(np.uint64)  # of 64 bits, as the scores' range may be
                    flat = np.broadcast_to(np.arange(len(at)) * BINS, s.shape)[good] + bins[good].astype(np.int64)
                    total[at] += np.bincount(flat, minlength=len(at) * BINS).reshape(-1, BINS)
            seen = np.flatnonzero(total.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(seen), *(pa.array(total[seen, i]) for i in range(BINS))], counted)

        got = vectors.mapInArrow(counts_, ", ".join(f"{c} long" for c in counted))
        for q, *bins in got.groupBy("q").agg(*[F.sum(c) for c in counted[1:]]).collect():
            i = BINS - 1
            while above[q] + bins[i] < k:
                above[q] += bins[i]
                i -= 1
            low[q] = int(low[q]) + i * int(width[q])
            high[q] = min(int(high[q]), int(low[q]) + int(width[q]) - 1)
            if width[q] == 1:
                done[q] = True
            width[q] = -(-(int(high[q]) - int(low[q]) + 1) // BINS)
        state.unpersist()
    # low is now the kth value, or the least one, and above how many are higher
    last = spark.sparkContext.broadcast((low, k - above))

    def wanted(batches):
        """Scores from the kth upwards; of the equal ones, those of the least ids that this task has, as many as are wanted."""
        low, room = last.value
        ties: dict[int, list[int]] = {}
        for b in rows_of(batches, max(16, SCORES // max(n, 1))):
            for ids, at, s, counts in sent.value.scores(b):
                r, c = np.nonzero(counts & (s > low[at]))
                if len(r):
                    yield pa.RecordBatch.from_arrays([pa.array(sent.value.ids[at[c]]), pa.array(ids[r].astype(np.int64)), pa.array(s[r, c])], ["query_id", "vec_id", "score"])
                equal = counts & (s == low[at])
                for c in np.flatnonzero(equal.any(axis=0)).tolist():
                    q = int(at[c])
                    ties[q] = sorted(ties.get(q, []) + ids[equal[:, c]].tolist())[: int(room[q])]
        flat = [(q, i) for q, own in ties.items() for i in own]
        yield pa.RecordBatch.from_arrays([pa.array([int(sent.value.ids[q]) for q, _ in flat], pa.int64()), pa.array([i for _, i in flat], pa.int64()), pa.array([int(low[q]) for q, _ in flat], pa.int64())], ["query_id", "vec_id", "score"])

    return vectors.mapInArrow(wanted, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """The k highest inner products of each query with the other rows: query_id, rank (from 1), vec_id, score.

    Components are floor(1024 * x). Ties go to the smaller id. A query meets every row whose id differs from its own; a
    query id that repeats is one query, by its least vector; other rows that repeat are each a candidate. Vectors that are
    null or hold null or non-finite components take no part, nor do null ids; vectors of unlike lengths don't meet. Products
    and sums are exact, whatever doubles the components are; scores
    beyond 64 bits become the nearest long. Other columns are ignored, whatever their names; an empty table gives an empty
    result.
    """
    src = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    good = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    queries = src.where(is_query(F.col("id")) & good).groupBy("id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-queries.count() // block))
    parts = [_block(src, queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i), k) for i in range(blocks)]
    if blocks > 1:
        parts = [written(p, "top") for p in parts]
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
