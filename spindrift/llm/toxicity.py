"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its words, their stems (the first four and the first five letters, as compounds and endings are
many), pairs of adjacent words and pairs with one word between, hashed to a fixed number of buckets; a feature is present
or not. A stem that occurs twice, three times or four times has a feature for each of these, too: one compound may be
chance where several of one stem aren't. FTRL-proximal learns with a rate for each coordinate, and its L1 penalty leaves
few weights other than zero, which are broadcast: at most 2**BITS of them, whatever the input.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written
from .shared import rows_of

BITS = 20
#: Fitting is one task, whatever the input: it takes about as many labelled rows, and bytes of features, at most; which rows is by a hash of their ids.
SAMPLE, SAMPLE_BYTES = 12_000, 128 << 20
EPOCHS = 6
#: Occurrences of a stem that make a feature of their own.
OFTEN = (2, 3, 4)
#: FTRL-proximal's alpha, beta, L1 and L2.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 1.0
THRESHOLD = 0.3
_MASK = np.uint64((1 << BITS) - 1)
_PAIR, _SKIP, _MIX = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
_JUNK = re.compile(r"[\W_]+")


class _Tokens(dict):
    """A number for each token, made when first asked for, and by number the hashes of its word and of its two stems."""

    def __init__(self, limit: int):
        self.limit, self.hashes = limit, np.empty((1 << 12, 3), np.uint64)

    def __missing__(self, token: str) -> int:
        word, i = _JUNK.sub("", token.lower()), len(self)
        if i == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.empty_like(self.hashes)])
        self.hashes[i] = [xxhash.xxh64_intdigest(x, k) for k, x in enumerate((word, word[:4], word[:5]))]
        self[token] = i
        return i

    def of(self, tokens: list[str]) -> np.ndarray:
        if len(self) > self.limit:  # between texts only, as numbers mustn't change within one
            self.clear()
            self.hashes = np.empty((1 << 12, 3), np.uint64)
        at = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        return self.hashes[at]


_TOKENS = _Tokens(150_000)


def features(text: str | None) -> np.ndarray:
    """Buckets of a text's features, repeats included."""
    tokens = (text or "").split()
    if not tokens:
        return np.empty(0, np.int64)
    h = _TOKENS.of(tokens)
    w = h[:, 0]
    with np.errstate(over="ignore"):
        pairs = (w[:-1] * _PAIR ^ w[1:]) * _MIX
        skips = (w[:-2] * _SKIP ^ w[2:]) * _MIX
        stems, counts = np.unique(h[:, 1:], return_counts=True)
        often = [(stems[counts >= k] + np.uint64(k)) * _MIX for k in OFTEN]
    all_ = np.concatenate([h.ravel(), pairs, skips, *often])
    return ((all_ ^ all_ >> np.uint64(32)) & _MASK).astype(np.int64)


def fit(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """FTRL-proximal over (distinct buckets, label): the buckets whose weight isn't zero, their weights, and the bias."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bz = bn = 0.0
    weight = lambda z, n: np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    bias = lambda: -bz / ((BETA + math.sqrt(bn)) / ALPHA)
    for _ in range(epochs):
        for at, y in rows:
            zs, ns = z[at], n[at]
            w, b = weight(zs, ns), bias()
            g = _sigmoid(w.sum() + b) - y
            z[at] = zs + g - (np.sqrt(ns + g * g) - np.sqrt(ns)) / ALPHA * w
            n[at] = ns + g * g
            bz += g - (math.sqrt(bn + g * g) - math.sqrt(bn)) / ALPHA * b
            bn += g * g
    w = weight(z, n)
    at = np.flatnonzero(w)
    return at, w[at], bias()


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-min(60.0, max(-60.0, x))))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[np.ndarray, np.ndarray, float]:
    """Weights from the labelled rows of docs. labels: id and label (0 or 1); rows with a null in either are passed over.

    An id that docs repeats counts once, with the most features; one that labels repeats has its highest label. Null and
    empty texts are learned from as texts without features. Without labelled rows, every text scores one half of the
    threshold. Whole texts are read; SAMPLE and SAMPLE_BYTES bound what the one task that fits has to hold.
    """
    labels = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    labels = labels.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    sample = labels.where(F.pmod(F.xxhash64("id"), F.lit(max(1, -(-labels.count() // SAMPLE)))) == 0)

    def featured(batches):
        for b in rows_of(batches):
            made = [np.unique(features(t)).astype("<i4").tobytes() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.binary())], ["id", "y", "at"])

    def fitted(batches):
        rows = sorted(((h, i, y, at) for b in batches for h, i, y, at in zip(*(b.column(c).to_pylist() for c in ("h", "id", "y", "at")), strict=True)), key=lambda r: (r[0], str(r[1])))
        at, w, bias = fit([(np.frombuffer(at, "<i4"), y) for _, _, y, at in rows])
        yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int64()), pa.array([bias, *w.tolist()], pa.float64())], ["at", "w"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "id").select("id", "y", "text")
    rows = src.mapInArrow(featured, f"id {src.schema[0].dataType.simpleString()}, y int, at binary")
    rows = written(rows.groupBy("id", "y").agg(F.max(F.struct(F.octet_length("at").alias("n"), "at")).alias("most")).select("id", "y", "most.at", "most.n", F.xxhash64("id").alias("h")), "features")
    share = min(1.0, SAMPLE_BYTES / ((rows.agg(F.sum("n")).first()[0] or 0) + 1))
    rows = rows.where(F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1 << 20)) < int(share * (1 << 20)))
    got = np.array(rows.select("h", "id", "y", "at").coalesce(1).mapInArrow(fitted, "at long, w double").collect())
    if len(got) <= 1:
        half = THRESHOLD / 2
        return np.empty(0, np.int64), np.empty(0), math.log(half / (1 - half))
    got = got[np.argsort(got[:, 0])]
    return got[1:, 0].astype(np.int64), got[1:, 1], float(got[0, 1])


def _scorer(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray, float]):
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    table: list[np.ndarray] = []

    def of(text: str | None) -> float:
        if not table:
            table.append(np.zeros(1 << BITS))
            table[0][sent.value[0]] = sent.value[1]
        at = features(text)
        at = np.unique(at[table[0][at] != 0])
        return _sigmoid(table[0][at].sum() + sent.value[2])

    return of


def score(docs: DataFrame, weights: tuple[np.ndarray, np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row of docs with its score, 0 to 1: id and score.

    A null text counts as empty; empty texts get the score of a text without known features. Ids may be null and rows
    repeat; other columns are ignored, whatever their names. Whole texts are scored, however long, one row at a time. An
    empty table gives an empty result.
    """
    of = _scorer(docs, weights)

    def run(batches):
        for b in rows_of(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([of(t) for t in b.column(1).to_pylist()], pa.float64())], [id_col, "score"])

    src = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    return src.mapInArrow(run, f"`{id_col}` {src.schema[0].dataType.simpleString()}, score double")


def held_out(id_col: str = "doc_id"):
    """Rows whose labels aren't learned from: crc32 of the id as text, modulo 4, is 2. False for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that score under the threshold, with all their columns; labels as in learn, held-out ones aside.

    Rows are judged each by its own text, so rows that repeat stay or go together. Null and empty texts are judged as in
    score. No column is added on the way, and all are numbered while Python has them, so they may have any names. An empty
    table stays empty.
    """
    of = _scorer(docs, learn(docs, labels.where(~held_out(id_col)), id_col, text_col))
    at = docs.columns.index(text_col)

    def run(batches):
        for b in rows_of(batches):
            yield b.filter(pa.array([of(t) < THRESHOLD for t in b.column(at).to_pylist()], pa.bool_()))

    numbered = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    return numbered.mapInArrow(run, numbered.schema).toDF(*docs.columns)
