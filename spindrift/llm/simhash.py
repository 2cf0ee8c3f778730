"""SimHash near-dedup with vantage-point trees.

A linked pair differs in 3 bits or fewer, so in one of a fingerprint's two halves it differs in 1 or none. Each half has
a vantage-point tree of its own: a node has a vantage point and a median distance, and parts the points in those within
and those beyond. Every fingerprint rests in one shard (leaf). To meet all others it also visits each shard that the
triangle bound can't rule out, those whose side of the median begins within 1 bit of its own distance. Trees have a fixed
depth until shards would outgrow a task, so rows grow with the fingerprints. A shard that holds too many all the same, as
where very many share a half, is parted again by a tree over whole fingerprints, with a bound of 3 bits. Within a shard,
pairs are found by equal quarters, of which a linked pair has one. Each shard gives its links as stars, and the stars are
joined to whole components by alternating large-star and small-star steps. Equal fingerprints count once, so copies are
never paired.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written
from .shared import only_kept, rows_of, text_sha

SHINGLE = 3
MAX_BITS = 3
#: Halves of a fingerprint, and the bits that a linked pair can differ by in the closer one.
HALVES, HALF_BITS = 2, MAX_BITS // 2
#: Fingerprints that rest in a shard, on average, at most; levels of a tree at least. With 2**LEVELS shards, a fingerprint visits some seven.
SHARD, LEVELS = 131_072, 8
#: A shard with more rows than this, visitors included, is parted again.
HOT = 16 * SHARD
#: Distinct fingerprints that vantage points and medians are taken from: about as many at most, by hash.
SAMPLE = 65_536
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits; bit i is 1 if it is in over half of the shingles' XXH64. Words are parted by ASCII white space, A-Z lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if (n := len(words) - shingle + 1) < 2:
        return xxhash.xxh64_intdigest(joined, 42)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends - lengths + 1).tolist()
    digest = xxhash.xxh64_digest
    counts = np.zeros(64, np.int64)
    stops = ends[shingle - 1 :].tolist()
    for k in range(0, n, _CHUNK):
        hashes = b"".join([digest(joined[a:b], 42) for a, b in zip(starts[k : k + _CHUNK], stops[k : k + _CHUNK], strict=False)])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, sha (of the text) and fp (the fingerprint as a signed long) of each row of docs."""

    def run(batches):
        for b in rows_of(batches):
            fps = np.array([fingerprint(t) for t in b.column(2).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64())], ["id", "sha", "fp"])

    src = docs.select(F.col(id_col).alias("id"), text_sha(text_col).alias("sha"), text_col)
    return src.mapInArrow(run, f"id {src.schema[0].dataType.simpleString()}, sha string, fp long")


def _half(fps: np.ndarray, tree: int) -> np.ndarray:
    return (fps.view(np.uint64) >> np.uint64(32 * tree)).astype(np.uint32)


class Tree:
    """A vantage-point tree of fixed depth over points of some bits; nodes are numbered as in a heap, from 1. Shards are for pairs that differ by radius at most."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int, radius: int):
        rng = np.random.default_rng(seed)
        self.depth, self.radius, kind = depth, radius, sample.dtype
        self.points = rng.integers(0, np.iinfo(kind).max, 1 << depth, dtype=kind, endpoint=True)
        self.medians = np.full(1 << depth, 4 * kind.itemsize - 1, np.int16)  # where the sample is too thin: the middle of random points
        nodes = [(1, sample)]
        while nodes:
            node, own = nodes.pop()
            if node >= 1 << depth:
                continue
            if len(own) >= 8:
                self.points[node] = own[rng.integers(len(own))]
                far = np.bitwise_count(own ^ self.points[node])
                self.medians[node] = max(int(np.median(far)) - 1, 0)
                inside = far <= self.medians[node]
                nodes += [(2 * node, own[inside]), (2 * node + 1, own[~inside])]

    def shards(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, shard) of all visits."""
        at, node = np.arange(len(points)), np.ones(len(points), np.int64)
        for _ in range(self.depth):
            far, median = np.bitwise_count(points[at] ^ self.points[node]).astype(np.int16), self.medians[node]
            inside = far <= median
            over = np.where(inside, far + self.radius > median, far - self.radius <= median)  # the bound doesn't rule out the other side
            node = 2 * node + ~inside
            at, node = np.concatenate([at, at[over]]), np.concatenate([node, node[over] ^ 1])
        return at, node


def _stars(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, least member) of each component that the links among fps make."""
    fps = np.unique(fps)
    bits, label = fps.view(np.uint64), np.arange(len(fps))
    for quarter in range(4):  # 3 bits leave one of four quarters as it is
        key = ((bits >> np.uint64(16 * quarter)) & np.uint64(0xFFFF)).astype(np.uint16)
        order = np.argsort(key, kind="stable")
        key, own = key[order], bits[order]
        at = np.arange(len(key))
        for d in range(1, len(key)):
            at = at[at + d < len(key)]
            at = at[key[at] == key[at + d]]
            if not len(at):
                break
            near = at[np.bitwise_count(own[at] ^ own[at + d]) <= MAX_BITS]
            a, b = label[order[near]], label[order[near + d]]  # labels are roots here, so that only pairs that join something are looped over
            if (new := a != b).any():
                for x, y in np.unique(np.stack([a[new], b[new]]), axis=1).T.tolist():
                    while label[x] != x:
                        x = label[x]
                    while label[y] != y:
                        y = label[y]
                    label[max(x, y)] = min(x, y)
                while (label != label[label]).any():
                    label = label[label]
    member = label != np.arange(len(fps))
    return fps[member], fps[label[member]]


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b), a > b, that connect all of fps' distinct values (fp) that differ in 3 bits or fewer, through any number of links."""
    spark = fps.sparkSession
    count = fps.count()
    depth = max(LEVELS, (count // SHARD).bit_length())
    sample = np.sort(np.array([r[0] for r in fps.where(F.pmod(F.xxhash64("fp"), F.lit(max(1, -(-count // SAMPLE)))) == 0).collect()], np.int64))
    trees = [Tree(_half(sample, t), depth, t, HALF_BITS) for t in range(HALVES)]
    sent = spark.sparkContext.broadcast((trees, {}))

    def visits(batches, sent=sent):
        trees, hot = sent.value
        for b in rows_of(batches, 10_000):
            own = b.column(0).to_numpy()
            for t, tree in enumerate(trees):
                at, node = tree.shards(_half(own, t))
                shard, part = node * HALVES + t, np.zeros(len(at), np.int64)
                yield from (pa.RecordBatch.from_arrays([pa.array(x) for x in y], ["shard", "part", "fp"]) for y in parted(shard, part, own[at], hot))

    def parted(shard, part, own, hot):
        if hot:
            full = np.isin(shard, list(hot))
            for s in np.unique(shard[full]).tolist():
                mine = own[shard == s]
                at, node = hot[s].shards(mine.view(np.uint64))
                yield np.full(len(at), s), node, mine[at]
            shard, part, own = shard[~full], part[~full], own[~full]
        yield shard, part, own

    def within(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = _stars(rows["fp"].to_numpy())
        return pd.DataFrame({"a": a, "b": b})

    rows = "shard long, part long, fp long"
    if count > HOT:  # else no shard can have as many rows of one tree
        sizes = fps.mapInArrow(visits, rows).groupBy("shard").count().where(F.col("count") > HOT).collect()  # as many as there are shards at most
        if sizes:
            whole, own = sample.view(np.uint64), {}
            for k, (shard, n) in enumerate(sizes):
                at, node = trees[shard % HALVES].shards(_half(sample, shard % HALVES))
                own[shard] = Tree(whole[at[node * HALVES + shard % HALVES == shard]], (n // SHARD).bit_length(), HALVES + k, MAX_BITS)
            sent = spark.sparkContext.broadcast((trees, own))
    found = fps.mapInArrow(lambda batches, sent=sent: visits(batches, sent), rows)
    return found.groupBy("shard", "part").applyInPandas(within, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b): each node a that isn't the least of its component, with the least, b. edges: (a, b), in any order."""
    least = F.least("a", "b").alias("b")
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), least).distinct(), "edges")
    before = None
    while True:
        # large star: each larger neighbour goes to the least of the neighbourhood
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        top = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(top, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large, "large-star")
        # small star: each smaller neighbour, and the node itself
        top = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(top, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = written(small.unionByName(top.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            return now
        before = state


def simhash_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, sha, fp and component_id of each row of docs."""
    rows = written(fingerprints(docs, id_col, text_col), "fingerprints")
    fps = written(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    roots = components(links(fps.select("fp")))
    marked = fps.join(roots.withColumnRenamed("a", "fp"), "fp", "left").select("fp", "least", F.coalesce("b", "fp").alias("root"))
    marked = written(marked, "roots")
    ids = marked.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(written(marked.join(ids, "root").select("fp", "component_id"), "component-ids"), "fp")


def simhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row of docs with its fingerprint (16 lowercase hex digits) and component_id, the least id reachable over links.

    Null and empty texts, and texts without words, have fingerprint zero and link like any other. Whole texts are read,
    however long. Rows may repeat. Null ids are passed over when the least is taken; a component of null ids alone has a
    null component_id. Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return simhash_rows(docs, id_col, text_col).select(F.col("id").alias(id_col), hexed.alias("fingerprint"), "component_id")


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each component, with all its columns: that of the least id; of rows that share it, that of the least SHA-256.

    Null and empty texts are one component with what links to them. Null ids are passed over; of components of null ids
    alone the row of the least SHA-256 stays. Of rows that repeat id and text one stays, as `only_kept` says. An empty
    table stays empty.
    """
    rows = simhash_rows(docs, id_col, text_col)
    rows = rows.withColumn("group", F.struct("component_id", F.when(F.col("component_id").isNull(), F.col("fp"))))
    first = F.min(F.when(F.col("id").eqNullSafe(F.col("component_id")), F.col("sha"))).alias("first")
    firsts = rows.groupBy("group").agg(first)
    found = rows.join(firsts, "group").select("id", "sha", (F.col("id").eqNullSafe(F.col("component_id")) & (F.col("sha") == F.col("first"))).alias("kept"))
    return only_kept(docs, found, id_col, text_col)
