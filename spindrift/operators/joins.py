"""Joins that code analysis needs: by containment, range, prefix, candidates, position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 64
#: Rows that a catalog may have to be broadcast by hint.
SMALL = 10_000


def lookup(rows: DataFrame, catalog: DataFrame, on: str, default: dict) -> DataFrame:
    """Left join to a catalog, with defaults for what it lacks. It is broadcast if it is small; a large one is joined as Spark sees fit."""
    return rows.join(F.broadcast(catalog) if small(catalog) else catalog, on, "left").fillna(default)


def small(catalog: DataFrame) -> bool:
    return catalog.limit(SMALL + 1).count() <= SMALL


def containing(rows: DataFrame, catalog: DataFrame, name: Column, entry: Column, order: Column, keys: list[str]) -> DataFrame:
    """The first catalog entry, in its order, that contains the name or is contained in it. Every name meets every entry, so the catalog must be small."""
    if not small(catalog):
        raise ValueError(f"a catalog for `containing` has {SMALL} rows at most")
    hit = (F.instr(name, entry) > 0) | (F.instr(entry, name) > 0)
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.join(F.broadcast(catalog), hit).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def contained_in(points: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, bucket: int = BUCKET) -> DataFrame:
    """Points within spans of the same key. Spans are cut into buckets of lines, so that it is an equi-join."""
    p = points.withColumn("__b", F.floor(F.col(at) / bucket))
    s = spans.withColumn("__b", F.explode(F.sequence(F.floor(F.col(start) / bucket), F.floor(F.col(end) / bucket))))
    return p.join(s, [key, "__b"]).where(F.col(at).between(F.col(start), F.col(end))).drop("__b")


def near(points: DataFrame, others: DataFrame, key: str, at: str, other_at: str, within: int, how: str) -> DataFrame:
    """Points with (left_semi) or without (left_anti) another of the same key at most so many lines away. Each of the others
    stands in the buckets that it can be near to. Both sides grow with the corpus, so they are merged and neither is broadcast."""
    width = max(BUCKET, 2 * within)
    p = points.withColumn("__b", F.floor(F.col(at) / width))
    low, high = (F.floor((F.col(other_at) + d) / width) for d in (-within, within))
    o = others.select(F.col(key).alias("__k"), F.col(other_at).alias("__at"), F.explode(F.array_distinct(F.array(low, high))).alias("__ob"))
    hit = (p[key] == o["__k"]) & (p["__b"] == o["__ob"]) & (F.abs(p[at] - o["__at"]) <= within)
    return p.join(o.hint("merge"), hit, how).drop("__b")


def longest_prefix(rows: DataFrame, prefixes: DataFrame, name: str, prefix: str, keys: list[str]) -> DataFrame:
    """Each row with its longest prefix. A row is looked up once for each length that some prefix has and that it is long enough for: an equi-join."""
    lengths = sorted(r[0] for r in prefixes.select(F.length(prefix)).where(F.col(prefix).isNotNull()).distinct().collect())  # as many as the longest prefix has characters
    cuts = F.transform(F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda i: i <= F.length(name)), lambda i: F.substring(F.col(name), F.lit(1), i))
    found = rows.withColumn("__p", F.explode(cuts)).join(prefixes, F.col("__p") == F.col(prefix)).drop("__p")
    w = Window.partitionBy(*keys).orderBy(F.desc(F.length(prefix)))
    return found.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def candidates(refs: DataFrame, files: DataFrame, first: Column, second: Column) -> DataFrame:
    """Each reference with the first of two candidate paths that exists (resolved), or null."""
    f1, f2 = (files.select(F.col("path").alias(n)).distinct() for n in ("__p1", "__p2"))
    got = refs.join(f1, first == F.col("__p1"), "left").join(f2, second == F.col("__p2"), "left")
    return got.withColumn("resolved", F.coalesce("__p1", "__p2")).drop("__p1", "__p2")


def arguments_to_parameters(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """calls (call_id, callee, args) and functions (name, params), arrays of names: (call_id, callee, idx, arg, param)."""
    a = calls.select("call_id", "callee", F.posexplode("args").alias("idx", "arg"))
    p = functions.select(F.col("name").alias("callee"), F.posexplode("params").alias("idx", "param"))
    return a.join(p, ["callee", "idx"])
