"""A Merkle manifest of a dataset, and proofs of its rows by looking up coordinates.

Each row is a leaf; the rows of a source, in order of id, are the leaves of its tree, and the sources' roots are the leaves
of the last tree. Nodes are materialised as a table: tree, level, position and digest. What a row's proof needs follows
from its index and the size of its group alone: at each level the other nodes of its run of ARITY. These coordinates are
exploded, joined with the table, put in order and concatenated; folding the row's leaf with them gives the root.

Rows are numbered without gathering a source anywhere: they are sorted over range partitions, and a partition's rows of a
source begin where those of the partitions before end. Upper levels, which many rows ask for, have few nodes: these are
broadcast as far as NEAR nodes go, so that no node that is joined by a shuffle is asked for by more than a small part of
all rows. Everything is a DataFrame expression.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written

ARITY = 3
#: Nodes of each kind of tree that are broadcast at most, about 3 MB.
NEAR = 1 << 15
#: The tree whose leaves are the sources' roots; those of sources are numbered from 0.
TOP = -1
#: Powers of the arity within 64 bits.
_POWERS = [ARITY**i for i in range(40) if ARITY**i < 2**63]


class Manifest(NamedTuple):
    """leaves: at (a number), id, leaf, shown, tree, pos, n, trees. nodes and top_nodes: by level (tree, pos, n, digest). root: hex, None if there are no rows."""

    leaves: DataFrame
    nodes: list[DataFrame]
    top_nodes: list[DataFrame]
    root: str | None


def hashed(parts: Column) -> Column:
    """Lowercase hex SHA-256 of strings put together."""
    return F.sha2(F.array_join(parts, "").cast("binary"), 256)


def leaf(values: list[Column]) -> Column:
    """The digest of a row: of each value `-` if null, else its number of bytes, a colon and the value itself."""
    texts = [v.cast("string") for v in values]
    return hashed(F.array(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]))


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def _div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)


def _numbered(rows: DataFrame, group: str, order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """rows with at (a number of its own), pos (from 0, within the group) and n (rows of the group); and each group (label)."""
    keys = [group, *order]
    rows = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), name)
    rows = rows.withColumn("part", F.shiftright("at", 33))
    parts = rows.groupBy("part", F.col(group).alias("of")).agg(F.min("at").alias("first"), F.count("*").alias("c"))
    whole = Window.partitionBy("of")  # as many rows as there are partitions, at most
    before = F.coalesce(F.sum("c").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = written(parts.select("part", "of", (before - F.col("first")).alias("shift"), F.sum("c").over(whole).alias("n")), f"{name}-parts")
    parts_ = parts.withColumnRenamed("part", "in")
    out = rows.join(parts_, (F.col("part") == F.col("in")) & F.col(group).eqNullSafe(F.col("of")))
    return out.withColumn("pos", F.col("at") + F.col("shift")).drop("part", "in", "of", "shift"), parts.select(F.col("of").alias("label")).distinct()


def _levels(leaves: DataFrame, name: str) -> list[DataFrame]:
    """Of trees with leaves (tree, pos, n, digest), the nodes of each level; each is written, and has a third of the one before."""
    levels, most = [leaves], leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        own = F.array_sort(F.collect_list(F.struct("pos", "digest")))
        up = levels[-1].where("n > 1").groupBy("tree", _div(F.col("pos"), ARITY).alias("pos"), _div(F.col("n") + ARITY - 1, ARITY).alias("n")).agg(own.alias("own"))
        up = up.select("tree", "pos", "n", F.unhex(hashed(F.transform("own", lambda x: _hex(x.digest)))).alias("digest"))
        levels.append(written(up, f"{name}-{len(levels)}"))
        most = -(-most // ARITY)
    return levels


def _top(levels: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [x.where("n = 1") for x in levels])


def manifest(docs: DataFrame, values: list[Column], shown: Column | None = None, id_col: str = "doc_id", group_col: str = "source") -> Manifest:
    """The trees over docs, by the digests of these values. shown: digests that proofs are tried on, if not the same.

    Within a group rows are in order of id (null first), then of digest; rows alike in both have the same digest, so
    their order doesn't matter. Groups are in order of UTF-8 bytes, null first. Columns of docs may have any names.
    """
    mine = leaf(values)
    src = docs.select(F.col(group_col).alias("group"), F.col(id_col).alias("id"), F.unhex(mine).alias("digest"), F.unhex(mine if shown is None else shown).alias("shown"))
    src = written(src.withColumn("row", F.monotonically_increasing_id()), "manifest-rows")
    rows, groups = _numbered(src, "group", ["id", "digest", "row"], "manifest-leaves")
    groups, _ = _numbered(groups.select(F.lit(0).alias("all"), "label"), "all", ["label"], "manifest-groups")
    groups = written(groups.select("label", F.col("pos").alias("tree"), F.col("n").alias("trees")), "manifest-trees")
    rows = rows.join(groups, F.col("group").eqNullSafe(F.col("label")))
    rows = written(rows.select("at", "id", "digest", "shown", "tree", "pos", "n", "trees"), "manifest-numbered")
    nodes = _levels(rows.select("tree", "pos", "n", "digest"), "nodes")
    tops = _top(nodes).join(groups, "tree").select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("pos"), F.col("trees").alias("n"), "digest")
    top_nodes = _levels(written(tops, "subroots"), "top-nodes")
    root = _top(top_nodes).select(_hex(F.col("digest"))).first()
    return Manifest(rows, nodes, top_nodes, root and root[0])


def _steps(pos: Column, n: Column, step) -> Column:
    """For each level below the root, from the leaves up: step(level, position of the run's first node, own place in the run, nodes of the run)."""

    def level(power: Column, i: Column) -> Column:
        at, wide = _div(pos, power), _div(n + power - 1, power)
        slot = at % ARITY
        return step(i, at - slot, slot.cast("int"), F.least(F.lit(ARITY), wide - at + slot).cast("int"))

    return F.transform(F.filter(F.array(*[F.lit(p).cast("long") for p in _POWERS]), lambda p: p < n), level)


def path(pos: Column, n: Column) -> Column:
    """Of each level the own place in the run, and how many nodes the run has."""
    return _steps(pos, n, lambda i, first, slot, size: F.struct(slot.alias("slot"), size.alias("size")))


def coordinates(tree: Column, pos: Column, n: Column) -> Column:
    """(tree, level, pos) of all siblings, level by level, left to right."""

    def siblings(i, first, slot, size):
        others = F.filter(F.array(*[F.lit(s) for s in range(ARITY)]), lambda s: (s < size) & (s != slot))
        return F.transform(others, lambda s: F.struct(tree.alias("tree"), i.cast("int").alias("level"), (first + s).alias("pos")))

    return F.flatten(_steps(pos, n, siblings))


def folded(start: Column, siblings: Column, path: Column) -> Column:
    """The root that a leaf and its siblings, in order, lead to; hex."""

    def up(now: Column, step: Column) -> Column:
        left = F.slice(siblings, now["next"], step["slot"])
        right = F.slice(siblings, now["next"] + step["slot"], step["size"] - 1 - step["slot"])
        return F.struct(hashed(F.concat(left, F.array(now["digest"]), right)).alias("digest"), (now["next"] + step["size"] - 1).alias("next"))

    return F.aggregate(path, F.struct(start.alias("digest"), F.lit(1).alias("next")), up)["digest"]


def _split(levels: list[DataFrame]) -> tuple[int, list[DataFrame]]:
    """The first level from which on all nodes together are few enough to be broadcast."""
    counts = [x.count() for x in levels]
    first = next(i for i in range(len(levels) + 1) if sum(counts[i:]) <= NEAR)
    return first, [x.select("tree", F.lit(i).alias("level"), "pos", "digest") for i, x in enumerate(levels)]


def proofs(made: Manifest) -> DataFrame:
    """For each leaf: id, leaf, shown, subroot (hex), path and siblings (hex, level by level, left to right)."""
    cuts, tables = zip(_split(made.nodes), _split(made.top_nodes), strict=True)
    near = [t for cut, own in zip(cuts, tables, strict=True) for t in own[cut:]]
    far = [t for cut, own in zip(cuts, tables, strict=True) for t in own[:cut]]
    top = F.lit(TOP).cast("long")
    wanted = F.concat(coordinates(F.col("tree"), F.col("pos"), F.col("n")), coordinates(top, F.col("tree"), F.col("trees")))
    is_near = (F.col("c.level") >= F.when(F.col("c.tree") == TOP, cuts[1]).otherwise(cuts[0]))
    asked = lambda df: df.select("at", F.posexplode(wanted).alias("ord", "c"))
    given = lambda df, nodes: df.select("at", "ord", "c.*").join(nodes, ["tree", "level", "pos"]).groupBy("at").agg(F.collect_list(F.struct("ord", "digest")).alias("own"))
    rows = out = made.leaves.repartition("at")  # what is broadcast finds the rows where their proofs are put together
    for k, (nodes, which) in enumerate(((near, is_near), (far, ~is_near))):
        if nodes:
            nodes = reduce(DataFrame.unionByName, nodes)
            found = given(asked(rows if k == 0 else made.leaves).where(which), F.broadcast(nodes) if k == 0 else nodes)
            out = out.join(found.withColumnRenamed("own", f"own{k}"), "at", "left")
        else:
            out = out.withColumn(f"own{k}", F.lit(None).cast("array<struct<ord:int,digest:binary>>"))
    none = F.expr("cast(array() as array<struct<ord:int,digest:binary>>)")
    own = F.array_sort(F.concat(*[F.coalesce(F.col(f"own{k}"), none) for k in range(2)]))
    subroots = made.top_nodes[0].select(F.col("pos").alias("tree"), F.col("digest").alias("subroot"))
    out = out.join(subroots, "tree")
    return out.select(
        "id",
        _hex(F.col("digest")).alias("leaf"),
        _hex(F.col("shown")).alias("shown"),
        _hex(F.col("subroot")).alias("subroot"),
        F.concat(path(F.col("pos"), F.col("n")), path(F.col("tree"), F.col("trees"))).alias("path"),
        F.transform(own, lambda x: _hex(x.digest)).alias("siblings"),
    )


def verified(docs: DataFrame, values: list[Column], shown: list[Column] | None = None, id_col: str = "doc_id", group_col: str = "source") -> DataFrame:
    """A row for each row of docs: id, leaf, subroot, root, siblings, folded_root and verified.

    Leaves are of values. What is folded with the siblings is the digest of shown, values as they are found later, and
    a row is verified if that leads to the root. A null value is told apart from an empty one; null sources are a group,
    the first; null ids come first in their group. Rows that repeat are leaves of their own. Long texts are hashed whole
    where they are read and go no further. Other columns are ignored, whatever their names. An empty table has no root
    and gives no rows.
    """
    made = manifest(docs, values, None if shown is None else leaf(shown), id_col, group_col)
    out = proofs(made).withColumn("root", F.lit(made.root).cast("string"))
    out = out.withColumn("folded_root", folded(F.col("shown"), F.col("siblings"), F.col("path")))
    return out.select(F.col("id").alias(id_col), "leaf", "subroot", "root", "siblings", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
