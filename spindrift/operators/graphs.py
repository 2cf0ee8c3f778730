"""Graphs of calls and includes: closure, shortest paths, components, points-to sets, invalidation.

Fixed points end when a round finds nothing new, whatever number of rounds that takes; sets are finite, so it comes.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import dropped, written

#: Tables that a union of rounds holds before it is written as one.
ROUNDS = 8
#: Edges that a task solves at a time.
LOCAL = 1 << 16
#: Edges of a weak component whose pairs of nodes a task finds, and pairs that it may find at a time.
CLOSED = 1 << 10
PAIRS = 1 << 21
#: Edges that a task contracts at a time.
CHUNK = 1 << 18
#: How often nodes without edges to or from them are taken off before a round.
TRIMS = 2


def cut(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read again, so that a loop's plan doesn't grow and lost executors cost nothing."""
    return written(df, "round")


class _Known:
    """What a loop has found so far: a union of the rounds' tables, written as one when they are many."""

    def __init__(self, first: DataFrame):
        self.parts = [first]

    @property
    def rows(self) -> DataFrame:
        out = self.parts[0]
        for p in self.parts[1:]:
            out = out.unionByName(p)
        return out

    def add(self, fresh: DataFrame) -> None:
        self.parts.append(fresh)
        if len(self.parts) > ROUNDS:
            old, self.parts = self.parts, [cut(self.rows)]
            dropped(*old[:-1])  # the last one is this round's, which the next one reads


def reach(edges: DataFrame) -> DataFrame:
    """(src, dst, depth): every node that each node reaches, by the least number of edges, itself left out unless by a cycle.

    Paths lie within weak components; those of up to CLOSED edges are closed many at a time, as a task holds their pairs,
    larger ones by rounds. The result has a row for each pair, which is what is asked for; `strong_components` and `stale`
    do without it.
    """
    if not edges.where("src IS NULL OR dst IS NULL").isEmpty():
        return _reach_by_rounds(edges)
    kind = edges.schema["src"].dataType.simpleString()
    small, large = _bucketed(parted(edges.select("src", "dst")), CLOSED, PAIRS)
    out = _solved(small, _closed, f"src {kind}, dst {kind}, depth int")
    return out if large is None else out.unionByName(_reach_by_rounds(large))


def _reach_by_rounds(edges: DataFrame) -> DataFrame:
    """`reach` by doubling: once all pairs of up to n edges are known, those of exactly n are joined with all of them, which
    finds the ones of up to 2n. So a path of any length takes as many rounds as its length has binary digits."""
    known = _Known(cut(edges.select("src", "dst").distinct().withColumn("depth", F.lit(1))))
    n = 1
    while True:
        far = known.rows.where(F.col("depth") == n).select("src", F.col("dst").alias("mid"))
        on = known.rows.select(F.col("src").alias("mid"), "dst", (F.col("depth") + n).alias("depth"))
        found = far.join(on, "mid").groupBy("src", "dst").agg(F.min("depth").alias("depth"))
        fresh = cut(found.join(known.rows, ["src", "dst"], "left_anti").select("src", "dst", "depth"))
        if fresh.isEmpty():
            return known.rows
        known.add(fresh)
        n *= 2


def shortest_paths(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(src, dst, depth, path) from each of starts (src): of the shortest paths, the one that is least as an array.

    Paths lie within weak components: those of up to an eighth of CLOSED edges are solved many at a time, as a task holds
    their paths, larger ones by a round for each edge of the longest path.
    """
    edges = edges.select("src", "dst").dropna()  # null leads nowhere
    kind = edges.schema["src"].dataType.simpleString()
    own = starts.select(F.col("src").cast(kind).alias("src"), F.col("src").cast(kind).alias("dst"), F.lit(True).alias("is_start"))
    rows = edges.withColumn("is_start", F.lit(False)).unionByName(own.dropna().distinct())
    small, large = _bucketed(parted(by_name(rows)), CLOSED >> 3, PAIRS >> 4)  # paths are longer than pairs
    out = _solved(small, _shortest, f"src {kind}, dst {kind}, depth int, path array<{kind}>")
    nothing = starts.where("src IS NULL").distinct().select(F.col("src").cast(kind).alias("src"), F.col("src").cast(kind).alias("dst"), F.lit(0).alias("depth"), F.array(F.col("src").cast(kind)).alias("path"))
    out = out.unionByName(nothing)
    return out if large is None else out.unionByName(_shortest_by_rounds(large.where("NOT is_start"), large.where("is_start")))


def _shortest(frame: pd.DataFrame) -> pd.DataFrame:
    """Paths go to the next nodes in their own order, those of least nodes first, so the first to come somewhere is the least."""
    after, rows = defaultdict(set), []
    for a, b, is_start in zip(frame["src"].tolist(), frame["dst"].tolist(), frame["is_start"].tolist(), strict=True):
        if not is_start:
            after[a].add(b)
    ordered = {a: sorted(to) for a, to in after.items()}
    for start in set(frame.loc[frame["is_start"].astype(bool), "src"].tolist()):
        seen, fresh = {start}, [[start]]
        while fresh:
            rows += [(start, path[-1], len(path) - 1, path) for path in fresh]
            longer = []
            for path in fresh:
                for to in ordered.get(path[-1], ()):
                    if to not in seen:
                        seen.add(to)
                        longer.append([*path, to])
            fresh = longer
    return pd.DataFrame(rows, columns=["src", "dst", "depth", "path"])


def _shortest_by_rounds(edges: DataFrame, starts: DataFrame) -> DataFrame:
    e = edges.select(F.col("src").alias("mid"), F.col("dst").alias("next")).distinct()
    fresh = cut(starts.select("src").distinct().select("src", F.col("src").alias("dst"), F.lit(0).alias("depth"), F.array("src").alias("path")))
    known, depth = _Known(fresh), 0
    while not fresh.isEmpty():
        depth += 1
        found = fresh.join(e, fresh["dst"] == e["mid"]).groupBy("src", F.col("next").alias("dst")).agg(F.min(F.concat("path", F.array("next"))).alias("path"))
        fresh = cut(found.join(known.rows, ["src", "dst"], "left_anti").select("src", "dst", F.lit(depth).alias("depth"), "path"))
        known.add(fresh)
    return known.rows


def _least_around(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, before, after): the least node that reaches each node and the least one that it reaches, itself included.

    Both directions go through the same rounds. A round hands labels on over edges and then jumps: whatever reaches a
    node's label reaches the node. So labels travel twice as far in each round where they can.
    """
    both = edges.select("src", "dst", F.lit(False).alias("back")).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(True).alias("back")))
    both = cut(both)
    now = cut(nodes.select("node", F.explode(F.array(F.lit(False), F.lit(True))).alias("back"), F.col("node").alias("least")))
    kind = now.schema["least"].dataType
    while True:
        own = now.select("node", "back", "least", F.col("least").alias("own"))
        handed = both.join(now.withColumnRenamed("node", "src"), ["src", "back"]).select(F.col("dst").alias("node"), "back", "least", F.lit(None).cast(kind).alias("own"))
        better = handed.unionByName(own).groupBy("node", "back").agg(F.min("least").alias("least"), F.max("own").alias("own"))
        jump = now.select(F.col("node").alias("least"), "back", F.col("least").alias("over"))
        new = cut(better.join(jump, ["least", "back"], "left").select("node", "back", F.least("least", "over").alias("least"), "own"))
        dropped(now)
        now = new.select("node", "back", "least")
        if new.where("least <> own").isEmpty():
            dropped(both)
            side = lambda back: F.max(F.when(F.col("back") == back, F.col("least")))
            return now.groupBy("node").agg(side(False).alias("before"), side(True).alias("after"))


def _least_joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of nodes 0 to n - 1 with edges between a and b: for each the least node of its weak component."""
    label = np.arange(n)
    while True:
        at, to = label[a], label[b]
        if (at == to).all():
            return label
        np.minimum.at(label, np.maximum(at, to), np.minimum(at, to))  # labels are roots, and take lower ones that they meet
        while (label[label] != label).any():
            label = label[label]


def _coded(frame: pd.DataFrame, *columns: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct values of columns in order, and for each column where its values stand there."""
    codes, values = pd.factorize(np.concatenate([frame[c].to_numpy() for c in columns]), sort=True)
    return values, np.split(codes, len(columns))


def _contracted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges with `root`, the least node of their weak component within CHUNK edges."""

    def rooted(held: list[pd.DataFrame]) -> pd.DataFrame:
        frame = pd.concat(held, ignore_index=True)
        nodes, (a, b) = _coded(frame, "src", "dst")
        return frame.assign(root=nodes[_least_joined(len(nodes), a, b)[a]])

    held, n = [], 0
    for frame in frames:
        if len(frame):
            held.append(frame)
            n += len(frame)
        if n >= CHUNK:
            yield rooted(held)
            held, n = [], 0
    if held:
        yield rooted(held)


def by_name(edges: DataFrame) -> DataFrame:
    """edges in order of src, so that those of one file, project or directory stand in few chunks."""
    return edges.repartitionByRange("src").sortWithinPartitions("src")


def parted(edges: DataFrame) -> DataFrame:
    """edges (src, dst, and what else they have; none null) with `part`, the least node of their weak component.

    Tasks contract the edges that they read, so what stands together in a table isn't shuffled. Nodes that several chunks
    hold link these chunks' roots. Links are contracted once more, in order of names, and what is left goes by rounds over
    links alone.
    """
    of, label = _rooted(edges)
    if label is None:
        return of.withColumnRenamed("root", "part")
    return of.join(label.withColumnRenamed("node", "root"), "root", "left").withColumn("part", F.coalesce("part", "root")).drop("root")


def _rooted(edges: DataFrame, last: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """edges with `root`, and (node, part) of the roots that aren't their part's only ones, None if there are none."""
    kind = edges.schema["src"].dataType.simpleString()
    given = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in edges.schema)
    of = cut(edges.mapInPandas(_contracted, f"{given}, root {kind}"))
    ends = of.select(F.col("src").alias("node"), "root").unionByName(of.select(F.col("dst").alias("node"), "root"))
    split = cut(ends.groupBy("node").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("node", "least"))
    if split.isEmpty():
        return of, None
    links = cut(ends.join(split, "node").where("root <> least").select(F.col("root").alias("src"), F.col("least").alias("dst")).distinct())
    return of, _weak_by_rounds(links) if last else cut(_weak(by_name(links), True))


def _weak(edges: DataFrame, last: bool = False) -> DataFrame:
    of, label = _rooted(edges.select("src", "dst"), last)
    own = of.select(F.explode(F.array("src", "dst")).alias("node"), "root").distinct()
    if label is None:
        return own.withColumnRenamed("root", "part").distinct()
    return own.join(label.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("part", "root").alias("part")).distinct()


def weak_components(edges: DataFrame) -> DataFrame:
    """(node, part): part is the least node that edges lead to, whatever their direction. As `parted` goes."""
    return cut(_weak(edges))


def _bucketed(of: DataFrame, most: int, pairs: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Edges (with part) of weak components of up to `most` edges, with `bucket`, and those of larger ones, None if there are none.

    A bucket has about LOCAL edges, or, if pairs is given, as many as can have that many pairs of nodes.
    """
    sizes = cut(of.groupBy("part").agg(F.count("*").alias("c")))
    weight, held = (F.col("c"), LOCAL) if pairs is None else ((F.col("c") + 1) * (F.col("c") + 1), pairs)
    total = sizes.where(F.col("c") <= most).agg(F.sum(weight)).first()[0] or 0
    large = sizes.where(F.col("c") > most).select("part")
    bucket = F.pmod(F.xxhash64("part"), F.lit(-(-total // held) or 1)).alias("bucket")
    given = [c for c in of.columns if c != "part"]
    if large.isEmpty():
        return of.select(*given, bucket), None
    return of.join(large, "part", "left_anti").select(*given, bucket), cut(of.join(large, "part", "left_semi").select(*given))


def _solved(edges: DataFrame, solve: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """What solve makes of each bucket, which holds whole weak components."""
    return edges.groupBy("bucket").applyInPandas(solve, schema)


def _least_flags(keys: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and whether all of a key's flags are set."""
    both = np.unique(keys * 2 + flags)
    both = both[np.concatenate([[True], both[1:] // 2 != both[:-1] // 2])] if len(both) else both
    return both // 2, both % 2 == 1


class _After:
    """Edges between nodes 0 to n - 1, by where they start; of those between the same nodes, `bad` only if all are."""

    def __init__(self, n: int, heads: np.ndarray, tails: np.ndarray, bad: np.ndarray | None = None):
        key, self.bad = _least_flags(heads * n + tails, np.zeros(len(heads), dtype=bool) if bad is None else bad)
        self.tails, self.first = key % n, np.searchsorted(key // n, np.arange(n + 1))

    def of(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(i, tail, bad) of each edge that starts at nodes[i]."""
        c = self.first[nodes + 1] - self.first[nodes]
        i = np.repeat(np.arange(len(nodes)), c)
        at = np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c) + self.first[nodes][i]
        return i, self.tails[at], self.bad[at]


def _rounds(after: _After, n: int, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each depth from 1 what starts reach first, as start * n + node, and whether each such way has a bad edge."""
    known, fresh, broken = np.zeros(0, dtype=np.int64), starts * n + starts, np.zeros(len(starts), dtype=bool)
    while len(fresh):
        i, to, bad = after.of(fresh % n)
        pair, flags = _least_flags(fresh[i] // n * n + to, broken[i] | bad)
        new = ~np.isin(pair, known)
        fresh, broken = pair[new], flags[new]
        known = np.union1d(known, fresh)
        yield fresh, broken


def _pairs(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, pairs, depths) of all that each node reaches, itself unless by a cycle left out."""
    nodes, (a, b) = _coded(frame, "src", "dst")
    n = len(nodes)
    found = [f for f, _ in _rounds(_After(n, a, b), n, np.arange(n))]
    return nodes, np.concatenate(found), np.repeat(np.arange(1, len(found) + 1), [len(f) for f in found])


def ways(edges: DataFrame, starts: DataFrame) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(start, at, back, hops, broken) of all that starts (start) reach over edges (src, dst, bad), themselves left out, forwards, and (back) against them: the least number of edges, and whether each way of that length has a bad one. Then the edges and starts of weak components of more than CLOSED edges, which it leaves out; None if there are none."""
    kind = edges.schema["src"].dataType.simpleString()
    own = starts.select(F.col("start").cast(kind).alias("src"), F.col("start").cast(kind).alias("dst"), F.lit(False).alias("bad"), F.lit(True).alias("is_start"))
    rows = edges.select("src", "dst", F.coalesce("bad", F.lit(False)).alias("bad"), F.lit(False).alias("is_start")).unionByName(own).dropna()
    small, large = _bucketed(parted(by_name(cut(rows))), CLOSED, PAIRS)
    out = _solved(small, _ways, f"start {kind}, at {kind}, back boolean, hops int, broken boolean")
    if large is None:
        return out, None, None
    return out, large.where("NOT is_start").select("src", "dst", "bad"), large.where("is_start").select(F.col("src").alias("start")).distinct()


def _ways(frame: pd.DataFrame) -> pd.DataFrame:
    nodes, (a, b) = _coded(frame, "src", "dst")
    n, starts, bad = len(nodes), frame["is_start"].to_numpy(dtype=bool), frame["bad"].to_numpy(dtype=bool)
    first, a, b, bad = np.unique(a[starts]), a[~starts], b[~starts], bad[~starts]
    out = []
    for back in (False, True):
        for hops, (pair, broken) in enumerate(_rounds(_After(n, b if back else a, a if back else b, bad), n, first), 1):
            far = pair // n != pair % n
            out.append(pd.DataFrame({"start": nodes[pair[far] // n], "at": nodes[pair[far] % n], "back": back, "hops": hops, "broken": broken[far]}))
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"start": nodes[:0], "at": nodes[:0], "back": [], "hops": [], "broken": []})


def _closed(frame: pd.DataFrame) -> pd.DataFrame:
    nodes, pairs, depths = _pairs(frame)
    n = len(nodes)
    return pd.DataFrame({"src": nodes[pairs // n], "dst": nodes[pairs % n], "depth": depths})


def _weak_by_rounds(edges: DataFrame) -> DataFrame:
    """`weak_components` by rounds over all edges.

    Labels go over edges, and then jump: a node takes its label's label, so they go twice as far in each round.
    """
    both = cut(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct())
    every = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    now = cut(every.join(both.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("least")), "node", "left").select("node", F.least("node", "least").alias("part")))
    kind = now.schema["part"].dataType
    while True:
        handed = both.join(now.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "part", F.lit(None).cast(kind).alias("own"))
        better = handed.unionByName(now.select("node", "part", F.col("part").alias("own"))).groupBy("node").agg(F.min("part").alias("part"), F.max("own").alias("own"))
        new = cut(better.join(now.select(F.col("node").alias("part"), F.col("part").alias("over")), "part").select("node", F.least("part", "over").alias("part"), "own"))
        dropped(now)
        now = new.select("node", "part")
        if new.where("part <> own").isEmpty():
            dropped(both)
            return now


def _tarjan(n: int, heads: list[int], tails: list[int]) -> tuple[list[int], list[int]]:
    """Of a graph of nodes 0 to n - 1 with edges from heads to tails: for each node its component, numbered so that those that it leads to come first, and the component's level."""
    after: list[list[int]] = [[] for _ in range(n)]
    for a, b in zip(heads, tails, strict=True):
        after[a].append(b)
    seen, low, of, levels, stack, count = [-1] * n, [0] * n, [-1] * n, [], [], 0
    for root in range(n):
        if seen[root] >= 0:
            continue
        work = [(root, 0)]
        while work:
            v, i = work.pop()
            if i == 0:
                seen[v] = low[v] = count
                count += 1
                stack.append(v)
            elif of[after[v][i - 1]] < 0:
                low[v] = min(low[v], low[after[v][i - 1]])
            while i < len(after[v]):
                w = after[v][i]
                i += 1
                if seen[w] < 0:
                    work += [(v, i), (w, 0)]
                    break
                if of[w] < 0:
                    low[v] = min(low[v], seen[w])
            else:
                if low[v] == seen[v]:
                    own = len(levels)
                    members = []
                    while not members or members[-1] != v:
                        members.append(stack.pop())
                        of[members[-1]] = own
                    levels.append(max((levels[of[w]] + 1 for m in members for w in after[m] if of[w] != own), default=0))
    return of, [levels[c] for c in of]


def _components(frame: pd.DataFrame) -> pd.DataFrame:
    """(node, scc, level) of edges (src, dst)."""
    nodes, (a, b) = _coded(frame, "src", "dst")
    of, levels = _tarjan(len(nodes), a.tolist(), b.tolist())
    first: dict[int, int] = {}
    for i, c in enumerate(of):
        first.setdefault(c, i)
    return pd.DataFrame({"node": nodes, "scc": nodes[[first[c] for c in of]], "level": levels})


def leaves_first(edges: DataFrame) -> DataFrame:
    """(node, scc, level): scc is the least node of the component, those that reach each other. Level 0 are components with no edge to another, others are one above the highest that they have an edge to, so what a component needs comes before it.

    Components lie within weak ones. Of these, those of up to LOCAL edges are solved many at a time, as a task holds them;
    larger ones by rounds over all of their edges.
    """
    kind = edges.schema["src"].dataType.simpleString()
    small, far = _bucketed(parted(edges.select(F.coalesce("src", "dst").alias("src"), F.coalesce("dst", "src").alias("dst")).where("src IS NOT NULL")), LOCAL)
    out = _solved(small, _components, f"node {kind}, scc {kind}, level int")
    if far is None:
        return out
    far = cut(far.distinct())
    found = cut(_by_rounds(far))
    return out.unionByName(found.join(levels(far, found), "scc").select("node", "scc", "level"))


def levels(edges: DataFrame, components: DataFrame) -> DataFrame:
    """(scc, level) of components (node, scc), as `leaves_first` has them, by peeling: each round takes components whose edges all lead to those taken before."""
    end = lambda c, n: components.select(F.col("node").alias(c), F.col("scc").alias(n))
    left = cut(edges.join(end("src", "a"), "src").join(end("dst", "b"), "dst").where("a <> b").select("a", "b").distinct())
    fresh = cut(components.select("scc").distinct().join(left.select(F.col("a").alias("scc")), "scc", "left_anti").withColumn("level", F.lit(0)))
    known, level = _Known(fresh), 0
    while not left.isEmpty():
        level += 1
        rest = cut(left.join(fresh.select(F.col("scc").alias("b")), "b", "left_anti"))
        freed = left.select(F.col("a").alias("scc")).distinct().join(rest.select(F.col("a").alias("scc")), "scc", "left_anti")
        fresh = cut(freed.select("scc", F.lit(level).alias("level")))
        dropped(left)
        left = rest
        known.add(fresh)
    return known.rows


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, scc): scc is the least node of the component: those that reach each other."""
    return leaves_first(edges).select("node", "scc")


def _by_rounds(edges: DataFrame) -> DataFrame:
    """(node, scc). A round finds for each node the least one that reaches it and the least one that it reaches. Where they are the same,
    that is its component. Others can share a component only if both agree, so all other edges are dropped, and the rest
    goes to the next round. Nodes without edges to or from them are components of their own, so they go first. No closure
    is made: rows never outnumber nodes and edges.
    """
    e = cut(edges.select("src", "dst").where("src <> dst").distinct())
    nodes = cut(edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct())
    done = None
    while True:
        for _ in range(TRIMS):  # what has no edge to it, or none from it, is on no cycle
            e = e.join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst")
        e = cut(e)
        own = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node"))).distinct()
        alone = nodes.join(own, "node", "left_anti").select("node", F.col("node").alias("scc"))  # no edge is left
        if e.isEmpty():
            return alone if done is None else done.unionByName(alone)
        both = cut(_least_around(e, own))
        found = both.where("before = after").select("node", F.col("before").alias("scc")).unionByName(alone)
        done = cut(found if done is None else done.unionByName(found))
        left = both.where("before <> after")
        nodes = left.select("node")
        side = lambda c, n: left.select(F.col("node").alias(c), F.struct("before", "after").alias(n))  # noqa: E731, B023
        e = cut(e.join(side("src", "a"), "src").join(side("dst", "b"), "dst").where("a = b").select("src", "dst"))


def visible(edges: DataFrame) -> DataFrame:
    """(file, other): files that see each other's globals, forwards or backwards over includes."""
    edges = edges.select("src", "dst").dropna()  # null sees nothing
    kind = edges.schema["src"].dataType.simpleString()
    small, large = _bucketed(parted(edges), CLOSED, PAIRS)
    out = _solved(small, _seen, f"file {kind}, other {kind}")
    if large is None:
        return out
    r = _reach_by_rounds(large).select("src", "dst").where("src <> dst")
    return out.unionByName(r.select(F.col("src").alias("file"), F.col("dst").alias("other")).unionByName(r.select(F.col("dst").alias("file"), F.col("src").alias("other"))).distinct())


def _seen(frame: pd.DataFrame) -> pd.DataFrame:
    nodes, pairs, _ = _pairs(frame)
    n = len(nodes)
    both = np.unique(np.concatenate([pairs, pairs % n * n + pairs // n]))
    both = both[both // n != both % n]
    return pd.DataFrame({"file": nodes[both // n], "other": nodes[both % n]})


class _Merged:
    """Variables of cycles of moves have the same locations: one of them, the least, stands for all. reps: (node, rep) where they differ."""

    def __init__(self, kind: str):
        self.kind, self.reps = kind, None

    def of(self, df: DataFrame, *columns: str) -> DataFrame:
        """df with these columns' variables by those that stand for them."""
        for c in columns if self.reps is not None else ():
            r = self.reps.select(F.col("node").alias(c), F.col("rep").alias("__rep"))
            df = df.join(r, c, "left").withColumn(c, F.coalesce("__rep", c)).drop("__rep")
        return df

    def merge(self, moves: DataFrame) -> bool:
        """Finds the cycles of moves (lhs, rhs) between variables that stand for others already; whether there are any."""
        found = strong_components(moves.select(F.col("rhs").alias("src"), F.col("lhs").alias("dst")))
        new = cut(found.where("node <> scc").select("node", F.col("scc").alias("rep")))
        if new.isEmpty():
            return False
        if self.reps is not None:
            old, self.reps = self.reps, new
            new = cut(self.of(old, "rep").unionByName(new))
        self.reps = new
        return True


def points_to(allocs: DataFrame, moves: DataFrame, stores: DataFrame | None = None, loads: DataFrame | None = None) -> DataFrame:
    """(var, loc) of inclusion constraints, Andersen's least solution, for variables and for fields of locations ("loc.field").

    allocs (var, loc): var is loc. moves (lhs, rhs): lhs = rhs. stores (base, field, rhs): base.field = rhs. loads (lhs,
    base, field): lhs = base.field. A store or load is a move to or from the field of each location that its base points
    to, so new facts bring new moves.

    Facts go between variables that constraints connect, and, where there are fields, between those that have a location
    in common. Of the weak components of these, those of up to CLOSED constraints are solved many at a time, as a task holds
    their facts, larger ones by rounds.
    """
    fields = stores is not None or loads is not None
    kind, loc_kind = ("string",) * 2 if fields else (allocs.schema[c].dataType.simpleString() for c in ("var", "loc"))
    none, as_ = F.lit(None).cast("string"), lambda c, name: F.col(c).cast(kind).alias(name)
    row = lambda df, what, a, b, loc=None, field=none: df.select(as_(a, "src"), as_(b, "dst"), F.lit(what).alias("what"), (F.lit(None) if loc is None else loc).cast(loc_kind).alias("loc"), field.cast("string").alias("field"))
    rows = row(allocs, "alloc", "var", "var", F.col("loc")).unionByName(row(moves, "move", "lhs", "rhs"))
    if stores is not None:
        rows = rows.unionByName(row(stores, "store", "base", "rhs", None, F.col("field")))
    if loads is not None:
        rows = rows.unionByName(row(loads, "load", "lhs", "base", None, F.col("field")))
    rows = cut(rows.dropna(subset=["src", "dst"]))
    linked = rows
    if fields:  # variables that share a location, and those that are named as a location's field
        at = lambda c: F.concat(F.lit("@"), c)
        shared = rows.where("what = 'alloc' AND loc IS NOT NULL").withColumns({"dst": at(F.col("loc")), "what": F.lit("link")})
        ends = rows.select(F.explode(F.array("src", "dst")).alias("src")).where("contains(src, '.')").distinct()
        named = ends.select("src", F.explode(F.transform(F.sequence(F.lit(1), F.regexp_count("src", F.lit(r"\."))), lambda i: at(F.call_function("substring_index", F.col("src"), F.lit("."), i)))).alias("dst"))
        linked = rows.unionByName(shared).unionByName(named.select("src", "dst", F.lit("link").alias("what"), F.lit(None).cast(loc_kind).alias("loc"), none.alias("field")))
    small, large = _bucketed(parted(by_name(linked)), CLOSED, PAIRS)
    out = _solved(small.where("what <> 'link'"), _pointed, f"var {kind}, loc {loc_kind}")
    if large is None:
        return out
    of = lambda what, **names: large.where(F.col("what") == what).select(*[F.col(c).alias(n) for n, c in names.items()])
    return out.unionByName(_points_to_by_rounds(of("alloc", var="src", loc="loc"), of("move", lhs="src", rhs="dst"), None if stores is None else of("store", base="src", field="field", rhs="dst"), None if loads is None else of("load", lhs="src", base="dst", field="field")))


def _pointed(frame: pd.DataFrame) -> pd.DataFrame:
    """(var, loc) of constraints (src, dst, what, loc, field): new facts go along moves, and bring moves where they are at a base of stores and loads."""
    facts: dict[object, set] = defaultdict(set)
    after, stores, loads = defaultdict(set), defaultdict(list), defaultdict(list)
    work = []
    for src, dst, what, loc, field in zip(*(frame[c].tolist() for c in ("src", "dst", "what", "loc", "field")), strict=True):
        if what == "alloc":
            work.append((src, {loc}))
        elif what == "move":
            after[dst].add(src)
        elif field is None or pd.isna(field):  # what has no name is no field
            continue
        elif what == "store":
            stores[src].append((field, dst))
        else:
            loads[dst].append((field, src))
    while work:
        var, locs = work.pop()
        new = locs - facts[var]
        if not new:
            continue
        facts[var] |= new
        work += [(to, new) for to in after[var]] if var in after else []
        for bases, stored in ((stores, True), (loads, False)):
            for field, other in bases.get(var, ()):
                for loc in new:
                    cell = f"{loc}.{field}"
                    a, b = (other, cell) if stored else (cell, other)
                    if b not in after[a]:
                        after[a].add(b)
                        if facts.get(a):
                            work.append((b, set(facts[a])))
    rows = [(var, loc) for var, locs in facts.items() for loc in locs]
    return pd.DataFrame(rows, columns=["var", "loc"])


def _points_to_by_rounds(allocs: DataFrame, moves: DataFrame, stores: DataFrame | None = None, loads: DataFrame | None = None) -> DataFrame:
    """`points_to`, semi-naive: new facts meet all moves, and new moves meet all facts. Variables that moves connect in a cycle
    are one while facts are found, also where new moves close a cycle: a fact is found once for all of them, and told for
    each at the end.
    """
    kind = "string" if stores is not None or loads is not None else allocs.schema["var"].dataType.simpleString()
    cell = F.concat(F.col("loc").cast("string"), F.lit("."), F.col("field").cast("string"))
    typed = lambda df, *columns: df.withColumns({c: F.col(c).cast(kind) for c in columns})
    merged = _Merged(kind)
    all_moves = cut(typed(moves.select("lhs", "rhs"), "lhs", "rhs").distinct())
    merged.merge(all_moves)
    thin = lambda df: merged.of(df, "lhs", "rhs").where("lhs <> rhs").distinct()
    moved = _Known(cut(thin(all_moves)))
    fresh = cut(merged.of(typed(allocs.select("var", "loc"), "var"), "var").distinct())
    known = _Known(fresh)
    while not fresh.isEmpty():
        found = fresh.join(moved.rows, F.col("var") == F.col("rhs")).select(F.col("lhs").alias("var"), "loc")
        new = []
        if stores is not None:
            s = merged.of(typed(stores, "base", "rhs"), "base")
            new.append(s.join(fresh, s["base"] == fresh["var"]).select(cell.alias("lhs"), "rhs"))
        if loads is not None:
            o = merged.of(typed(loads, "base", "lhs"), "base")
            new.append(o.join(fresh, o["base"] == fresh["var"]).select("lhs", cell.alias("rhs")))
        steps = None
        if new:
            steps = cut(thin(new[0] if len(new) == 1 else new[0].unionByName(new[1])).join(moved.rows, ["lhs", "rhs"], "left_anti"))
            found = found.unionByName(steps.join(known.rows, F.col("var") == F.col("rhs")).select(F.col("lhs").alias("var"), "loc"))
        fresh = cut(found.distinct().join(known.rows, ["var", "loc"], "left_anti"))
        known.add(fresh)
        if steps is not None and not steps.isEmpty():
            moved.add(steps)
            if merged.merge(moved.rows):  # what was known of one of the merged is news to what the others move to
                moved, everything = _Known(cut(thin(moved.rows))), merged.of(known.rows, "var").distinct()
                old = known.rows
                known = _Known(cut(everything))
                fresh = cut(merged.of(fresh, "var").unionByName(known.rows.join(old, ["var", "loc"], "left_anti")).unionByName(known.rows.join(merged.reps.select(F.col("rep").alias("var")).distinct(), "var", "left_semi")).distinct())
    if merged.reps is None:
        return known.rows
    return known.rows.unionByName(known.rows.join(merged.reps, F.col("var") == F.col("rep")).select(F.col("node").alias("var"), "loc"))


def may_alias(pts: DataFrame) -> DataFrame:
    """(a, b), a < b, that share a location. Joined by location, so its size is that of the answer."""
    o = pts.select(F.col("var").alias("b"), "loc")
    return pts.select(F.col("var").alias("a"), "loc").join(o, "loc").where("a < b").select("a", "b").distinct()


def stale(now: DataFrame, cached: DataFrame, includes: DataFrame) -> DataFrame:
    """Paths to analyse again: new or changed by hash, and whatever includes one of these, at any distance.

    now, cached: (path, sha256); includes: (src, dst), src includes dst. Weak components of up to LOCAL includes are solved
    many at a time in a task, larger ones by rounds.
    """
    changed = now.join(cached, (now["path"] == cached["path"]) & (now["sha256"] == cached["sha256"]), "left_anti").select("path")
    gone = cached.join(now, "path", "left_anti").select("path")
    fresh = changed.unionByName(gone).distinct()
    edges = includes.select("src", "dst").dropna().withColumn("is_start", F.lit(False))
    rows = edges.unionByName(fresh.dropna().select(F.col("path").alias("src"), F.col("path").alias("dst"), F.lit(True).alias("is_start")))
    small, large = _bucketed(parted(by_name(rows)), LOCAL)
    found = _solved(small, _including, "path string")
    if large is not None:
        found = found.unionByName(_including_by_rounds(large.where("is_start").select(F.col("src").alias("path")), large.where("NOT is_start")))
    return found.join(now, "path", "left_semi")


def _including(frame: pd.DataFrame) -> pd.DataFrame:
    """path: a bucket's starts, and what leads to them."""
    before, known, work = defaultdict(list), set(), []
    for a, b, is_start in zip(frame["src"].tolist(), frame["dst"].tolist(), frame["is_start"].tolist(), strict=True):
        if is_start:
            work.append(a)
        else:
            before[b].append(a)
    while work:
        if (x := work.pop()) not in known:
            known.add(x)
            work += before.get(x, ())
    return pd.DataFrame({"path": list(known)}, dtype=object)


def _including_by_rounds(starts: DataFrame, includes: DataFrame) -> DataFrame:
    fresh = cut(starts)
    known = _Known(fresh)
    while not fresh.isEmpty():
        found = fresh.join(includes, fresh["path"] == includes["dst"]).select(F.col("src").alias("path")).distinct()
        fresh = cut(found.join(known.rows, "path", "left_anti"))
        known.add(fresh)
    return known.rows


def call_graph(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """(src, dst): calls (caller, callee) of known functions (name)."""
    return calls.join(functions.select(F.col("name").alias("callee")).distinct(), "callee", "left_semi").select(F.col("caller").alias("src"), F.col("callee").alias("dst")).distinct()


def params_to_sinks(direct: DataFrame, passes: DataFrame) -> DataFrame:
    """(func, idx, vuln_type): parameters that reach a sink, in their function or through any number of calls.

    direct: the same columns, within a function; passes: (func, idx, callee, callee_idx), a parameter handed on as an
    argument. The bottom-up order over components of the call graph isn't needed: rounds end when nothing is new. Weak
    components of up to LOCAL sinks and calls are solved many at a time in a task, larger ones by rounds.
    """
    kind, idx_kind = (direct.schema[c].dataType.simpleString() for c in ("func", "idx"))
    as_ = lambda c, t, name: F.col(c).cast(t).alias(name)
    sunk = direct.select(as_("func", kind, "src"), as_("func", kind, "dst"), as_("idx", idx_kind, "idx"), as_("idx", idx_kind, "to_idx"), F.col("vuln_type").cast("string").alias("vuln_type"), F.lit(True).alias("is_sink"))
    handed = passes.select(as_("func", kind, "src"), as_("callee", kind, "dst"), as_("idx", idx_kind, "idx"), as_("callee_idx", idx_kind, "to_idx"), F.lit(None).cast("string").alias("vuln_type"), F.lit(False).alias("is_sink"))
    rows = cut(sunk.unionByName(handed.where("dst IS NOT NULL AND to_idx IS NOT NULL")))  # null is no function that is called
    nameless = rows.where("src IS NULL OR idx IS NULL")  # and is called by none
    small, large = _bucketed(parted(by_name(rows.where("src IS NOT NULL AND idx IS NOT NULL"))), LOCAL)
    out = _solved(small, _sinking, f"func {kind}, idx {idx_kind}, vuln_type string")
    if large is not None:
        out = out.unionByName(_sinking_by_rounds(large))
    if nameless.isEmpty():
        return out
    out = cut(out)
    last = nameless.where("NOT is_sink").drop("vuln_type").join(out.select(F.col("func").alias("dst"), F.col("idx").alias("to_idx"), "vuln_type"), ["dst", "to_idx"])
    own = nameless.where("is_sink").unionByName(last)
    return out.unionByName(own.select(F.col("src").alias("func"), "idx", "vuln_type").distinct())


def _sinking(frame: pd.DataFrame) -> pd.DataFrame:
    """(func, idx, vuln_type) of a bucket's sinks, and of what hands its parameters on to them."""
    before, known, work = defaultdict(list), set(), []
    for a, b, i, k, t, is_sink in zip(*(frame[c].tolist() for c in ("src", "dst", "idx", "to_idx", "vuln_type", "is_sink")), strict=True):
        if is_sink:
            work.append((a, i, t))
        else:
            before[b, k].append((a, i))
    while work:
        if (x := work.pop()) not in known:
            known.add(x)
            work += [(a, i, x[2]) for a, i in before.get(x[:2], ())]
    return pd.DataFrame(list(known), columns=["func", "idx", "vuln_type"])


def _sinking_by_rounds(rows: DataFrame) -> DataFrame:
    """Calls are written once, without those of functions that neither have a sink nor hand anything on."""
    fresh = cut(rows.where("is_sink").select(F.col("src").alias("func"), "idx", "vuln_type").distinct())
    known = _Known(fresh)
    live = rows.select(F.col("src").alias("callee"), F.col("idx").alias("callee_idx")).distinct()
    p = rows.where("NOT is_sink").select(F.col("src").alias("caller"), F.col("idx").alias("caller_idx"), F.col("dst").alias("callee"), F.col("to_idx").alias("callee_idx")).distinct()
    p = cut(p.join(live, ["callee", "callee_idx"], "left_semi"))
    while not fresh.isEmpty():
        hit = (fresh["func"] == p["callee"]) & (fresh["idx"] == p["callee_idx"])
        found = p.join(fresh, hit).select(F.col("caller").alias("func"), F.col("caller_idx").alias("idx"), "vuln_type").distinct()
        fresh = cut(found.join(known.rows, ["func", "idx", "vuln_type"], "left_anti"))
        known.add(fresh)
    return known.rows
