"""Components and their order, by the definition, on random graphs; solved in tasks and by rounds."""

import random

import pytest

from spindrift.operators import context, graphs
from spindrift.sources.tables import written as tables_written


def slow_order(edges):
    """{node: (least node of its component, level)}."""
    nodes = {x for e in edges for x in e}
    reach = {v: {v} for v in nodes}
    while any(not reach[b] <= reach[a] for a, b in edges):
        for a, b in edges:
            reach[a] |= reach[b]
    scc = {v: min(w for w in reach[v] if v in reach[w]) for v in nodes}
    level = dict.fromkeys(nodes, 0)
    while True:
        new = {v: max((level[scc[w]] + 1 for m in nodes if scc[m] == scc[v] for x, w in edges if x == m and scc[w] != scc[v]), default=0) for v in nodes}
        if new == level:
            return {v: (scc[v], level[v]) for v in nodes}
        level = new


@pytest.mark.parametrize("local", [1 << 16, 4])
def test_leaves_first(spark, monkeypatch, local):
    monkeypatch.setattr(graphs, "LOCAL", local)
    rng = random.Random(local)
    edges = []
    for base in range(0, 60, 10):
        size = rng.randrange(2, 10)
        edges += [(base + rng.randrange(size), base + rng.randrange(size)) for _ in range(rng.randrange(1, 14))]
    edges += [(100, 101), (101, 102), (102, 103), (103, 104), (104, 102), (105, 105), (100, 101)]
    got = {r.node: (r.scc, r.level) for r in graphs.leaves_first(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == slow_order(edges)


def test_leaves_first_by_name(spark):
    edges = [("main", "a"), ("a", "b"), ("b", "a"), ("b", "é"), ("é", "z")]
    got = {r.node: (r.scc, r.level) for r in graphs.leaves_first(spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == {"z": ("z", 0), "é": ("é", 1), "a": ("a", 2), "b": ("a", 2), "main": ("main", 3)}
    assert graphs.leaves_first(spark.createDataFrame([], "src long, dst long")).collect() == []


def test_tarjan_of_a_long_path():
    n = 200_000
    of, levels = graphs._tarjan(n, list(range(n - 1)), list(range(1, n)))
    assert levels == list(range(n - 1, -1, -1)) and len(set(of)) == n


def slow_points_to(allocs, moves, stores, loads):
    pts = {}
    for v, loc in allocs:
        pts.setdefault(v, set()).add(loc)
    while True:
        before = sum(map(len, pts.values()))
        steps = list(moves)
        steps += [(f"{loc}.{f}", r) for b, f, r in stores for loc in pts.get(b, ())] + [(v, f"{loc}.{f}") for v, b, f in loads for loc in pts.get(b, ())]
        for lhs, rhs in steps:
            pts.setdefault(lhs, set()).update(pts.get(rhs, ()))
        if sum(map(len, pts.values())) == before:
            return {(v, loc) for v, locs in pts.items() for loc in locs}


@pytest.mark.parametrize("seed", [1, 2])
def test_points_to(spark, seed):
    """With cycles from the start, and such as stores and loads close."""
    rng = random.Random(seed)
    v = lambda: f"v{rng.randrange(12)}"
    allocs, moves = [(v(), f"o{i}") for i in range(5)], [(v(), v()) for _ in range(7)] + [("v0", "v1"), ("v1", "v2"), ("v2", "v0")]
    stores, loads = [(v(), rng.choice("fg"), v()) for _ in range(5)] + [("v0", "f", "v3")], [(v(), v(), rng.choice("fg")) for _ in range(4)] + [("v3", "v0", "f")]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = graphs.points_to(frame(allocs, "var string, loc string"), frame(moves, "lhs string, rhs string"), frame(stores, "base string, field string, rhs string"), frame(loads, "lhs string, base string, field string"))
    rows = [(r["var"], r["loc"]) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == slow_points_to(allocs, moves, stores, loads)


def test_points_to_of_code(spark):
    code = ["$a = new A();", "$b = &$a;", "$b->f = $c;", "$c = array(1);", "$d = $a->f;", "$e['k'] = $d;", "$e = [];", "$g = $e[\"k\"];", "$h = $e[$i];"]
    lines = spark.createDataFrame([(1, k, t) for k, t in enumerate(code, 1)], "file_id int, line_no int, text string")
    got = {(r["var"], r["loc"]) for r in graphs.points_to(**context.alias_constraints(lines)).collect()}
    assert got == {("1:a", "1:1"), ("1:b", "1:1"), ("1:c", "1:4"), ("1:1.f", "1:4"), ("1:d", "1:4"), ("1:e", "1:7"), ("1:7.k", "1:4"), ("1:g", "1:4")}


def tables(monkeypatch):
    """Names of the tables that are written from now on."""
    made = []
    monkeypatch.setattr(graphs, "written", lambda df, name: (made.append(name), tables_written(df, name))[1])
    return made


def projects(spark, size=40, n=20):
    """Ways of `size` files in each of n projects, with a way back in every other one."""
    e = spark.range(n * size, numPartitions=3).selectExpr("id AS src", f"IF(id % {size} = {size - 1}, id - IF(id DIV {size} % 2 = 0, {size - 1}, 0), id + 1) AS dst")
    return e, {(r.src, r.dst) for r in e.collect()}


def test_components_of_many_projects_take_no_rounds(spark, monkeypatch):
    e, pairs = projects(spark)
    made = tables(monkeypatch)
    got = {r.node: (r.scc, r.level) for r in graphs.leaves_first(e).collect()}
    assert got == slow_order(pairs)
    assert len(made) <= 9  # by rounds, labels of 40 files took more


def test_weak_components(spark):
    rng = random.Random(7)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    parts = {v: v for e in pairs for v in e}
    while any(parts[a] != parts[b] for a, b in pairs):
        for a, b in pairs:
            parts[a] = parts[b] = min(parts[a], parts[b])
    df = spark.createDataFrame(pairs, "src long, dst long").repartition(5)
    assert {r.node: r.part for r in graphs.weak_components(df).collect()} == parts
    assert all(r.part == parts[r.src] for r in graphs.parted(df).collect())
    assert graphs.weak_components(df.limit(0)).collect() == []


def test_points_to_of_many_files_takes_no_rounds(spark, monkeypatch):
    """Ways of 40 variables through a field, in each of 12 files; a location that two files share."""
    v = lambda f, k: f"{f}:v{k}"
    allocs = [(v(f, 0), f"{f}:1") for f in range(12)] + [(v(f, 60), f"{f}:2") for f in range(12)] + [("3:v60", "shared"), ("9:v60", "shared")]
    moves = [(v(f, k + 1), v(f, k)) for f in range(12) for k in range(40)]
    stores, loads = [(v(f, 60), "a", v(f, 40)) for f in range(12) if f != 9], [(v(f, 61), v(f, 60), "a") for f in range(12)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    made = tables(monkeypatch)
    got = graphs.points_to(frame(allocs, "var string, loc string"), frame(moves, "lhs string, rhs string"), frame(stores, "base string, field string, rhs string"), frame(loads, "lhs string, base string, field string"))
    rows = [(r["var"], r["loc"]) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == slow_points_to(allocs, moves, stores, loads)
    assert ("9:v61", "3:1") in rows and len(made) <= 10  # by rounds, one for each move of a way


@pytest.mark.parametrize("closed", [1 << 10, 3])
def test_closures_and_points_to_small_and_large(spark, monkeypatch, closed):
    monkeypatch.setattr(graphs, "CLOSED", closed)
    pairs = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 4), (10, 11), (20, 21), (21, 22), (20, 22), (10, 11)]
    e = spark.createDataFrame(pairs, "src long, dst long")
    got = graphs.reach(e).collect()
    assert {(r.src, r.dst): r.depth for r in got}[(1, 1)] == 3 and len(got) == len({(r.src, r.dst) for r in got}) == 9 + 3 + 1 + 1 + 3
    seen = {(r.file, r.other) for r in graphs.visible(e).collect()}
    assert seen == {(a, b) for r in got for a, b in ((r.src, r.dst), (r.dst, r.src)) if a != b}
    allocs = spark.createDataFrame([(1, "a"), (10, "b"), (22, "c")], "var long, loc string")
    pts = [(r["var"], r["loc"]) for r in graphs.points_to(allocs, e.selectExpr("dst AS lhs", "src AS rhs")).collect()]
    assert sorted(pts) == [(1, "a"), (2, "a"), (3, "a"), (4, "a"), (10, "b"), (11, "b"), (22, "c")]


@pytest.mark.parametrize("closed", [1 << 10, 3])
def test_distances_small_and_large(spark, monkeypatch, closed):
    """Of two shortest ways one is whole; repeated includes count as resolved if one of them is."""
    monkeypatch.setattr(graphs, "CLOSED", closed)
    edges = [(1, 2, False), (2, 4, True), (1, 3, True), (3, 4, True), (4, 1, True), (10, 11, False), (10, 11, True), (12, 13, False)]
    e = spark.createDataFrame(edges, "src long, dst long, is_resolved boolean")
    made = tables(monkeypatch)
    got = {(r.start, r["at"], r.back): (r.hops, r.broken) for r in context._distances(e, spark.createDataFrame([(1,), (11,), (12,), (50,)], "start long")).collect()}
    forwards = {(1, 2): (1, True), (1, 3): (1, False), (1, 4): (2, False), (12, 13): (1, True)}
    back = {(1, 4): (1, False), (1, 2): (2, False), (1, 3): (2, False), (11, 10): (1, False)}
    assert got == {(*k, d): v for d, side in ((False, forwards), (True, back)) for k, v in side.items()}
    assert closed == 3 or len(made) <= 8


@pytest.mark.parametrize("most", [1 << 10, 2])
def test_paths_and_stale(spark, monkeypatch, most):
    """Shortest paths and stale files, in tasks (without a round for each edge) and by rounds."""
    monkeypatch.setattr(graphs, "CLOSED", most)
    monkeypatch.setattr(graphs, "LOCAL", most)
    written, own = [], graphs.cut
    monkeypatch.setattr(graphs, "cut", lambda df: written.append(1) or own(df))
    edges = [(i, i + 1) for i in range(9)] + [(0, 20), (20, 2), (0, 11), (11, 2), (9, 0), (30, 31), (31, 30)]
    e = spark.createDataFrame(edges, "src long, dst long")
    got = {(r.src, r.dst): (r.depth, list(r.path)) for r in graphs.shortest_paths(e, spark.createDataFrame([(0,), (30,), (40,)], "src long")).collect()}
    tail = list(range(2, 10))
    want = {(0, 0): (0, [0]), (0, 1): (1, [0, 1]), (0, 11): (1, [0, 11]), (0, 20): (1, [0, 20])} | {(0, d): (d, [0, 1, *tail[: d - 1]]) for d in tail}
    assert got == want | {(30, 30): (0, [30]), (30, 31): (1, [30, 31]), (40, 40): (0, [40])}
    sums = lambda new: spark.createDataFrame([(str(i), "b" if i in new else "a") for i in [*range(10), 11, 20, 30, 31, 40]], "path string, sha256 string")
    links = e.where("src <> 9").selectExpr("string(src) src", "string(dst) dst")
    stale = {r.path for r in graphs.stale(sums({2, 40}), sums(()), links).collect()}
    assert stale == {"0", "1", "11", "20", "2", "40"}
    assert most == 2 or len(written) < 12


@pytest.mark.parametrize("local", [1 << 16, 3])
def test_parameters_to_sinks_small_and_large(spark, monkeypatch, local):
    monkeypatch.setattr(graphs, "LOCAL", local)
    rng = random.Random(local)
    direct = [(f"f{rng.randrange(60)}", rng.randrange(2), t) for t in ("XSS", "RCE") for _ in range(8)] + [(None, 0, "XSS"), ("f1", None, "RCE")]
    passes = [(f"f{rng.randrange(60)}", rng.randrange(2), f"f{rng.randrange(60)}", rng.randrange(2)) for _ in range(70)]
    passes += [("a", 0, "b", 0), ("b", 0, "a", 0), ("b", 0, "c", 1), (None, 1, direct[0][0], direct[0][1]), ("d", None, direct[0][0], direct[0][1]), ("d", 0, None, 0), ("d", 0, direct[0][0], None), ("d", 1, "nowhere", 0)]
    want = set(direct + [("c", 1, "XSS")])
    for _ in range(80):
        want |= {(f, i, t) for f, i, g, k in passes for h, j, t in want if g is not None and k is not None and (g, k) == (h, j)}
    frame = lambda rows, names: spark.createDataFrame(rows, names)
    got = graphs.params_to_sinks(frame(direct + [("c", 1, "XSS")], "func string, idx int, vuln_type string"), frame(passes + passes[:9], "func string, idx int, callee string, callee_idx int"))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert {("a", 0, "XSS"), (None, 1, direct[0][2]), ("d", None, direct[0][2])} <= want
    none = frame([], "func long, idx int, vuln_type string")
    assert graphs.params_to_sinks(none, frame([], "func long, idx int, callee long, callee_idx int")).collect() == []


@pytest.mark.parametrize("local", [1 << 16, 3])
def test_parameters_to_sinks_read_calls_once(spark, monkeypatch, tmp_path, local):
    """A chain of 12 calls in each of 20 projects; by rounds over what was given, calls were read in each of them."""
    monkeypatch.setattr(graphs, "LOCAL", local)
    log = str(tmp_path / "read")

    def seen(frames):
        for f in frames:
            with open(log, "a") as out:
                out.write("x" * len(f))
            yield f

    passes = spark.range(240).where("id % 12 < 11").selectExpr("id AS func", "0 AS idx", "id + 1 AS callee", "0 AS callee_idx")
    passes = passes.mapInPandas(seen, passes.schema)
    direct = spark.range(20).selectExpr("id * 12 + 11 AS func", "0 AS idx", "'XSS' AS vuln_type")
    made = tables(monkeypatch)
    assert {r.func for r in graphs.params_to_sinks(direct, passes).collect()} == set(range(240))
    with open(log) as f:
        assert len(f.read()) == 220
    assert local == 3 or len(made) <= 6  # by rounds, one for each call of a chain
