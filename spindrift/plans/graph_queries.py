"""Queries on graphs, lattices and states."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import context, graphs, lattice
from ..registry import query
from ..sources.corpus import read

#: An include graph with a file for each order: files of a project of twelve include one or two others each, in cycles and
#: in trees. It grows with the table, and nodes carry what their order has.
EDGES = """e AS (SELECT DISTINCT src, dst FROM (SELECT o_orderkey AS src, o_orderkey - o_orderkey % 12 + (o_orderkey * 7 + o_custkey) % 12 AS dst FROM orders
    UNION ALL SELECT o_orderkey, o_orderkey - o_orderkey % 12 + (o_orderkey * 5 + o_custkey % 7) % 12 FROM orders))"""
NODES = "n AS (SELECT src AS node FROM e UNION SELECT dst FROM e)"


def _orders(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")


def edges(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    base = k - k % 12
    to = F.array(base + (k * 7 + c) % 12, base + (k * 5 + c % 7) % 12)
    return _orders(spark, sf_dir).select(k.alias("src"), F.explode(F.array_distinct(to)).alias("dst"))


_REACH = f"{EDGES}, reach AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM reach r JOIN e ON e.src = r.dst)"


@query(f"WITH RECURSIVE {_REACH} SELECT src, dst FROM reach")
def g23_include_closure(spark, sf_dir):
    return graphs.reach(edges(spark, sf_dir)).select("src", "dst")


@query(f"WITH RECURSIVE {_REACH} SELECT DISTINCT a AS file, b AS other FROM (SELECT src AS a, dst AS b FROM reach UNION ALL SELECT dst, src FROM reach) WHERE a <> b")
def g23_visible_files(spark, sf_dir):
    return graphs.visible(edges(spark, sf_dir))


@query(f"""WITH RECURSIVE {EDGES}, p AS (SELECT src, src AS dst, 0 AS depth, [src] AS path FROM (SELECT DISTINCT src FROM e WHERE src NOT IN (SELECT dst FROM e))
    UNION ALL SELECT p.src, e.dst, p.depth + 1, list_append(p.path, e.dst) FROM p JOIN e ON e.src = p.dst WHERE NOT list_contains(p.path, e.dst)),
    d AS (SELECT src, dst, min(depth) AS depth FROM p GROUP BY 1, 2)
    SELECT p.src, p.dst, CAST(p.depth AS INTEGER) AS depth, array_to_string(min(p.path), '>') AS path FROM p JOIN d ON d.src = p.src AND d.dst = p.dst AND d.depth = p.depth GROUP BY 1, 2, 3""")
def g24_shortest_paths(spark, sf_dir):
    """From files that none includes to all that they reach."""
    e = edges(spark, sf_dir)
    got = graphs.shortest_paths(e, e.join(e.select(F.col("dst").alias("src")), "src", "left_anti"))
    return got.select("src", "dst", "depth", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


@query(f"""WITH RECURSIVE {_REACH}, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e)
    SELECT n.node, least(n.node, (SELECT min(a.dst) FROM reach a JOIN reach b ON b.src = a.dst AND b.dst = a.src WHERE a.src = n.node)) AS scc FROM n""")
def g21_components(spark, sf_dir):
    return graphs.strong_components(edges(spark, sf_dir))


@query(f"""WITH RECURSIVE {_REACH}, n AS (SELECT src AS node FROM e UNION SELECT dst FROM e), s AS (SELECT n.node, least(n.node, (SELECT min(a.dst) FROM reach a JOIN reach b ON b.src = a.dst AND b.dst = a.src WHERE a.src = n.node)) AS scc FROM n),
    g AS (SELECT scc, count(*) AS size FROM s GROUP BY 1)
    SELECT (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM n) AS nodes, count(*) AS components, count_if(size > 1) AS recursive_groups, max(size) AS largest, (SELECT max(c) FROM (SELECT count(*) AS c FROM e GROUP BY dst)) AS most_callers FROM g""")
def a15_call_graph_stats(spark, sf_dir):
    e = edges(spark, sf_dir)
    s = graphs.strong_components(e).groupBy("scc").agg(F.count("*").alias("size"))
    sums = s.agg(F.sum("size").alias("nodes"), F.count("*").alias("components"), F.count_if(F.col("size") > 1).alias("recursive_groups"), F.max("size").alias("largest"))
    callers = e.distinct().groupBy("dst").agg(F.count("*").alias("c")).agg(F.max("c").alias("most_callers"), F.sum("c").alias("edges"))
    return sums.crossJoin(callers)  # one row each


@query(f"""WITH RECURSIVE {EDGES}, a AS (SELECT DISTINCT src AS var, 'o' || (src // 12 * 3 + src % 3) AS loc FROM e), m AS (SELECT DISTINCT src, dst FROM e), pts AS (SELECT var, loc FROM a UNION SELECT m.dst, p.loc FROM pts p JOIN m ON m.src = p.var) SELECT var, loc FROM pts""")
def g30_points_to(spark, sf_dir):
    e, s = edges(spark, sf_dir), F.col("src")
    allocs = e.select(s.alias("var"), F.concat(F.lit("o"), (F.floor(s / 12) * 3 + s % 3).cast("string")).alias("loc")).distinct()
    return graphs.points_to(allocs, e.select(F.col("dst").alias("lhs"), F.col("src").alias("rhs")))


@query(f"""WITH {EDGES}, p AS (SELECT DISTINCT src AS var, 'o' || dst AS loc FROM e) SELECT DISTINCT x.var AS a, y.var AS b FROM p x JOIN p y ON x.loc = y.loc AND x.var < y.var""")
def j17_may_alias(spark, sf_dir):
    p = edges(spark, sf_dir).select(F.col("src").alias("var"), F.concat(F.lit("o"), F.col("dst").cast("string")).alias("loc")).distinct()
    return graphs.may_alias(p)


@query(f"""WITH RECURSIVE {EDGES}, bad AS (SELECT o_orderkey AS node FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' UNION SELECT e.src FROM bad b JOIN e ON e.dst = b.node) SELECT 'f' || node AS path FROM bad""")
def g38_stale_files(spark, sf_dir):
    """A file for each order; the content of urgent ones that are done has changed."""
    name = lambda c: F.concat(F.lit("f"), F.col(c).cast("string"))
    o = _orders(spark, sf_dir)
    changed = (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT")
    now = o.select(name("o_orderkey").alias("path"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("sha256"))
    old = o.select(name("o_orderkey").alias("path"), F.sha2(F.when(changed, F.lit("old")).otherwise(F.col("o_orderkey").cast("string")), 256).alias("sha256"))
    return graphs.stale(now, old, edges(spark, sf_dir).select(name("src").alias("src"), name("dst").alias("dst")))


@query(f"WITH {EDGES} SELECT DISTINCT 'g' || src AS src, 'g' || dst AS dst FROM e WHERE dst IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def g19_j15_call_graph(spark, sf_dir):
    """Calls of functions that are known: those of orders that aren't pending."""
    e = edges(spark, sf_dir)
    name = lambda c: F.concat(F.lit("g"), F.col(c).cast("string"))
    known = _orders(spark, sf_dir).where("o_orderstatus <> 'P'").select(name("o_orderkey").alias("name"))
    return graphs.call_graph(e.select(name("src").alias("caller"), name("dst").alias("callee")), known)


@query(f"""WITH RECURSIVE {EDGES}, d AS (SELECT o_orderkey AS func, CAST(o_orderkey % 2 AS INTEGER) AS idx, CASE o_orderstatus WHEN 'F' THEN 'XSS' ELSE 'SQL_INJECTION' END AS vuln_type FROM orders WHERE o_orderpriority = '5-LOW'),
    p AS (SELECT src AS func, CAST((src + dst) % 2 AS INTEGER) AS idx, dst AS callee, CAST(dst % 2 AS INTEGER) AS callee_idx FROM e),
    k AS (SELECT func, idx, vuln_type FROM d UNION SELECT p.func, p.idx, k.vuln_type FROM k JOIN p ON p.callee = k.func AND p.callee_idx = k.idx) SELECT func, idx, vuln_type FROM k""")
def g20_params_to_sinks(spark, sf_dir):
    """Functions of orders of low priority hold a sink."""
    e, s, d = edges(spark, sf_dir), F.col("src"), F.col("dst")
    o = _orders(spark, sf_dir).where("o_orderpriority = '5-LOW'")
    direct = o.select(F.col("o_orderkey").alias("func"), (F.col("o_orderkey") % 2).cast("int").alias("idx"), F.when(F.col("o_orderstatus") == "F", "XSS").otherwise("SQL_INJECTION").alias("vuln_type"))
    passes = e.select(s.alias("func"), ((s + d) % 2).cast("int").alias("idx"), d.alias("callee"), (d % 2).cast("int").alias("callee_idx"))
    return graphs.params_to_sinks(direct, passes)


@query(f"""WITH RECURSIVE {EDGES}, gl AS (SELECT o_orderkey AS file, 'g' || (o_custkey % 7) AS name, o_orderpriority < '3' AS direct FROM orders WHERE o_orderstatus = 'F'),
    s AS (SELECT o_orderkey AS file, 'g' || (o_custkey % 5) AS name FROM orders WHERE o_orderstatus = 'O'),
    b AS (SELECT src, dst, false AS back, (src + dst) % 11 = 0 AS bad FROM e UNION ALL SELECT dst, src, true, (src + dst) % 11 = 0 FROM e),
    w AS (SELECT src, dst, back, 1 AS hops, bad FROM b UNION SELECT w.src, b.dst, w.back, w.hops + 1, w.bad OR b.bad FROM w JOIN b ON b.src = w.dst AND b.back = w.back WHERE w.hops < 12),
    way AS (SELECT src, dst, min({{'back': back, 'hops': hops, 'bad': bad}}) AS w FROM w GROUP BY 1, 2)
    SELECT g.file AS source_file, s.file AS sink_file, g.name, CAST(v.w.hops AS INTEGER) AS hops,
      round(greatest(1e-1, least(1e0, 7e-1 + CASE WHEN g.direct THEN 15e-2 ELSE 1e-1 END + CASE WHEN v.w.hops <= 1 THEN 1e-1 WHEN v.w.hops <= 3 THEN 5e-2 ELSE 0e0 END - CASE WHEN v.w.bad THEN 2e-1 ELSE 0e0 END)), 2) AS confidence
    FROM gl g JOIN way v ON v.src = g.file JOIN s ON s.file = v.dst AND s.name = g.name AND s.file <> g.file""")
def g26_cross_file_flows(spark, sf_dir):
    """Every eleventh include isn't resolved."""
    o, k, c = _orders(spark, sf_dir), F.col("o_orderkey"), F.col("o_custkey")
    name = lambda n: F.concat(F.lit("g"), (c % n).cast("string"))
    g = o.where("o_orderstatus = 'F'").select(k.alias("file"), name(7).alias("name"), (F.col("o_orderpriority") < "3").alias("direct"))
    s = o.where("o_orderstatus = 'O'").select(k.alias("file"), name(5).alias("name"))
    includes = edges(spark, sf_dir).withColumn("is_resolved", (F.col("src") + F.col("dst")) % 11 != 0)
    got = context.cross_file_flows(includes, g, s)
    return got.select("source_file", "sink_file", "name", "hops", F.round("confidence", 2).alias("confidence"))


@query("WITH l AS (SELECT event_id AS seq, CAST(event_id % 5 AS INTEGER) AS a, CAST(event_id // 5 % 5 AS INTEGER) AS b FROM events) SELECT seq, greatest(a, b) AS join_, least(a, b) AS meet_, CASE WHEN b > a THEN 4 ELSE a END AS widen_ FROM l")
def g14_lattice(spark, sf_dir):
    i = F.col("event_id")
    a, b = (i % 5).cast("int"), (F.floor(i / 5) % 5).cast("int")
    return read(spark, sf_dir, "events").select(i.alias("seq"), lattice.join(a, b).alias("join_"), lattice.meet(a, b).alias("meet_"), lattice.widen(a, b).alias("widen_"))


_SETS = """s AS (SELECT event_id AS seq, CASE event_id % 4 WHEN 0 THEN ['SQL', 'XSS'] WHEN 1 THEN ['XSS'] WHEN 2 THEN ['CMD', 'SQL', 'XSS'] ELSE [] END AS types, CASE event_id % 3 WHEN 0 THEN ['XSS'] WHEN 1 THEN ['SQL', 'CMD'] ELSE [] END AS san,
    CASE event_id % 5 WHEN 0 THEN ['INT', 'FLOAT'] WHEN 1 THEN ['STRING'] WHEN 2 THEN ['BOOL'] WHEN 3 THEN [] ELSE ['INT', 'STRING'] END AS kinds, CASE event_id % 7 WHEN 0 THEN 'XSS' WHEN 1 THEN 'SSRF' ELSE 'SQL_INJECTION' END AS vt FROM events)"""


def _pick(n: int, *values):
    out = F.lit(None)
    for k, v in enumerate(values):
        v = F.array(*map(F.lit, v)).cast("array<string>") if isinstance(v, list) else F.lit(v)
        out = v if k == 0 else F.when(F.col("event_id") % n == k, v).otherwise(out)
    return out


def _sets(spark, sf_dir):
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        _pick(4, ["SQL", "XSS"], ["XSS"], ["CMD", "SQL", "XSS"], []).alias("types"),
        _pick(3, ["XSS"], ["SQL", "CMD"], []).alias("san"),
        _pick(5, ["INT", "FLOAT"], ["STRING"], ["BOOL"], [], ["INT", "STRING"]).alias("kinds"),
        _pick(7, "XSS", "SSRF", *["SQL_INJECTION"] * 5).alias("vt"),
    )


@query(f"WITH {_SETS} SELECT seq, array_to_string(list_sort(list_filter(types, lambda x: NOT list_contains(san, x))), ',') AS active, array_to_string(list_sort(list_intersect(types, san)), ',') AS both_, list_has_any(types, san) AS overlap FROM s")
def u3_u4_u5_sets(spark, sf_dir):
    s = _sets(spark, sf_dir)
    return s.select("seq", F.array_join(lattice.active(F.col("types"), F.col("san")), ",").alias("active"), F.array_join(F.array_sort(F.array_intersect("types", "san")), ",").alias("both_"), F.arrays_overlap("types", "san").alias("overlap"))


@query(f"""WITH {_SETS} SELECT seq, vt IN ('SQL_INJECTION', 'XSS') AND len(kinds) > 0 AND len(list_filter(kinds, lambda k: k NOT IN ('BOTTOM', 'NULL', 'BOOL', 'INT', 'FLOAT'))) = 0 AS safe,
    array_to_string(list_sort(list_filter(['NULL', 'BOOL', 'INT', 'FLOAT', 'STRING', 'ARRAY', 'OBJECT', 'RESOURCE', 'CALLABLE'], lambda k: NOT list_contains(kinds, k))), ',') AS others FROM s""")
def f18_u6_types(spark, sf_dir):
    return _sets(spark, sf_dir).select("seq", lattice.type_safe(F.col("kinds"), F.col("vt")).alias("safe"), F.array_join(lattice.complement(F.col("kinds")), ",").alias("others"))


@query("""WITH e AS (SELECT event_id, 'v' || (event_id * 2 // 3) AS var, event_id % 3 = 2 OR event_id % 3 = 1 AND event_id % 2 = 0 AS later, CAST(event_id % 5 AS INTEGER) AS level, CASE WHEN event_id % 2 = 0 THEN ['A', 'B'] ELSE ['B'] END AS types, CASE WHEN event_id % 3 = 0 THEN ['B'] ELSE ['A', 'B'] END AS sanitized FROM events),
    x AS (SELECT * FROM e WHERE NOT later), y AS (SELECT * FROM e WHERE later)
    SELECT coalesce(x.var, y.var) AS var, greatest(x.level, y.level) AS level, array_to_string(list_sort(list_distinct(list_concat(coalesce(x.types, []), coalesce(y.types, [])))), ',') AS types,
      array_to_string(list_sort(CASE WHEN x.var IS NULL THEN y.sanitized WHEN y.var IS NULL THEN x.sanitized ELSE list_intersect(x.sanitized, y.sanitized) END), ',') AS sanitized FROM x FULL JOIN y ON x.var = y.var""")
def u7_a10_merge_states(spark, sf_dir):
    i = F.col("event_id")
    arr = lambda *v: F.array(*map(F.lit, v))
    e = read(spark, sf_dir, "events").select(((i % 3 == 2) | (i % 3 == 1) & (i % 2 == 0)).alias("later"), F.concat(F.lit("v"), F.floor(i * 2 / 3).cast("string")).alias("var"), (i % 5).cast("int").alias("level"), F.when(i % 2 == 0, arr("A", "B")).otherwise(arr("B")).alias("types"), F.when(i % 3 == 0, arr("B")).otherwise(arr("A", "B")).alias("sanitized"))
    got = lattice.merge(e.where("NOT later").drop("later"), e.where("later").drop("later"))
    return got.select("var", "level", F.array_join("types", ",").alias("types"), F.array_join("sanitized", ",").alias("sanitized"))


#: (literal text before what is tainted, type, how exposed it is)
POSITIONS = [
    ("SELECT a FROM t WHERE x = ", "SQL_INJECTION", "high"), ("SELECT a FROM ", "SQL_INJECTION", "medium"), ("SELECT ", "SQL_INJECTION", "low"), ("<!-- ", "XSS", "safe"), ('<a href="', "XSS", "high"), ("<p>", "XSS", "medium"),
    ("", "COMMAND_INJECTION", "high"), ("ls -l ", "COMMAND_INJECTION", "medium"), ("ls", "COMMAND_INJECTION", "low"), ("x", "SSRF", "medium"),
]


@query("SELECT event_id AS seq, CASE event_id % 10 " + " ".join(f"WHEN {k} THEN '{e}'" for k, (_, _, e) in enumerate(POSITIONS)) + " END AS exposure FROM events")
def g31_string_positions(spark, sf_dir):
    """Prefixes are cut in two at a place that depends on the row, so that fragments have to be put together."""
    i, prefix, kind = F.col("event_id"), F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, (text, vuln_type, _) in enumerate(POSITIONS):
        prefix, kind = F.when(i % 10 == k, text).otherwise(prefix), F.when(i % 10 == k, vuln_type).otherwise(kind)
    at = (i % 7).cast("int")
    fragment = lambda value, tainted: F.struct(value.alias("value"), F.lit(tainted).alias("tainted"))
    parts = F.array(fragment(F.substring(prefix, F.lit(1), at), False), fragment(F.substring(prefix, at + 1, F.lit(1000)), False), fragment(F.lit(None).cast("string"), True), fragment(F.lit("tail"), False))
    return read(spark, sf_dir, "events").select(i.alias("seq"), lattice.sink_position(lattice.first_tainted_prefix(parts), kind).alias("exposure"))
