"""Queries on calls and on values: summaries of functions, the order of a call graph, access paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import context, graphs, paths, summaries
from ..registry import query
from ..sources.corpus import read
from .graph_queries import EDGES, edges

#: Events as functions of six lines: a head, four statements by kind of event, and a return. Each calls the next one of its file; where a file has no more, the one of that name in other files is called, if there is one.
PROGRAM = """ev AS (SELECT *, (line_no - 1) // 6 AS k, (line_no - 1) % 6 AS p FROM (SELECT user_id AS u, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS line_no, event_id AS e, event_id % 5 AS n, (event_id + 1) % 5 AS m, event_type AS kind FROM events)),
    fn AS (SELECT DISTINCT u, k, u || ':f' || k AS f FROM ev), body AS (SELECT *, u || ':f' || k AS f FROM ev WHERE p BETWEEN 1 AND 4),
    called AS (SELECT b.f, b.line_no, CASE WHEN EXISTS (SELECT 1 FROM fn x WHERE x.u = b.u AND x.k = b.k + 1) THEN b.u || ':f' || (b.k + 1) WHEN b.k + 1 IN (SELECT k FROM fn) THEN '*:f' || (b.k + 1) END AS callee, 'v' || b.m AS given, 'c' || b.m AS val, 'v' || b.n AS made FROM body b WHERE kind = 'purchase'),
    mv AS (SELECT f, 'v' || m AS src, 'v' || n AS dst, []::VARCHAR[] AS c FROM body WHERE kind = 'click' UNION SELECT f, 'p' || (m % 2), 'v' || n, [] FROM body WHERE kind = 'click' UNION SELECT f, 'v' || m, 'v' || n, ['XSS'] FROM body WHERE kind = 'signup'
        UNION SELECT f, '_GET', 'v' || n, [] FROM body WHERE kind = 'view' UNION SELECT u || ':f' || k, 'v' || n, '#return', [] FROM ev WHERE p = 5 UNION SELECT f, val, made, [] FROM called UNION SELECT f, given, val, [] FROM called WHERE callee IS NULL UNION SELECT f, 'p0', val, [] FROM called WHERE callee IS NULL),
    arg AS (SELECT f, line_no, callee, 0 AS idx, given AS node, val FROM called WHERE callee IS NOT NULL UNION SELECT f, line_no, callee, 1, 'p0', val FROM called WHERE callee IS NOT NULL),
    target AS (SELECT f AS callee, f FROM fn UNION ALL SELECT '*:f' || k, f FROM fn),
    sink AS (SELECT f, line_no, 'v' || n AS node, CASE WHEN e % 2 = 0 THEN 'XSS' ELSE 'SQL_INJECTION' END AS t FROM body WHERE kind NOT IN ('view', 'click', 'signup', 'purchase')),
    pe(f, d, v, c) USING KEY (f, d, v, c) AS (SELECT f, 'param:0', 'p0', []::VARCHAR[] FROM fn UNION ALL SELECT f, 'param:1', 'p1', [] FROM fn UNION ALL SELECT DISTINCT f, 'source:_GET', '_GET', [] FROM body WHERE kind = 'view'
        UNION (SELECT p.f, p.d, m.dst, list_sort(list_distinct(p.c || m.c)) FROM pe p JOIN mv m ON m.f = p.f AND m.src = p.v
        UNION ALL SELECT a.f, q.d, a.val, list_sort(list_distinct(q.c || p.c)) FROM pe p JOIN target t ON t.f = p.f JOIN arg a ON a.callee = t.callee AND p.d = 'param:' || a.idx JOIN recurring.pe q ON q.f = a.f AND q.v = a.node WHERE p.v = '#return'
        UNION ALL SELECT a.f, q.d, a.val, list_sort(list_distinct(q.c || p.c)) FROM pe q JOIN arg a ON a.f = q.f AND a.node = q.v JOIN target t ON t.callee = a.callee JOIN recurring.pe p ON p.f = t.f AND p.v = '#return' AND p.d = 'param:' || a.idx
        UNION ALL SELECT a.f, p.d, a.val, p.c FROM pe p JOIN target t ON t.f = p.f JOIN arg a ON a.callee = t.callee WHERE p.v = '#return' AND p.d LIKE 'source:%')),
    ss AS (SELECT p.f, p.d, s.t FROM pe p JOIN sink s ON s.f = p.f AND s.node = p.v WHERE p.d LIKE 'param:%' AND NOT list_contains(p.c, s.t)
        UNION SELECT q.f, q.d, x.t FROM ss x JOIN target t ON t.f = x.f JOIN arg a ON a.callee = t.callee AND x.d = 'param:' || a.idx JOIN pe q ON q.f = a.f AND q.v = a.node WHERE q.d LIKE 'param:%' AND NOT list_contains(q.c, x.t))"""


def program_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of PROGRAM: (file_id, line_no, text)."""
    n, m = (F.concat(F.lit("$v"), ((F.col("event_id") + k) % 5).cast("string")) for k in (0, 1))
    e = read(spark, sf_dir, "events").withColumn("line_no", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    at, k, kind = (F.col("line_no") - 1) % 6, F.floor((F.col("line_no") - 1) / 6), F.col("event_type")
    text = (
        F.when(at == 0, F.concat(F.lit("function f"), k.cast("string"), F.lit("($p0, $p1) {")))
        .when(at == 5, F.concat(F.lit("return "), n, F.lit("; }")))
        .when(kind == "view", F.concat(n, F.lit(" = $_GET[k];")))
        .when(kind == "click", F.concat(n, F.lit(" = $p"), ((F.col("event_id") + 1) % 5 % 2).cast("string"), F.lit(" . "), m, F.lit(";")))
        .when(kind == "signup", F.concat(n, F.lit(" = htmlspecialchars("), m, F.lit(");")))
        .when(kind == "purchase", F.concat(n, F.lit(" = f"), (k + 1).cast("string"), F.lit("("), m, F.lit(", $p0);")))
        .when(F.col("event_id") % 2 == 0, F.concat(F.lit("echo "), n, F.lit(";")))
        .otherwise(F.concat(F.lit('mysql_query("x" . '), n, F.lit(");")))
    )
    return e.select(F.col("user_id").alias("file_id"), "line_no", text.alias("text"))


@query(f"WITH RECURSIVE {PROGRAM} SELECT f AS func, CAST(substr(d, 7) AS INTEGER) AS idx, t AS vuln_type FROM ss")
def g20_summaries(spark, sf_dir):
    """Parameters that reach a sink of a type, here or in what is called, through values that are returned, and not made harmless for it."""
    p = summaries.program(program_lines(spark, sf_dir))
    return summaries.parameters_to_sinks(p, graphs.cut(summaries.facts(p)))


@query(f"""WITH RECURSIVE {PROGRAM} SELECT p.f AS func, CAST(s.line_no AS INTEGER) AS line_no, s.t AS vuln_type, substr(p.d, 8) AS source, NULL AS callee FROM pe p JOIN sink s ON s.f = p.f AND s.node = p.v WHERE p.d LIKE 'source:%' AND NOT list_contains(p.c, s.t)
    UNION SELECT p.f, CAST(a.line_no AS INTEGER), x.t, substr(p.d, 8), a.callee FROM pe p JOIN arg a ON a.f = p.f AND a.node = p.v JOIN target t ON t.callee = a.callee JOIN ss x ON x.f = t.f AND x.d = 'param:' || a.idx WHERE p.d LIKE 'source:%' AND NOT list_contains(p.c, x.t)""")
def g20_findings(spark, sf_dir):
    """Sources that reach sinks, with values that calls hand in and out."""
    return summaries.findings(summaries.program(program_lines(spark, sf_dir)))


@query(f"""WITH RECURSIVE {EDGES}, reach AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM reach r JOIN e ON e.src = r.dst), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
    s AS (SELECT n.node, least(n.node, (SELECT min(a.dst) FROM reach a JOIN reach b ON b.src = a.dst AND b.dst = a.src WHERE a.src = n.node)) AS scc FROM n),
    up AS (SELECT DISTINCT a.scc AS src, b.scc AS dst FROM e JOIN s a ON a.node = e.src JOIN s b ON b.node = e.dst WHERE a.scc <> b.scc), lv AS (SELECT DISTINCT scc, 0 AS level FROM s UNION SELECT up.src, lv.level + 1 FROM lv JOIN up ON up.dst = lv.scc)
    SELECT s.node, s.scc, CAST(max(lv.level) AS INTEGER) AS level FROM s JOIN lv USING (scc) GROUP BY 1, 2""")
def g21_leaves_first(spark, sf_dir):
    """Components of the include graph in the order in which they can be summarised."""
    return graphs.leaves_first(edges(spark, sf_dir))


#: Events as statements on cells of arrays, whole variables, and cells whose keys aren't known.
CELLS = """ln AS (SELECT user_id AS u, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS l, event_id AS e, 'v' || (event_id % 3) AS v, 'v' || ((event_id + 1) % 3) AS o, 'k' || (event_id % 2) AS a, 'k' || (event_id // 2 % 2) AS b, event_type AS kind FROM events),
    df AS (SELECT u, l, v AS var, CASE WHEN kind = 'view' THEN CASE WHEN e % 3 = 0 THEN '' ELSE a END WHEN kind = 'click' THEN CASE WHEN e % 7 = 0 THEN '*' WHEN e % 2 = 0 THEN a ELSE '' END ELSE CASE WHEN e % 2 = 0 THEN '' ELSE a END END AS key FROM ln WHERE kind IN ('view', 'click', 'signup')),
    rd AS (SELECT u, l, o AS var, CASE WHEN e % 7 = 0 OR e % 2 = 1 THEN '' ELSE b END AS key, []::VARCHAR[] AS c, NULL::VARCHAR AS t FROM ln WHERE kind = 'click' UNION ALL SELECT u, l, o, CASE WHEN e % 2 = 0 THEN '' ELSE b END, CASE WHEN e % 2 = 0 THEN ['SQL_INJECTION', 'XSS'] ELSE ['XSS'] END, NULL FROM ln WHERE kind = 'signup'
        UNION ALL SELECT u, l, v, CASE WHEN kind = 'purchase' THEN a ELSE '' END, [], CASE WHEN kind = 'purchase' THEN 'SQL_INJECTION' ELSE 'XSS' END FROM ln WHERE kind NOT IN ('view', 'click', 'signup')),
    dd AS (SELECT d.*, coalesce((SELECT max(w.l) FROM df w WHERE w.u = d.u AND w.var = d.var AND w.key = '' AND w.l < d.l), 0) AS epoch FROM df d),
    r0 AS (SELECT r.*, coalesce((SELECT max(w.l) FROM df w WHERE w.u = r.u AND w.var = r.var AND w.key = '' AND w.l < r.l), 0) AS epoch FROM rd r),
    rr AS (SELECT r.*, greatest(epoch, coalesce((SELECT max(w.l) FROM df w WHERE w.u = r.u AND w.var = r.var AND w.key = r.key AND w.key <> '*' AND w.l < r.l), 0)) AS exact FROM r0 r),
    seed AS (SELECT u, l, CASE WHEN e % 3 = 0 THEN '_GET' ELSE '_POST' END AS o, []::VARCHAR[] AS c FROM ln WHERE kind = 'view')"""


def _taint(name: str, seeds: str) -> str:
    on = "r.t IS NULL AND r.u = x.u"
    return f"""{name}(u, l, o, c) AS ({seeds} UNION (SELECT r.u, r.l, x.o, list_sort(list_distinct(x.c || r.c)) FROM {name} x JOIN rr r ON {on} AND r.exact = x.l
        UNION ALL SELECT r.u, r.l, x.o, list_sort(list_distinct(x.c || r.c)) FROM {name} x JOIN dd d ON d.u = x.u AND d.l = x.l AND d.key <> '' JOIN rr r ON {on} AND r.var = d.var AND r.epoch = d.epoch AND r.l > d.l AND (r.key IN ('', '*') OR d.key = '*'))),
    {name}_sunk AS (SELECT r.u, r.l, r.t, r.var, r.key, x.o, x.c || r.c AS c FROM {name} x JOIN rr r ON r.t IS NOT NULL AND r.u = x.u AND r.exact = x.l
        UNION SELECT r.u, r.l, r.t, r.var, r.key, x.o, x.c || r.c FROM {name} x JOIN dd d ON d.u = x.u AND d.l = x.l AND d.key <> '' JOIN rr r ON r.t IS NOT NULL AND r.u = x.u AND r.var = d.var AND r.epoch = d.epoch AND r.l > d.l AND (r.key IN ('', '*') OR d.key = '*'))"""


def cell_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of CELLS: (file_id, line_no, text)."""
    i = F.col("event_id")
    v, o = (F.concat(F.lit("$v"), ((i + k) % 3).cast("string")) for k in (0, 1))
    a, b = (F.concat(F.lit("['k"), k.cast("string"), F.lit("']")) for k in (i % 2, F.floor(i / 2) % 2))
    text = (
        F.when(F.col("event_type") == "view", F.when(i % 3 == 0, F.concat(v, F.lit(" = $_GET['x'];"))).otherwise(F.concat(v, a, F.lit(" = $_POST['x'];"))))
        .when(F.col("event_type") == "click", F.when(i % 7 == 0, F.concat(v, F.lit("[$i] = "), o, F.lit(";"))).when(i % 2 == 0, F.concat(v, a, F.lit(" = "), o, b, F.lit(";"))).otherwise(F.concat(v, F.lit(" = "), o, F.lit(";"))))
        .when(F.col("event_type") == "signup", F.when(i % 2 == 0, F.concat(v, F.lit(" = intval("), o, F.lit(");"))).otherwise(F.concat(v, a, F.lit(" = htmlspecialchars("), o, b, F.lit(");"))))
        .when(F.col("event_type") == "purchase", F.concat(F.lit('mysql_query("x" . '), v, a, F.lit(");")))
        .otherwise(F.concat(F.lit("echo "), v, F.lit(";")))
    )
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("file_id"), F.row_number().over(w).alias("line_no"), text.alias("text"))


@query(f"WITH RECURSIVE {CELLS}, {_taint('tt', 'SELECT * FROM seed')} SELECT DISTINCT u AS file_id, l AS line_no, t AS vuln_type, o AS origin FROM tt_sunk WHERE NOT list_contains(c, t)")
def g1_access_paths(spark, sf_dir):
    """Sources that reach sinks through variables and cells of arrays, with what overwrites them."""
    return paths.findings(paths.uses(cell_lines(spark, sf_dir))).withColumnRenamed("file", "file_id")


@query(f"""WITH RECURSIVE {CELLS}, {_taint('tt', "SELECT * FROM seed UNION SELECT u, l, 'UNDEFINED', c FROM rr WHERE exact = 0 AND t IS NULL")}
    SELECT r.u AS file_id, r.l AS line_no, r.t AS vuln_type, r.var, r.key, CAST(r.exact AS INTEGER) AS assigned_at,
      r.exact > 0 AND NOT EXISTS (SELECT 1 FROM tt_sunk x WHERE x.u = r.u AND x.l = r.l AND x.var = r.var AND x.key = r.key AND x.t = r.t AND NOT list_contains(x.c, r.t)) AS is_clean FROM rr r WHERE r.t IS NOT NULL""")
def g7_presink_index(spark, sf_dir):
    """What sinks read, and whether it has been made harmless for them by then."""
    return paths.presink(paths.uses(cell_lines(spark, sf_dir))).withColumnRenamed("file", "file_id")


OBJECTS = """ln AS (SELECT user_id AS u, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS l, user_id || ':v' || (event_id % 9) AS v, user_id || ':v' || ((event_id + 1) % 9) AS o, 'f' || (event_id % 2) AS f, event_type AS kind FROM events),
    mv AS (SELECT v AS lhs, o AS rhs FROM ln WHERE kind = 'click' OR kind NOT IN ('view', 'click', 'signup', 'purchase') UNION SELECT o, v FROM ln WHERE kind NOT IN ('view', 'click', 'signup', 'purchase')),
    st AS (SELECT DISTINCT v AS base, f, o AS rhs FROM ln WHERE kind = 'signup'), lo AS (SELECT DISTINCT v AS lhs, o AS base, f FROM ln WHERE kind = 'purchase'),
    pts(v, loc) USING KEY (v, loc) AS (SELECT v, u || ':' || l FROM ln WHERE kind = 'view' AND l % 4 = 0
        UNION (SELECT m.lhs, p.loc FROM pts p JOIN mv m ON m.rhs = p.v
        UNION ALL SELECT b.loc || '.' || s.f, r.loc FROM pts b JOIN st s ON s.base = b.v JOIN recurring.pts r ON r.v = s.rhs
        UNION ALL SELECT b.loc || '.' || s.f, r.loc FROM pts r JOIN st s ON s.rhs = r.v JOIN recurring.pts b ON b.v = s.base
        UNION ALL SELECT o.lhs, c.loc FROM pts b JOIN lo o ON o.base = b.v JOIN recurring.pts c ON c.v = b.loc || '.' || o.f
        UNION ALL SELECT o.lhs, c.loc FROM pts c JOIN recurring.pts b ON starts_with(c.v, b.loc || '.') JOIN lo o ON o.base = b.v AND c.v = b.loc || '.' || o.f))"""


@query(f"WITH RECURSIVE {OBJECTS} SELECT v AS var, loc FROM pts")
def g30_from_code(spark, sf_dir):
    """What variables and fields may point to, by constraints that are drawn from lines, with copies in cycles."""
    i, k = F.col("event_id"), F.col("event_type")
    v, o = (F.concat(F.lit("$v"), ((i + d) % 9).cast("string")) for d in (0, 1))
    f = F.concat(F.lit("->f"), (i % 2).cast("string"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, sf_dir, "events").withColumn("line_no", F.row_number().over(w))
    text = (
        F.when(k == "view", F.when(F.col("line_no") % 4 == 0, F.concat(v, F.lit(" = new A();"))).otherwise("// nothing"))
        .when(k == "click", F.concat(v, F.lit(" = "), o, F.lit(";")))
        .when(k == "signup", F.concat(v, f, F.lit(" = "), o, F.lit(";")))
        .when(k == "purchase", F.concat(v, F.lit(" = "), o, f, F.lit(";")))
        .otherwise(F.concat(v, F.lit(" = &"), o, F.lit(";")))
    )
    return graphs.points_to(**context.alias_constraints(e.select(F.col("user_id").alias("file_id"), "line_no", text.alias("text"))))
