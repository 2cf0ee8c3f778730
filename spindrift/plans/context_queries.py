"""Queries on what files say about themselves, and on pluggable filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import context, filters
from ..registry import query
from ..sources.corpus import LINES, event_lines, read

#: Statements of many kinds, by event number.
TEXTS = [
    "include 'inc/a.php';", "require_once __DIR__ . '/b.php';", "global $x, $y;", "$GLOBALS['cfg'] = $_GET['c'];", "if (in_array($p, $ok)) {", "}", "switch ($m) {", "$a = (int) $b;", "$q->where('id', $i);", "return 1;",
    "if (false) {", "$s->prepare($z);", "if (file_exists($f)) {", "unlink($f);", "if (is_numeric($n)) {", "echo {{ $v }};", "{!! $raw !!}", "if ($_SESSION['auth']) {", "$e === 'x';", "fopen($f, 'r');",
]
_CASES = " ".join(f"WHEN {i} THEN '{t.replace(chr(39), chr(39) * 2)}'" for i, t in enumerate(TEXTS))
MIXED = f"mixed AS (SELECT file_id, line_no, seq, CASE seq * 7 % 20 {_CASES} END AS text FROM lines)"


def mixed(spark, sf_dir):
    k, text = F.col("seq") * 7 % 20, F.lit(None).cast("string")
    for i, t in enumerate(TEXTS):
        text = F.when(k == i, t).otherwise(text)
    return event_lines(spark, sf_dir).withColumn("text", text)


@query(f"WITH {LINES}, {MIXED} SELECT file_id, line_no, CASE WHEN starts_with(text, 'include') THEN 'include' ELSE 'require_once' END AS kind, CASE WHEN starts_with(text, 'include') THEN 'inc/a.php' ELSE '/b.php' END AS ref FROM mixed WHERE regexp_matches(text, '^(include|require_once)')")
def g22_includes(spark, sf_dir):
    return context.includes(mixed(spark, sf_dir))


@query("""WITH f AS (SELECT DISTINCT '/src/' || source || '/' || lang || '.php' AS path FROM documents), r AS (SELECT path, CASE WHEN path LIKE '%en.php' THEN './de.php' WHEN path LIKE '%de.php' THEN '../src1/fr.php' WHEN path LIKE '%fr.php' THEN 'src/src2/es.php' ELSE 'no.php' END AS ref FROM f),
    b AS (SELECT path AS src, regexp_replace(path, '[^/]*$', '') AS dir, ref FROM r), c AS (SELECT src, CASE ref WHEN './de.php' THEN dir || 'de.php' WHEN '../src1/fr.php' THEN '/src/src1/fr.php' ELSE dir || ref END AS beside, CASE ref WHEN './de.php' THEN '/de.php' WHEN '../src1/fr.php' THEN '/src1/fr.php' ELSE '/' || ref END AS root FROM b)
    SELECT src, coalesce(x.path, y.path, beside) AS dst, coalesce(x.path, y.path) IS NOT NULL AS is_resolved FROM c LEFT JOIN f x ON x.path = c.beside LEFT JOIN f y ON y.path = c.root""")
def g22_j12_include_edges(spark, sf_dir):
    f = read(spark, sf_dir, "documents").select(F.concat(F.lit("/src/"), "source", F.lit("/"), "lang", F.lit(".php")).alias("path")).distinct()
    p = F.col("path")
    ref = F.when(p.endswith("en.php"), "./de.php").when(p.endswith("de.php"), "../src1/fr.php").when(p.endswith("fr.php"), "src/src2/es.php").otherwise("no.php")
    return context.include_edges(f.withColumn("ref", ref), f)


@query(f"WITH {LINES}, {MIXED} SELECT file_id, line_no, unnest(CASE WHEN starts_with(text, 'global') THEN ['x', 'y'] ELSE ['cfg'] END) AS name, contains(text, '$_GET') AS tainted FROM mixed WHERE starts_with(text, 'global') OR starts_with(text, '$GLOBALS')")
def g25_globals(spark, sf_dir):
    return context.globals_(mixed(spark, sf_dir))


_NS = """f AS (SELECT doc_id, '/s/' || doc_id || '.php' AS path, CASE WHEN doc_id % 3 = 0 THEN 'namespace App\\N' || doc_id % 5 || ';' || chr(10) ELSE '' END || 'use Lib\\A;' || chr(10) || 'use Lib\\B as C;' || chr(10) || CASE WHEN doc_id % 7 > 0 THEN 'final class K' || doc_id || ' {' ELSE 'x' END AS code FROM documents)"""


def _ns(spark, sf_dir):
    d = F.col("doc_id")
    nl = F.lit("\n")
    code = F.concat(F.when(d % 3 == 0, F.concat(F.lit("namespace App\\N"), (d % 5).cast("string"), F.lit(";"), nl)).otherwise(""), F.lit("use Lib\\A;\nuse Lib\\B as C;\n"), F.when(d % 7 > 0, F.concat(F.lit("final class K"), d.cast("string"), F.lit(" {"))).otherwise("x"))
    return read(spark, sf_dir, "documents").select(d, F.concat(F.lit("/s/"), d.cast("string"), F.lit(".php")).alias("path"), code.alias("code"))


@query(f"WITH {_NS} SELECT path, CASE WHEN doc_id % 3 = 0 THEN 'App\\N' || doc_id % 5 ELSE '' END AS namespace, 'K' || doc_id AS class, CASE WHEN doc_id % 3 = 0 THEN 'App\\N' || doc_id % 5 || '\\' ELSE '' END || 'K' || doc_id AS fqcn FROM f WHERE doc_id % 7 > 0")
def g27_namespaces(spark, sf_dir):
    return context.namespaces(_ns(spark, sf_dir))


@query(f"WITH {_NS} SELECT path, 'A' AS alias, 'Lib\\A' AS fqcn FROM f UNION ALL SELECT path, 'C', 'Lib\\B' FROM f")
def g27_use_aliases(spark, sf_dir):
    return context.use_aliases(_ns(spark, sf_dir))


_VARS = "CASE WHEN contains(text, 'in_array') THEN ['in_array', '$p'] WHEN starts_with(text, 'switch') THEN ['switch', '$m'] WHEN contains(text, 'is_numeric') THEN ['is_numeric', '$n'] WHEN contains(text, '===') THEN ['strict_compare', '$e'] END"


@query(f"WITH {LINES}, {MIXED}, v AS (SELECT file_id, line_no, {_VARS} AS v FROM mixed) SELECT file_id, v[2] AS var, v[1] AS kind, min(line_no) AS line_no FROM v WHERE v IS NOT NULL GROUP BY 1, 2, 3")
def g35_whitelists(spark, sf_dir):
    return context.whitelisted(mixed(spark, sf_dir))


@query(f"WITH {LINES}, {MIXED} SELECT file_id, line_no, 'int' AS kind, '$b' AS var FROM mixed WHERE contains(text, '(int)')")
def g36_casts(spark, sf_dir):
    return context.casts(mixed(spark, sf_dir))


@query(f"WITH {LINES}, {MIXED} SELECT file_id, line_no, CASE WHEN contains(text, 'where') THEN 'builder' ELSE 'prepared' END AS kind FROM mixed WHERE contains(text, '->where(') OR contains(text, '->prepare(')")
def g36_orm_use(spark, sf_dir):
    return context.orm_use(mixed(spark, sf_dir))


@query(rf"""WITH {LINES}, {MIXED}, o AS (SELECT file_id, line_no, trim(text) AS t, length(replace(text, '}}}}', '')) - length(replace(text, '{{{{', '')) AS o FROM mixed),
    d AS (SELECT *, CAST(sum(o) OVER (PARTITION BY file_id ORDER BY line_no) AS BIGINT) AS depth FROM o), b AS (SELECT *, coalesce(lag(depth) OVER (PARTITION BY file_id ORDER BY line_no), 0) AS before FROM d),
    k AS (SELECT *, least(depth, before - length(replace(regexp_extract(t, '^[}}}} ]*'), ' ', ''))) AS low FROM b),
    m AS (SELECT file_id, line_no, CASE WHEN t = 'if (false) {{{{' THEN before ELSE depth - 1 END AS level, CASE WHEN t = 'if (false) {{{{' THEN 'constant' ELSE 'after_exit' END AS reason FROM k WHERE t IN ('if (false) {{{{', 'return 1;')),
    s AS (SELECT *, coalesce((SELECT min(e.line_no) FROM k e WHERE e.file_id = m.file_id AND e.line_no > m.line_no AND e.low <= m.level), 2147483647) AS end_ FROM m)
    SELECT k.file_id, k.line_no, c.reason FROM k, LATERAL (SELECT max(struct_pack(e := s.end_, l := -s.line_no, r := s.reason)) AS c FROM s WHERE s.file_id = k.file_id AND s.line_no < k.line_no) x, LATERAL (SELECT x.c.e AS e, x.c.r AS reason) c
    WHERE k.line_no < c.e AND k.t <> ''""".replace("{{", "{").replace("}}", "}"))
def g34_dead_lines(spark, sf_dir):
    return context.dead_lines(mixed(spark, sf_dir))


@query(f"""WITH {LINES}, {MIXED} SELECT m.file_id, m.line_no FROM mixed m WHERE (starts_with(m.text, 'unlink') OR starts_with(m.text, 'fopen')) AND EXISTS (SELECT 1 FROM mixed g WHERE g.file_id = m.file_id AND contains(g.text, 'file_exists') AND g.line_no BETWEEN m.line_no - 19 AND m.line_no)""")
def f19_file_guard(spark, sf_dir):
    m = mixed(spark, sf_dir)
    hits = m.where("text LIKE 'unlink%' OR text LIKE 'fopen%'").select("file_id", "line_no", F.lit("f").alias("var"))
    return context.file_guarded(hits, m).select("file_id", "line_no")


@query(f"WITH {LINES}, {MIXED} SELECT file_id, line_no, CASE WHEN contains(text, '{{!!') THEN 'raw' WHEN contains(text, '{{{{') THEN 'escaped' END AS printed FROM mixed")
def w27_blade_escaping(spark, sf_dir):
    return mixed(spark, sf_dir).select("file_id", "line_no", context.blade_escaping(F.col("text")).alias("printed"))


@query(f"WITH {LINES}, {MIXED} SELECT file_id, line_no, coalesce(max(CASE WHEN regexp_matches(text, '(?i)if\\s*\\([^)]*(logged|auth|admin|session)') THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) = 1 AS in_auth FROM mixed")
def f9_auth_context(spark, sf_dir):
    from ..functions import lines as L

    return mixed(spark, sf_dir).select("file_id", "line_no", L.seen(F.col("text").rlike(context.AUTH), "auth").alias("in_auth"))


_ROLES = "roles AS (SELECT DISTINCT event_id // 3 AS file_id, CASE event_id * 7 % 11 % 6 WHEN 0 THEN 'ajax' WHEN 1 THEN 'admin' WHEN 2 THEN 'file_ops' WHEN 3 THEN 'auth' ELSE 'db' END AS role FROM events)"


@query(f"WITH {_ROLES} SELECT DISTINCT file_id FROM roles WHERE role = 'ajax' UNION SELECT file_id FROM roles WHERE role IN ('admin', 'file_ops') AND file_id NOT IN (SELECT file_id FROM roles WHERE role = 'auth')")
def j20_auth_gaps(spark, sf_dir):
    i = F.col("event_id")
    k = i * 7 % 11 % 6
    role = F.when(k == 0, "ajax").when(k == 1, "admin").when(k == 2, "file_ops").when(k == 3, "auth").otherwise("db")
    return context.auth_gaps(read(spark, sf_dir, "events").select(F.floor(i / 3).alias("file_id"), role.alias("role")).distinct())


@query("""WITH d AS (SELECT doc_id, doc_id % 4 AS k FROM documents), r AS (SELECT doc_id, 'f' || doc_id AS field, CASE k WHEN 0 THEN 'integer' WHEN 1 THEN 'email' WHEN 2 THEN 'in' END AS rule FROM d UNION ALL SELECT doc_id, 'u', 'uuid' FROM d WHERE doc_id % 3 = 0)
    SELECT CAST(doc_id AS VARCHAR) AS path, field, rule, CASE rule WHEN 'integer' THEN 'COMMAND_INJECTION,SQL_INJECTION,XSS' WHEN 'email' THEN 'SQL_INJECTION' WHEN 'in' THEN 'FILE_INCLUSION,SQL_INJECTION,XSS' ELSE 'SQL_INJECTION,XSS' END AS safe_for FROM r WHERE rule IS NOT NULL""")
def g37_validated_fields(spark, sf_dir):
    i = F.col("doc_id")
    rule = F.when(i % 4 == 0, "required|integer|min:1").when(i % 4 == 1, "email").when(i % 4 == 2, "in:x,y").otherwise("string")
    other = F.when(i % 3 == 0, ", \"u\" => \"nullable|uuid\"").otherwise("")
    code = F.concat(F.lit("<?php\n$r->validate([\n'f"), i.cast("string"), F.lit("' => '"), rule, F.lit("'"), other, F.lit("]);"))
    files = read(spark, sf_dir, "documents").select(i.cast("string").alias("path"), code.alias("code"))
    return context.validated_fields(files).select("path", "field", "rule", F.array_join(F.array_sort("safe_for"), ",").alias("safe_for"))


@query("WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS path, doc_id % 3 AS k FROM documents) SELECT path, unnest(CASE k WHEN 0 THEN ['auth', 'verified'] WHEN 1 THEN ['throttle:6', 'auth'] ELSE [] END) AS name FROM d")
def g37_middleware(spark, sf_dir):
    k = F.col("doc_id") % 3
    code = F.when(k == 0, "Route::get('/x')->middleware(['auth', 'verified']);").when(k == 1, "Route::get('/y')->middleware('throttle:6'); Route::get('/z')->middleware( \"auth\" );").otherwise("x")
    return context.middleware(read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), code.alias("code")))


@query("""WITH g AS (SELECT event_id AS seq, event_id % 2 = 0 AS nosrc, event_id % 3 AS n, event_id % 5 < 2 AS fw, event_id % 7 < 3 AS orm, event_id % 11 = 0 AS auth FROM events)
    SELECT seq, 1e0 * CASE WHEN nosrc THEN 5e-1 ELSE 1e0 END * CASE WHEN n > 0 THEN 3e-1 ELSE 1e0 END * CASE WHEN n > 1 THEN 5e-1 ELSE 1e0 END * CASE WHEN fw AND orm THEN 4e-1 WHEN fw THEN 7e-1 ELSE 1e0 END * CASE WHEN auth THEN 8e-1 ELSE 1e0 END AS confidence FROM g""")
def c18_multiplicative(spark, sf_dir):
    i = F.col("event_id")
    return read(spark, sf_dir, "events").select(i.alias("seq"), context.multiplicative(i % 2 == 0, i % 3, i % 5 < 2, i % 7 < 3, i % 11 == 0).alias("confidence"))


#: (condition, whether its false branch is meant, the types that it leaves)
NARROWINGS = [
    ("is_int($x)", False, "INT"), ("!is_int($x)", False, "ARRAY,BOOL,CALLABLE,FLOAT,NULL,OBJECT,RESOURCE,STRING"), ("is_numeric($x)", False, "FLOAT,INT"), ("isset($x)", True, "NULL"), ("$x instanceof A", False, "OBJECT"),
    ("$x === null", True, "ARRAY,BOOL,CALLABLE,FLOAT,INT,OBJECT,RESOURCE,STRING"), ("$x > 3", False, "ARRAY,BOOL,CALLABLE,FLOAT,INT,NULL,OBJECT,RESOURCE,STRING"),
]


@query("SELECT event_id AS seq, CASE event_id % 7 " + " ".join(f"WHEN {k} THEN '{t}'" for k, (_, _, t) in enumerate(NARROWINGS)) + " END AS types FROM events")
def g29_narrowing(spark, sf_dir):
    i, text, negated = F.col("event_id"), F.lit(None).cast("string"), F.lit(False)
    for k, (condition, neg, _) in enumerate(NARROWINGS):
        text, negated = F.when(i % 7 == k, condition).otherwise(text), F.when(i % 7 == k, neg).otherwise(negated)
    return read(spark, sf_dir, "events").select(i.alias("seq"), F.array_join(context.narrowed(text, negated), ",").alias("types"))


_ML = "m AS (SELECT event_id AS seq, event_id % 10 / 1e1 AS ml_score, CASE event_id % 3 WHEN 0 THEN 'SAFE' WHEN 1 THEN 'VULN' END AS ml_class, event_id % 9 / 9e0 AS ml_prob, CASE WHEN event_id % 4 > 0 THEN 'GET' END AS source, event_id % 8 = 0 AS verified FROM events)"


@query(f"WITH {_ML} SELECT seq FROM m WHERE ml_score > 1 - 7e-1 AND (NOT (ml_class = 'SAFE' AND ml_prob >= 8e-1) OR ml_class IS NULL) AND (source IS NOT NULL OR verified)")
def f23_x3_filter_registry(spark, sf_dir):
    i = F.col("event_id")
    m = read(spark, sf_dir, "events").select(i.alias("seq"), (i % 10 / F.lit(10.0)).alias("ml_score"), F.when(i % 3 == 0, "SAFE").when(i % 3 == 1, "VULN").alias("ml_class"), (i % 9 / F.lit(9.0)).alias("ml_prob"), F.when(i % 4 > 0, "GET").alias("source"), (i % 8 == 0).alias("verified"))
    for name in ("none", "binary", "multiclass", "flow"):
        m = filters.create(name)(m)
    return m.select("seq")


@query("SELECT event_id AS seq, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 2 = 0 END AS is_real FROM events")
def x6_outside_verifier(spark, sf_dir):
    def verify(rows):
        if rows[0]["seq"] % 5 == 0:
            raise TimeoutError
        return [r["seq"] % 2 == 0 for r in rows]

    e = read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"))
    return filters.verified(e, verify, batch=1)


@query("SELECT count(*) AS findings, count(*) * 800 AS tokens, count(*) * 800 * 3e0 / 1e6 AS cost FROM events")
def x6_verifier_cost(spark, sf_dir):
    return filters.verifier_cost(read(spark, sf_dir, "events"))


@query("""WITH g AS (SELECT event_id AS seq, CASE WHEN event_id % 3 > 0 THEN event_id % 7 / 7e0 END AS t, event_id % 5 / 5e0 AS e FROM events), s AS (SELECT seq, CASE WHEN t IS NULL THEN e ELSE 6e-1 * t + 4e-1 * e END AS score FROM g) SELECT seq, score, score >= 25e-2 AS kept FROM s""")
def m8_per_type_blend(spark, sf_dir):
    i = F.col("event_id")
    b = filters.per_type_blend(F.when(i % 3 > 0, i % 7 / F.lit(7.0)), i % 5 / F.lit(5.0))
    return read(spark, sf_dir, "events").select(i.alias("seq"), b["score"].alias("score"), b["kept"].alias("kept"))
