"""Queries on the steps that a finding passes, over a corpus of statements of many kinds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classify, matching, programs, stages, taint
from ..registry import query
from ..sources.corpus import FILES, LINES, doc_files, event_lines, read
from .program_queries import whole_files

#: Statements by number; what each is, is known, so that SQL goes by the numbers and not by expressions.
STATEMENTS = [
    "// a note", " * @param string $x its name", "<div class='a'>", "include 'inc/a.php';", "$v1 = $_GET['k1'];", "$v2 = $row->fetch_assoc();", "$v3 = my_clean($v1);", 'mysql_query("SELECT 1 WHERE a=" . $v1);',
    "echo $v2;", "if (is_admin()) { f(); }", "global $cfg;", "$v1 = $v2;", "echo $v3;", "{{ title }}", "while (next()) { g(); }", "namespace App;",
]
COMMENTS, MARKUP, LITERAL, INPUT, STORE, WRAPPED, SINK, ADMIN, GLOBAL, LOOP, NAMESPACE = (0, 1), (2, 13), (3,), 4, 5, 6, 7, 9, 10, 14, 15
_PATH = "'/site/' || CASE file_id % 5 WHEN 0 THEN 'admin' WHEN 1 THEN 'wp-admin' WHEN 2 THEN 'shop' WHEN 3 THEN 'app' ELSE 'lib' END || '/' || CASE file_id % 4 WHEN 0 THEN 'login' WHEN 1 THEN 'index' WHEN 2 THEN 'upload_form' ELSE 'view' END || file_id || '.php'"
NUMBERED = f"{LINES}, st AS (SELECT file_id, line_no, seq, seq * 7 % 16 AS k FROM lines)"
_TEXTS = " ".join(f"WHEN {i} THEN '{t.replace(chr(39), chr(39) * 2)}'" for i, t in enumerate(STATEMENTS))
_SITE = f"{NUMBERED}, site AS (SELECT file_id, {_PATH} AS path, '<?php' || chr(10) || string_agg(CASE k {_TEXTS} END, chr(10) ORDER BY line_no) AS code, bool_or(k = {ADMIN} AND line_no < 50) AS admin_code, bool_or(k = {INPUT}) AS asks FROM st GROUP BY 1)"


def statements(spark, sf_dir):
    k, text = F.col("seq") * 7 % 16, F.lit(None).cast("string")
    for i, t in enumerate(STATEMENTS):
        text = F.when(k == i, t).otherwise(text)
    return event_lines(spark, sf_dir).withColumn("text", text)


def site(spark, sf_dir):
    i = F.col("file_id")
    top = F.when(i % 5 == 0, "admin").when(i % 5 == 1, "wp-admin").when(i % 5 == 2, "shop").when(i % 5 == 3, "app").otherwise("lib")
    name = F.when(i % 4 == 0, "login").when(i % 4 == 1, "index").when(i % 4 == 2, "upload_form").otherwise("view")
    path = F.concat(F.lit("/site/"), top, F.lit("/"), name, i.cast("string"), F.lit(".php"))
    return whole_files(statements(spark, sf_dir)).withColumn("path", path)


def _reason(text):
    return stages.prefilter(text, F.col("in_comment"))


def _commented(spark, sf_dir):
    from ..functions import lines as L

    return statements(spark, sf_dir).withColumn("in_comment", L.in_comment())


_FIRST = f"CASE WHEN k IN {COMMENTS} THEN 'comment' WHEN k IN {MARKUP} THEN 'markup' WHEN k = {LITERAL[0]} THEN 'hardcoded' END"


@query(f"WITH {NUMBERED} SELECT file_id, line_no, {_FIRST} AS reason FROM st")
def f12_prefilter(spark, sf_dir):
    return _commented(spark, sf_dir).select("file_id", "line_no", _reason(F.col("text")).alias("reason"))


@query(f"WITH {NUMBERED}, r AS (SELECT file_id, line_no, {_FIRST} AS a, CASE WHEN k = {WRAPPED} THEN 'wrapped' END AS b FROM st) SELECT file_id, line_no, coalesce(a, b) IS NOT NULL AS is_fp, coalesce(a, b) AS reason, CASE WHEN a IS NOT NULL THEN 'prefilter' WHEN b IS NOT NULL THEN 'context' END AS stage FROM r")
def f17_stages(spark, sf_dir):
    t = F.col("text")
    wrapped = matching.first_reason([("wrapped", stages.wrapped(t, F.array(F.lit("my_clean"), F.lit("other"))))])
    said = stages.staged([("prefilter", _reason(t)), ("context", wrapped)])
    return _commented(spark, sf_dir).select("file_id", "line_no", said.alias("s")).select("file_id", "line_no", "s.is_fp", "s.reason", "s.stage")


@query(f"""WITH {NUMBERED}, f AS (SELECT file_id, line_no, seq, k, seq % 3 > 0 AS tainted, seq % 5 = 0 AS sanitized, seq % 7 = 0 AS checked, seq % 4 = 0 AS keyed FROM st WHERE k IN ({SINK}, 8, 12, 13)),
    r AS (SELECT *, CASE WHEN k = 13 THEN 'markup' END AS a, CASE WHEN NOT tainted THEN 'no_taint' WHEN sanitized THEN 'sanitized' END AS b, CASE WHEN checked THEN 'checked' END AS c, CASE WHEN keyed THEN 'sanitizer_near_key' END AS d FROM f)
    SELECT file_id, line_no, coalesce(a, b, c, d) IS NOT NULL AS is_fp, coalesce(a, b, c, d) AS reason, CASE WHEN a IS NOT NULL THEN 'context' WHEN b IS NOT NULL THEN 'taint' WHEN c IS NOT NULL THEN 'advanced' WHEN d IS NOT NULL THEN 'near' END AS stage FROM r""")
def f15_zero_fp(spark, sf_dir):
    s = F.col("seq")
    near = F.when(s % 4 == 0, "$a = intval($_GET['k[1]']);").otherwise("$a = intval($_GET['k.1.']);")
    f = _commented(spark, sf_dir).where((s * 7 % 16).isin(SINK, 8, 12, 13)).select("file_id", "line_no", "text", "in_comment", (s % 3 > 0).alias("tainted"), (s % 5 == 0).alias("sanitized"), (s % 7 == 0).alias("checked"), F.lit("k[1]").alias("source_key"), near.alias("near"))
    return stages.zero_fp(f).select("file_id", "line_no", "is_fp", "reason", "stage")


@query(f"WITH {_SITE} SELECT file_id, file_id % 5 < 2 AS admin_path, admin_code, file_id % 5 < 2 AND admin_code AS admin_only FROM site")
def f8_admin_files(spark, sf_dir):
    return stages.admin_files(site(spark, sf_dir)).select("file_id", "admin_path", "admin_code", "admin_only")


@query(f"WITH {_SITE} SELECT file_id, NOT asks AS quick_skip, file_id % 7 = 0 AS skipped FROM site")
def f1_f6_file_gates(spark, sf_dir):
    packed = F.when(F.col("file_id") % 7 == 0, F.concat(F.lit("<?php $_F=__FILE__;"), F.expr("repeat('x', 6000)"))).when(F.col("file_id") % 7 == 1, F.expr("repeat('x', 6000)")).otherwise(F.lit("$_F=__FILE__; ioncube"))
    return site(spark, sf_dir).select("file_id", stages.without_input(F.col("code")).alias("quick_skip"), stages.packed(packed).alias("skipped"))


@query(f"""WITH {_SITE}, r AS (SELECT *, file_id % 5 < 2 OR file_id % 4 IN (0, 2) AS named FROM site), o AS (SELECT *, row_number() OVER (PARTITION BY named ORDER BY path) AS rn FROM r)
    SELECT file_id, named FROM o WHERE named OR rn <= 100 AND length(code) > 1000""")
def f21_critical_files(spark, sf_dir):
    return stages.critical_files(site(spark, sf_dir), chars=1000).select("file_id", "named")


@query(f"""WITH {_SITE}, r AS (SELECT *, file_id % 5 < 2 OR file_id % 4 IN (0, 2) AS named FROM site), o AS (SELECT *, row_number() OVER (PARTITION BY named ORDER BY path) AS rn FROM r)
    SELECT file_id, path FROM o WHERE named OR rn <= 100 AND length(code) > 10000 ORDER BY named DESC, path LIMIT 50""")
def t5_first_critical(spark, sf_dir):
    return stages.first_critical(site(spark, sf_dir)).select("file_id", "path")


@query(f"WITH {_SITE}, h AS (SELECT * FROM site ORDER BY path LIMIT 100) SELECT file_id, path, md5(substr(code, 1, 200)) AS head_md5 FROM (SELECT * FROM h WHERE contains(path, 'login') ORDER BY path LIMIT 5)")
def t9_context_heads(spark, sf_dir):
    return stages.context_heads(site(spark, sf_dir), "login", chars=200).select("file_id", "path", F.md5(F.col("head").cast("binary")).alias("head_md5"))


@query("""WITH p AS (SELECT page_id, html, string_split(html, '<script') AS parts FROM pages), i AS (SELECT page_id, html, CAST(unnest(range(1, len(parts))) AS INTEGER) AS ord, parts FROM p),
    s AS (SELECT page_id, html, ord, CAST(list_sum(list_transform(parts[1:ord], lambda x: length(x))) + 7 * (ord - 1) + 1 AS INTEGER) AS start FROM i),
    a AS (SELECT page_id, ord, start, substr(html, greatest(1, start - 300), start + 100 - greatest(1, start - 300)) AS wide, lower(substr(html, greatest(1, start - 100), start + 50 - greatest(1, start - 100))) AS near FROM s)
    SELECT page_id, ord, start, regexp_matches(wide, 'track|style') AS is_fp, contains(near, 'var') OR contains(near, 'nav') AS is_safe FROM a""")
def f10_f11_char_windows(spark, sf_dir):
    p = stages.match_starts(read(spark, sf_dir, "pages").select("page_id", "html"), "<script", "html")
    h, s = F.col("html"), F.col("start")
    return p.select("page_id", "ord", "start", stages.ruled_out(h, s, "track|style").alias("is_fp"), stages.has_safe_word(h, s, ["VAR", "nav"]).alias("is_safe"))


@query("""WITH c AS (SELECT user_id AS caller, event_id // 20 AS callee, CAST(event_id % 2 AS INTEGER) AS idx, event_type IN ('view', 'click', 'error') AS literal FROM events), p AS (SELECT DISTINCT user_id AS f, unnest([0, 1]) AS idx FROM events),
    s AS (SELECT callee, idx, bool_and(literal) AS l FROM c WHERE caller <> callee GROUP BY 1, 2) SELECT p.f AS func, p.idx, s.l IS NOT NULL AS called, coalesce(s.l, true) AS is_fp FROM p LEFT JOIN s ON s.callee = p.f AND s.idx = p.idx""")
def f13_literal_parameters(spark, sf_dir):
    e, i = read(spark, sf_dir, "events"), F.col("event_id")
    calls = e.select(F.col("user_id").alias("caller"), F.floor(i / 20).alias("callee"), (i % 2).cast("int").alias("idx"), F.col("event_type").isin("view", "click", "error").alias("literal"))
    params = e.select(F.col("user_id").alias("func")).distinct().select("func", F.explode(F.array(F.lit(0), F.lit(1))).alias("idx"))
    return stages.literal_parameters(params, calls)


@query(f"""WITH {NUMBERED}, a AS (SELECT file_id, line_no, k, CASE k WHEN {INPUT} THEN 'v1' WHEN {STORE} THEN 'v2' WHEN {WRAPPED} THEN 'v3' WHEN 11 THEN 'v1' END AS lhs FROM st), h AS (SELECT file_id, line_no, CASE k WHEN {SINK} THEN 'v1' WHEN 8 THEN 'v2' ELSE 'v3' END AS var FROM st WHERE k IN ({SINK}, 8, 12))
    SELECT h.file_id, h.line_no, h.var, count(a.k) = 0 AS never_assigned, coalesce(bool_or(a.k = {INPUT}), false) AS from_input, coalesce(bool_or(a.k = {STORE}), false) AS from_store, count(a.k) > 0 AND NOT coalesce(bool_or(a.k = {INPUT}), false) AS internal
    FROM h LEFT JOIN a ON a.file_id = h.file_id AND a.lhs = h.var AND a.line_no BETWEEN h.line_no - 99 AND h.line_no - 1 GROUP BY 1, 2, 3""")
def f20_g40_assigned_before(spark, sf_dir):
    lines = statements(spark, sf_dir)
    hits = taint.sink_hits(lines).select("file_id", "line_no", "var").distinct()
    return stages.assigned_before(hits, taint.assigns(lines))


_PARTS = [
    ("routing", "Route::get('/a', 'b'); "), ("admin", "if (is_admin()) {} "), ("ajax", "add_action('wp_ajax_x', 'f'); "), ("auth", "login($u); "), ("file_ops", "fopen($f, 'r'); "), ("dangerous", "eval($c); "), ("db", "mysqli_query($d, $q); "),
    ("upload", "$_FILES['a']; move_uploaded_file($a, $b); "), ("entry_point", "require 'x.php'; "),
]


@query("WITH d AS (SELECT doc_id AS file_id, doc_id * 37 % 512 AS bits FROM documents) SELECT file_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN bits // {1 << i} % 2 = 1 THEN '{r}' END" for i, (r, _) in enumerate(_PARTS)) + "], lambda x: x IS NOT NULL), ',') AS roles FROM d")
def f24_roles(spark, sf_dir):
    bits = F.col("doc_id") * 37 % 512
    code = F.concat(F.lit("<?php "), *[F.when(F.floor(bits / (1 << i)) % 2 == 1, part).otherwise("") for i, (_, part) in enumerate(_PARTS)], F.lit("$_FILES"))
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.array_join(matching.roles(code), ",").alias("roles"))


_DEFS = "d AS (SELECT doc_id AS file_id, CASE doc_id % 4 WHEN 0 THEN 'sanitize_x' WHEN 1 THEN 'load' WHEN 2 THEN 'my_clean' ELSE 'escapeHtml' END AS n, doc_id % 3 = 0 AS two FROM documents)"


@query(f"WITH {_DEFS} SELECT file_id, array_to_string(list_sort(list_concat(CASE WHEN n <> 'load' THEN [n] ELSE [] END, CASE WHEN two THEN ['validateAll'] ELSE [] END)), ',') AS sanitizers, file_id % 4 = 2 OR two AND file_id % 5 = 0 AS wrapped FROM d")
def c6_c7_sanitizer_definitions(spark, sf_dir):
    i = F.col("doc_id")
    name = F.when(i % 4 == 0, "sanitize_x").when(i % 4 == 1, "load").when(i % 4 == 2, "my_clean").otherwise("escapeHtml")
    code = F.concat(F.lit("function "), name, F.lit("($a) { } "), F.when(i % 3 == 0, "function validateAll() {}").otherwise(""))
    line = F.concat(F.lit("$a = my_clean($b); load($c); "), F.when(i % 5 == 0, "validateall ($d);").otherwise(""))
    d = read(spark, sf_dir, "documents").select(i.alias("file_id"), stages.sanitizer_definitions(code).alias("names"), line.alias("line"))
    return d.select("file_id", F.array_join("names", ",").alias("sanitizers"), stages.wrapped(F.col("line"), F.col("names")).alias("wrapped"))


@query(f"WITH {NUMBERED} SELECT count(DISTINCT file_id) AS files, count_if(k = {LITERAL[0]}) AS includes, count(DISTINCT CASE WHEN k = {GLOBAL} THEN file_id END) AS files_with_globals, count_if(k = {NAMESPACE}) AS namespaces FROM st")
def a16_project_stats(spark, sf_dir):
    return stages.project_stats(statements(spark, sf_dir))


@query(f"WITH {NUMBERED} SELECT file_id, CAST(count_if(k = {ADMIN}) AS INTEGER) AS branches, CAST(count_if(k = {LOOP}) AS INTEGER) AS loops, CAST(least(50, 1 + count_if(k IN ({ADMIN}, {LOOP}))) AS INTEGER) AS complexity FROM st GROUP BY 1")
def a23_counts(spark, sf_dir):
    c = classify.counts(F.col("code"))
    return site(spark, sf_dir).select("file_id", *[c[n].alias(n) for n in ("branches", "loops", "complexity")])


@query(f"WITH {LINES} SELECT file_id, line_no AS line, substr(text, 2, 2) AS var, CAST(row_number() OVER (PARTITION BY file_id, substr(text, 1, 3) ORDER BY line_no) - 1 AS INTEGER) AS version FROM lines WHERE starts_with(text, '$')")
def w31_versions(spark, sf_dir):
    """Of straight code, versions are numbers of assignments; tests have branches."""
    v = programs.versions(whole_files(event_lines(spark, sf_dir))).where("NOT is_phi")
    return v.select("file_id", (F.col("line") - 1).alias("line"), "var", "version")


@query("""WITH f AS (SELECT '/src/' || source || '/' || lang || '/' || doc_id || '.php' AS path, doc_id, lang FROM documents), r AS (SELECT path AS src, '../' || CASE doc_id % 3 WHEN 0 THEN doc_id // 2 || '.php' WHEN 1 THEN lang || '/' || doc_id // 2 || '.php' ELSE 'none/x.php' END AS ref FROM f)
    SELECT r.src, r.ref, min(f.path) AS dst FROM r LEFT JOIN f ON ends_with(f.path, substr(r.ref, 3)) GROUP BY 1, 2""")
def j13_g39_include_chains(spark, sf_dir):
    d, i = doc_files(spark, sf_dir).join(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), "lang"), "file_id"), F.col("file_id")
    half = F.floor(i / 2).cast("string")
    ref = F.when(i % 3 == 0, F.concat(half, F.lit(".php"))).when(i % 3 == 1, F.concat("lang", F.lit("/"), half, F.lit(".php"))).otherwise(F.lit("none/x.php"))
    return stages.include_chains(d.select(F.col("path").alias("src"), F.concat(F.lit("../"), ref).alias("ref")), d.select("path"))


@query(f"WITH {FILES} SELECT file_id, list_aggregate(list_transform(string_split(substr(code, 1, 60), ''), lambda c: CASE WHEN contains('\\.^$|?*+()[]{{}}-', c) THEN '\\' || c ELSE c END), 'string_agg', '') AS pattern FROM files")
def fn_regex_escape(spark, sf_dir):
    return doc_files(spark, sf_dir).select("file_id", stages.escaped(F.substring("code", 1, 60)).alias("pattern"))


@query("""WITH g AS (SELECT event_id AS seq, event_id % 101 / 100e0 AS c, CASE event_id % 4 WHEN 0 THEN 'CODE_INJECTION' WHEN 1 THEN 'XSS' WHEN 2 THEN 'FILE_INCLUSION' ELSE 'SSRF' END AS vt, event_id % 2 = 0 AS a, event_id % 3 = 0 AS b, event_id % 5 = 0 AS v, event_id % 7 = 0 AS t, event_id % 9 AS n FROM events)
    SELECT seq, CASE WHEN vt IN ('CODE_INJECTION', 'FILE_INCLUSION') AND c >= 8e-1 THEN 'CRITICAL' ELSE 'HIGH' END AS severity,
      round(least(1e0, greatest(1e-1, 7e-1 + CASE WHEN a THEN 2e-1 ELSE 0e0 END - CASE WHEN b THEN 5e-2 ELSE 0e0 END - CASE WHEN v THEN 15e-2 ELSE 0e0 END - CASE WHEN t THEN 5e-2 ELSE 0e0 END - n * 1e-1)), 9) AS confidence FROM g""")
def p8_c19_scores(spark, sf_dir):
    from ..functions import score as S

    i = F.col("event_id")
    vt = F.when(i % 4 == 0, "CODE_INJECTION").when(i % 4 == 1, "XSS").when(i % 4 == 2, "FILE_INCLUSION").otherwise("SSRF")
    c = S.additive(i % 2 == 0, i % 3 == 0, i % 5 == 0, i % 7 == 0, i % 9)
    return read(spark, sf_dir, "events").select(i.alias("seq"), S.program_severity(vt, i % 101 / F.lit(100.0)).alias("severity"), F.round(c, 9).alias("confidence"))


@query("""WITH s AS (SELECT event_id AS seq, event_id % 101 / 100e0 AS score, CASE event_id % 3 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' ELSE 'LOW' END AS severity, CASE event_id % 4 WHEN 0 THEN 'RCE' ELSE 'XSS' END AS vt, event_id % 5 = 0 AS safe FROM events)
    SELECT seq, CASE WHEN score < 3e-1 THEN 'SAFE' WHEN score <= 55e-2 THEN 'SUSPICIOUS' ELSE 'VULNERABLE' END AS ml_class, CASE WHEN score >= 3e-1 AND score <= 55e-2 THEN CASE severity WHEN 'CRITICAL' THEN 'HIGH' WHEN 'HIGH' THEN 'MEDIUM' ELSE severity END ELSE severity END AS ml_severity
    FROM s WHERE score > 45e-2 OR vt = 'RCE' AND NOT safe""")
def m9_annotated(spark, sf_dir):
    i = F.col("event_id")
    s = read(spark, sf_dir, "events").select(
        i.alias("seq"), (i % 101 / F.lit(100.0)).alias("score"), F.when(i % 3 == 0, "CRITICAL").when(i % 3 == 1, "HIGH").otherwise("LOW").alias("severity"), F.when(i % 4 == 0, "RCE").otherwise("XSS").alias("vuln_type"),
        F.when(i % 5 == 0, "basename($f)").otherwise("x").alias("code"), F.lit(0.5).alias("certainty"), F.lit("").alias("reasons"),
    ).withColumn("is_tp", F.col("score") > 0.45)
    return classify.annotated(s).select("seq", "ml_class", "ml_severity")


@query("SELECT event_id AS seq, CASE event_id % 3 WHEN 2 THEN NULL ELSE event_id % 2 = 0 END AS is_real FROM events")
def fn_fenced_json(spark, sf_dir):
    from ..operators import reports

    i = F.col("event_id")
    answer = F.concat(F.lit('{"is_real": '), (i % 2 == 0).cast("string"), F.lit("}"))
    text = F.when(i % 3 == 0, F.concat(F.lit("Sure:\n```json\n"), answer, F.lit("\n```\nfurther {text}"))).when(i % 3 == 1, F.concat(F.lit("I say "), answer, F.lit("."))).otherwise("none")
    return read(spark, sf_dir, "events").select(i.alias("seq"), reports.fenced_json(text, "is_real boolean")["is_real"].alias("is_real"))
