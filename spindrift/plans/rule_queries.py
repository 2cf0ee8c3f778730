"""Queries on rules: matching, false-positive chains, roles, frameworks, features, the heuristic classifier."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import lines as L
from ..operators import classify, matching
from ..registry import query
from ..sources.catalog import rows
from ..sources.corpus import FILES, LINES, doc_files, event_lines, read
from .line_queries import ASSIGNS, SINKS

#: Rules for markup and prose, with ASCII boundaries, that all engines read alike.
MARKUP = [
    {"vuln_type": "XSS", "severity": "HIGH", "regex": "<script"},
    {"vuln_type": "OPEN_REDIRECT", "severity": "MEDIUM", "regex": 'href="/[a-z]+'},
    {"vuln_type": "INFO_DISCLOSURE", "severity": "LOW", "regex": "<!-- [a-z]+"},
    {"vuln_type": "CLICKJACKING", "severity": "LOW", "regex": 'class="ad"'},
    {"vuln_type": "CSRF", "severity": "LOW", "regex": "<form"},
]
_MARKUP = " UNION ALL ".join(f"SELECT {i} AS rule, '{r['vuln_type']}' AS vuln_type, '{r['severity']}' AS severity, '(?i){r['regex']}' AS regex" for i, r in enumerate(MARKUP))


@query(f"WITH r AS ({_MARKUP}) SELECT p.page_id, r.rule, r.vuln_type, r.severity, CAST(len(regexp_extract_all(p.html, r.regex)) AS INTEGER) AS n FROM pages p CROSS JOIN r WHERE regexp_matches(p.html, r.regex)")
def j1_c16_rules_on_pages(spark, sf_dir):
    return matching.hits(read(spark, sf_dir, "pages").select("page_id", "html"), MARKUP, "html").drop("html")


_PHP = rows("patterns")  # with ASCII boundaries and no look-around, so that all engines read them alike
_sql = lambda s: s.replace("'", "''")
_PHP_SQL = " UNION ALL ".join(f"SELECT {i} AS rule, '{r['vuln_type']}' AS vuln_type, '{r['severity']}' AS severity, '(?i){_sql(r['regex'])}' AS regex" for i, r in enumerate(_PHP))


@query(f"WITH {LINES}, r AS ({_PHP_SQL}) SELECT l.file_id, l.line_no, l.seq, r.rule, r.vuln_type, r.severity, CAST(len(regexp_extract_all(l.text, r.regex)) AS INTEGER) AS n FROM lines l CROSS JOIN r WHERE regexp_matches(l.text, r.regex)")
def c2_c17_rules_on_lines(spark, sf_dir):
    return matching.hits(event_lines(spark, sf_dir), _PHP).drop("text")


_FP_TYPES = "CASE seq % 4 WHEN 0 THEN 'XSS' WHEN 1 THEN 'SQL_INJECTION' WHEN 2 THEN 'AUTH_BYPASS' ELSE 'SSRF' END"
_FP = rows("fp_rules")
_FP_SQL = "coalesce(" + ", ".join(f"CASE WHEN regexp_matches(text, '(?i){_sql(r['regex'])}')" + (f" AND vt IN ({', '.join(repr(t) for t in r['applies_to'])})" if r["applies_to"] else "") + f" THEN '{r['category']}' END" for r in _FP) + ")"


def _typed(spark, sf_dir):
    vt = F.when(F.col("seq") % 4 == 0, "XSS").when(F.col("seq") % 4 == 1, "SQL_INJECTION").when(F.col("seq") % 4 == 2, "AUTH_BYPASS").otherwise("SSRF")
    text = F.when(F.col("seq") % 9 == 0, F.concat(F.lit("// "), F.col("text"))).when(F.col("seq") % 7 == 0, F.concat(F.lit("$q->prepare("), F.col("text"))).otherwise(F.col("text"))
    return event_lines(spark, sf_dir).withColumn("text", text).withColumn("vt", vt)


_TYPED = f"typed AS (SELECT file_id, line_no, seq, {_FP_TYPES} AS vt, CASE WHEN seq % 9 = 0 THEN '// ' || text WHEN seq % 7 = 0 THEN '$q->prepare(' || text ELSE text END AS text FROM lines)"


@query(f"WITH {LINES}, {_TYPED} SELECT file_id, line_no, seq, {_FP_SQL} AS reason FROM typed")
def f3_f14_fp_reason(spark, sf_dir):
    return _typed(spark, sf_dir).select("file_id", "line_no", "seq", matching.fp_reason(F.col("text"), F.col("vt"), _FP).alias("reason"))


@query(f"WITH {LINES}, {_TYPED} SELECT coalesce({_FP_SQL}, 'kept') AS reason, count(*) AS n FROM typed GROUP BY 1")
def a19_fp_histogram(spark, sf_dir):
    t = _typed(spark, sf_dir)
    return t.groupBy(F.coalesce(matching.fp_reason(F.col("text"), F.col("vt"), _FP), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"""WITH {LINES}, w AS (SELECT *, coalesce(max(CASE WHEN contains(text, 'intval(') THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN 9 PRECEDING AND 5 FOLLOWING), 0) = 1 AS numeric,
    coalesce(max(CASE WHEN contains(text, 'WHERE') THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 0) = 1 AS sql_near FROM lines)
    SELECT file_id, line_no, CASE WHEN numeric AND contains(text, 'mysql_query') THEN 'numeric' WHEN NOT sql_near AND contains(text, 'mysql_query') THEN 'no_sql' WHEN length(text) < 10 THEN 'short' END AS reason, sql_near FROM w""")
def f4_f7_f16_safe_context(spark, sf_dir):
    t = F.col("text")
    w = event_lines(spark, sf_dir).select("file_id", "line_no", "text", L.seen(F.contains(t, F.lit("intval(")), "safe_context").alias("numeric"), L.seen(F.contains(t, F.lit("WHERE")), "sql_nearby").alias("sql_near"))
    sink = F.contains(t, F.lit("mysql_query"))
    reason = matching.first_reason([("numeric", F.col("numeric") & sink), ("no_sql", ~F.col("sql_near") & sink), ("short", F.length(t) < 10)])
    return w.select("file_id", "line_no", reason.alias("reason"), "sql_near")


_FW = [{"name": "alpha", "detect": ["the ", "and "]}, {"name": "beta", "detect": ["der ", "und ", "die "]}, {"name": "gamma", "detect": ["que ", "los "]}]
_VOTE = ", ".join(f"({' + '.join(f'''CAST(contains(code, '{d}') AS INT)''' for d in r['detect'])}) AS {r['name']}" for r in _FW)


@query(f"""WITH {FILES}, v AS (SELECT file_id, {_VOTE} FROM files) SELECT file_id, CASE WHEN greatest(alpha, beta, gamma) = 0 THEN NULL WHEN alpha >= beta AND alpha >= gamma THEN 'alpha' WHEN beta >= gamma THEN 'beta' ELSE 'gamma' END AS voted,
    CASE WHEN alpha > 0 THEN 'alpha' WHEN beta > 0 THEN 'beta' WHEN gamma > 0 THEN 'gamma' END AS first_ FROM v""")
def a13_c8_frameworks(spark, sf_dir):
    c = F.col("code")
    return doc_files(spark, sf_dir).select("file_id", matching.framework_votes(c, _FW)["name"].alias("voted"), matching.frameworks(c, _FW).alias("first_"))


_M2 = """f AS (SELECT event_id AS seq, CASE event_id % 3 WHEN 0 THEN 'SQL_INJECTION' WHEN 1 THEN 'XSS' ELSE 'SSRF' END AS vuln_type, event_id % 10 / 1e1 AS source_risk, event_id % 7 / 7e0 AS sink_danger, event_id % 2 AS sanitizer_type_match, event_id % 3 % 2 AS sanitizer_present, event_id % 5 % 2 AS prepared_stmt, event_id % 4 / 4 AS direct_source FROM events)"""


@query(f"""WITH {_M2.replace("event_id % 4 / 4", "CAST(event_id % 4 = 0 AS INTEGER)")}, s AS (SELECT seq, greatest(0e0, least(1e0, CASE vuln_type WHEN 'XSS' THEN 4e-1 ELSE 45e-2 END + source_risk * 25e-2 + sink_danger * 2e-1 + CAST(sanitizer_type_match AS DOUBLE) * -55e-2
      + CASE WHEN vuln_type = 'SQL_INJECTION' THEN CAST(prepared_stmt AS DOUBLE) ELSE 0e0 END * -3e-1 + CASE WHEN sanitizer_type_match > 0 THEN 0e0 ELSE CAST(sanitizer_present AS DOUBLE) END * -1e-1 + CAST(direct_source AS DOUBLE) * 1e-1)) AS score FROM f)
    SELECT seq, round(score, 9) AS score, score > 45e-2 AS is_tp, round(least(1e0, abs(score - 45e-2) * 2), 9) AS certainty FROM s""")
def m2_heuristic(spark, sf_dir):
    i = F.col("event_id")
    f = read(spark, sf_dir, "events").select(
        i.alias("seq"), F.when(i % 3 == 0, "SQL_INJECTION").when(i % 3 == 1, "XSS").otherwise("SSRF").alias("vuln_type"), (i % 10 / F.lit(10.0)).alias("source_risk"), (i % 7 / F.lit(7.0)).alias("sink_danger"),
        (i % 2).alias("sanitizer_type_match"), (i % 3 % 2).alias("sanitizer_present"), (i % 5 % 2).alias("prepared_stmt_nearby"), (i % 4 == 0).cast("int").alias("has_direct_source"),
    )
    return classify.heuristic(f).select("seq", F.round("score", 9).alias("score"), "is_tp", F.round("certainty", 9).alias("certainty"))


@query(f"""WITH {LINES}, r AS (SELECT *, nullif(regexp_extract(text, '^\\$(\\w+) = \\$_GET', 1), '') AS var FROM lines),
    w AS (SELECT file_id, line_no, last_value(var IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS latest_source FROM r) SELECT file_id, line_no, latest_source FROM w""")
def w28_latest_source(spark, sf_dir):
    w = Window.partitionBy("file_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    var = F.nullif(F.regexp_extract("text", r"^\$(\w+) = \$_GET", 1), F.lit(""))
    return event_lines(spark, sf_dir).select("file_id", "line_no", F.last(var, ignorenulls=True).over(w).alias("latest_source"))
