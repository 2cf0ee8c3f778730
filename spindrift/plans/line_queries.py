"""Queries on lines: windows, comment and brace state, taint, flows, scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lines as L
from ..functions import score as S
from ..functions import text as T
from ..operators import taint
from ..operators.graphs import cut
from ..registry import query
from ..sources.corpus import FILES, LINES, doc_files, event_lines, first_files, namespace_head, without_vendor

ASSIGNS = LINES + r""", assigns AS (SELECT * FROM (SELECT file_id, line_no, seq, regexp_extract(text, '^\s*\$(\w+)\s*=\s*(.+?)\s*;', 1) AS lhs, regexp_extract(text, '^\s*\$(\w+)\s*=\s*(.+?)\s*;', 2) AS rhs,
    nullif(regexp_extract(text, '\$_(GET|POST|REQUEST|COOKIE)', 1), '') AS source, nullif(lower(regexp_extract(text, '=\s*(\w+)\s*\(', 1)), '') AS func FROM lines) WHERE lhs <> '')"""
SINKS = r"""sinks AS (SELECT file_id, line_no, seq, text, regexp_extract(text, '\$(\w+)\)?;$', 1) AS var, CASE WHEN text LIKE 'mysql_query%' THEN 'SQL_INJECTION' ELSE 'XSS' END AS vuln_type,
    CASE WHEN text LIKE 'mysql_query%' THEN 'CRITICAL' ELSE 'HIGH' END AS severity FROM lines WHERE text LIKE 'mysql_query%' OR text LIKE 'echo %')"""
TAINT = r"""steps AS (SELECT file_id, line_no, lhs, regexp_extract(rhs, '\$(\w+)', 1) AS rhs_var FROM assigns WHERE source IS NULL AND func IS NULL),
t0 AS (SELECT file_id, lhs AS var, arg_min(source, line_no) AS origin, min(line_no) AS line_no, 0 AS hops FROM assigns WHERE source IS NOT NULL GROUP BY 1, 2),
t1 AS (SELECT s.file_id, s.lhs AS var, arg_min(t.origin, s.line_no) AS origin, min(s.line_no) AS line_no, 1 AS hops FROM steps s JOIN t0 t ON s.file_id = t.file_id AND s.rhs_var = t.var AND s.line_no >= t.line_no
       WHERE (s.file_id, s.lhs) NOT IN (SELECT (file_id, var) FROM t0) GROUP BY 1, 2),
t2 AS (SELECT s.file_id, s.lhs AS var, arg_min(t.origin, s.line_no) AS origin, min(s.line_no) AS line_no, 2 AS hops FROM steps s JOIN t1 t ON s.file_id = t.file_id AND s.rhs_var = t.var AND s.line_no >= t.line_no
       WHERE (s.file_id, s.lhs) NOT IN (SELECT (file_id, var) FROM t0 UNION ALL SELECT (file_id, var) FROM t1) GROUP BY 1, 2),
t3 AS (SELECT s.file_id, s.lhs AS var, arg_min(t.origin, s.line_no) AS origin, min(s.line_no) AS line_no, 3 AS hops FROM steps s JOIN t2 t ON s.file_id = t.file_id AND s.rhs_var = t.var AND s.line_no >= t.line_no
       WHERE (s.file_id, s.lhs) NOT IN (SELECT (file_id, var) FROM t0 UNION ALL SELECT (file_id, var) FROM t1 UNION ALL SELECT (file_id, var) FROM t2) GROUP BY 1, 2),
tainted AS (SELECT * FROM t0 UNION ALL SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3),
latest AS (SELECT s.file_id, s.line_no, s.var, max(a.line_no) AS assigned_at, coalesce(arg_max(coalesce(a.func = 'intval', false), a.line_no), false) AS clean, coalesce(arg_max(a.source IS NOT NULL, a.line_no), false) AS dirty
         FROM sinks s LEFT JOIN assigns a ON a.file_id = s.file_id AND a.lhs = s.var AND a.line_no < s.line_no GROUP BY 1, 2, 3),
near_san AS (SELECT file_id, line_no, coalesce(max(CASE WHEN text LIKE '%intval(%' THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) = 1 AS san FROM lines),
flows AS (SELECT s.*, t.line_no AS source_line, t.origin, t.hops, coalesce(c.clean, false) AS clean, n.san FROM sinks s JOIN tainted t ON s.file_id = t.file_id AND s.var = t.var AND s.line_no > t.line_no
          JOIN latest c ON c.file_id = s.file_id AND c.line_no = s.line_no AND c.var = s.var JOIN near_san n ON n.file_id = s.file_id AND n.line_no = s.line_no),
scored AS (SELECT *, greatest(0e0, least(1e0, 85e-2 + 15e-2 - CASE WHEN san THEN 35e-2 ELSE 0e0 END - 0e0 + CASE WHEN clean THEN -4e-1 ELSE 1e-1 END + CASE WHEN NOT clean AND hops <= 2 THEN 5e-2 ELSE 0e0 END
          - 0e0 - 0e0 - 0e0 + CASE WHEN NOT clean THEN 1e-1 ELSE 0e0 END)) AS confidence FROM flows),
findings AS (SELECT file_id, line_no, seq, var, vuln_type, source_line, origin, hops, san, clean, confidence,
          CASE WHEN confidence < 75e-2 THEN 'MEDIUM' WHEN confidence < 9e-1 THEN 'HIGH' WHEN severity = 'CRITICAL' THEN 'CRITICAL' ELSE 'HIGH' END AS severity
          FROM scored WHERE confidence >= CASE WHEN false THEN 4e-1 ELSE 6e-1 END)"""
FINDINGS = f"WITH {ASSIGNS}, {SINKS}, {TAINT}"


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored flows of the event corpus: the engine's findings, as the later queries take them."""
    lines = event_lines(spark, sf_dir)
    a, s = cut(taint.assigns(lines)), taint.sink_hits(lines)
    near = lines.select("file_id", "line_no", L.seen(F.col("text").contains("intval("), "sanitizer").alias("san"))
    asof = taint.sanitized_before(s, a).select("file_id", "line_no", "var", "clean")
    f = taint.flows(taint.closure(a), s).join(near, ["file_id", "line_no"]).join(asof, ["file_id", "line_no", "var"])
    sans = F.when(F.col("san"), F.array(F.lit("intval"))).otherwise(F.array().cast("array<string>"))
    no, yes = F.lit(False), F.lit(True)
    f = f.withColumn("confidence", S.confidence(F.array("origin"), sans, yes, F.col("clean"), F.col("hops"), no, no, no, F.col("vuln_type")))
    f = f.where(F.col("confidence") >= S.least_confidence(sans, no)).withColumn("severity", S.severity(F.col("confidence"), F.col("severity")))
    return f.select("file_id", "line_no", "seq", "var", "vuln_type", "source_line", "origin", "hops", "san", "clean", "confidence", "severity")


def _window_query(number: int, name: str) -> None:
    a, b = L.FRAMES[name]
    bound = lambda x: "CURRENT ROW" if x == 0 else f"{abs(x)} {'PRECEDING' if x < 0 else 'FOLLOWING'}"

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines = event_lines(spark, sf_dir)
        return lines.select("file_id", "line_no", F.md5(L.context(name).cast("binary")).alias("context_md5"), L.seen(F.col("text").contains("$_GET"), name).alias("has_source"))

    run.__name__ = f"w{number}_{name}"
    w = f"OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN {bound(a)} AND {bound(b)})"
    query(f"""WITH {LINES} SELECT file_id, line_no, md5(coalesce(string_agg(text, chr(10)) {w}, '')) AS context_md5,
        coalesce(max(CASE WHEN contains(text, '$_GET') THEN 1 ELSE 0 END) {w}, 0) = 1 AS has_source FROM lines""")(run)


for _i, _name in enumerate(L.FRAMES, 1):
    _window_query(_i, _name)


@query(f"WITH {LINES} SELECT file_id, line_no, seq, text FROM lines")
def s1_event_corpus(spark, sf_dir):
    return event_lines(spark, sf_dir)


@query(f"WITH {FILES} SELECT file_id, path, length(code) AS n_chars FROM files WHERE NOT list_has_any(list_transform(string_split(path, '/'), lambda x: lower(x)), ['src3', 'src7', 'vendor'])")
def s4_vendor_pruning(spark, sf_dir):
    return without_vendor(doc_files(spark, sf_dir), ["src3", "src7", "vendor"]).select("file_id", "path", F.length("code").cast("long").alias("n_chars"))


@query(f"WITH {FILES} SELECT file_id, path FROM files ORDER BY path LIMIT 25")
def s6_first_files(spark, sf_dir):
    return first_files(doc_files(spark, sf_dir), 25).select("file_id", "path")


@query(f"WITH {FILES} SELECT file_id, sha256(substr(code, 1, 640)) AS head_sha FROM files")
def s14_namespace_head(spark, sf_dir):
    return namespace_head(doc_files(spark, sf_dir), 640).select("file_id", F.sha2(F.col("code").cast("binary"), 256).alias("head_sha"))


@query(f"WITH {FILES} SELECT file_id, CAST(i AS INTEGER) AS line_no, sha256(l[i]) AS line_sha FROM (SELECT file_id, string_split(code, chr(10)) AS l, unnest(range(1, len(string_split(code, chr(10))) + 1)) AS i FROM files)")
def p0_explode_lines(spark, sf_dir):
    return L.explode_lines(doc_files(spark, sf_dir)).select("file_id", "line_no", F.sha2(F.col("text").cast("binary"), 256).alias("line_sha"))


@query(f"""WITH {FILES}, l AS (SELECT file_id, unnest(string_split(code, chr(10))) AS text, generate_subscripts(string_split(code, chr(10)), 1) AS line_no FROM files),
    c AS (SELECT file_id, line_no, len(string_split(text, 'th')) - 1 AS n FROM l), o AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c WHERE n > 0)
    SELECT file_id, CAST(before + unnest(range(1, n + 1)) AS INTEGER) AS ord, CAST(line_no AS INTEGER) AS line_no FROM o""")
def p1_match_lines(spark, sf_dir):
    return L.match_lines(doc_files(spark, sf_dir), "th")


@query(f"WITH {FILES} SELECT file_id, substr(regexp_replace(code, '^\\s+|\\s+$', '', 'g'), 1, 100) AS preview, upper(replace(path, ' ', '_')) AS rule_id, array_to_string(string_split(replace(path, '/', '_'), '_')[1:2], '_') AS kind FROM files")
def p2_p4_p5_text(spark, sf_dir):
    f = doc_files(spark, sf_dir)
    return f.select("file_id", T.preview(F.col("code")).alias("preview"), T.rule_id(F.col("path")).alias("rule_id"), T.type_of_pattern(F.replace("path", F.lit("/"), F.lit("_"))).alias("kind"))


@query(f"WITH {LINES} SELECT seq, translate(text, '\" ', '''') AS variable, regexp_extract(text, '\\[\\s*[''\"]?(\\w+)[''\"]?\\s*\\]', 1) AS key FROM lines")
def p9_p10_variables(spark, sf_dir):
    return event_lines(spark, sf_dir).select("seq", T.normal_variable(F.col("text")).alias("variable"), T.array_key(F.col("text")).alias("key"))


_CHAT = """chat AS (SELECT conv_id AS file_id, CAST(turn AS INTEGER) AS line_no, CASE role WHEN 'user' THEN '{' || CASE WHEN turn % 4 = 0 THEN ' /* open' ELSE '' END ELSE '}' || CASE WHEN length(text) % 3 = 0 THEN ' */' ELSE '' END END
    || CASE WHEN length(text) % 5 = 0 THEN ' <?php' WHEN length(text) % 7 = 0 THEN ' ?>' ELSE '' END AS text FROM conversations)"""


def _chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    n = F.length("text")
    head = F.when(F.col("role") == "user", F.concat(F.lit("{"), F.when(F.col("turn") % 4 == 0, " /* open").otherwise(""))).otherwise(F.concat(F.lit("}"), F.when(n % 3 == 0, " */").otherwise("")))
    tail = F.when(n % 5 == 0, " <?php").when(n % 7 == 0, " ?>").otherwise("")
    return c.select(F.col("conv_id").alias("file_id"), F.col("turn").cast("int").alias("line_no"), F.concat(head, tail).alias("text"))


@query(f"""WITH {_CHAT}, m AS (SELECT *, CASE WHEN contains(text, '*/') THEN 0 WHEN contains(text, '/*') THEN 1 END AS mark FROM chat)
    SELECT file_id, line_no, starts_with(trim(text), '//') OR starts_with(trim(text), '#') OR starts_with(trim(text), '*')
      OR coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS in_comment FROM m""")
def f2_w26_comment_state(spark, sf_dir):
    return _chat(spark, sf_dir).select("file_id", "line_no", L.in_comment().alias("in_comment"))


@query(f"""WITH {_CHAT} SELECT file_id, line_no, CAST(greatest(0, sum(length(text) - length(replace(text, '{{', '')) - (length(text) - length(replace(text, '}}', '')))) OVER (PARTITION BY file_id ORDER BY line_no)) AS BIGINT) AS depth FROM chat""")
def w25_brace_depth(spark, sf_dir):
    return _chat(spark, sf_dir).select("file_id", "line_no", L.brace_depth().alias("depth"))


@query(f"""WITH {_CHAT}, s AS (SELECT file_id, line_no, (length(text) - length(replace(text, '<?php', ''))) / 5 AS o, (length(text) - length(replace(text, '?>', ''))) / 2 AS c FROM chat)
    SELECT file_id, line_no, coalesce(last_value(CASE WHEN o <> c THEN CAST(o > c AS INTEGER) END IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) = 0 AS in_html FROM s""")
def f25_inside_html(spark, sf_dir):
    return _chat(spark, sf_dir).select("file_id", "line_no", L.in_html().alias("in_html"))


_FUNCS = """fn AS (SELECT file_id, line_no, CASE WHEN line_no % 4 = 1 THEN 'function f' || line_no || '() {' WHEN line_no % 4 = 0 THEN '}' WHEN seq % 3 = 0 THEN 'if (x) { y; }' ELSE text END AS text FROM lines)"""


@query(f"""WITH {LINES}, {_FUNCS}, d AS (SELECT file_id, line_no, text, greatest(0, sum(length(text) - length(replace(text, '{{', '')) - (length(text) - length(replace(text, '}}', '')))) OVER (PARTITION BY file_id ORDER BY line_no)) AS depth FROM fn),
    b AS (SELECT *, coalesce(lag(depth) OVER (PARTITION BY file_id ORDER BY line_no), 0) AS before FROM d)
    SELECT s.file_id, regexp_extract(s.text, 'function\\s+(\\w+)', 1) AS name, s.line_no AS start_line, (SELECT min(e.line_no) FROM b e WHERE e.file_id = s.file_id AND e.line_no >= s.line_no AND contains(e.text, '}}') AND e.depth <= s.before) AS end_line
    FROM b s WHERE s.text LIKE 'function %'""")
def p11_w28_function_extents(spark, sf_dir):
    n = F.col("line_no")
    text = F.when(n % 4 == 1, F.concat(F.lit("function f"), n.cast("string"), F.lit("() {"))).when(n % 4 == 0, "}").when(F.col("seq") % 3 == 0, "if (x) { y; }").otherwise(F.col("text"))
    return L.function_extents(event_lines(spark, sf_dir).withColumn("text", text)).select("file_id", "name", "start_line", "end_line")


@query(f"WITH {ASSIGNS} SELECT file_id, line_no, seq, lhs, rhs, source, func FROM assigns")
def g17_assignments(spark, sf_dir):
    return taint.assigns(event_lines(spark, sf_dir)).select("file_id", "line_no", "seq", "lhs", "rhs", "source", "func")


@query(f"WITH {LINES}, {SINKS} SELECT file_id, line_no, seq, var, vuln_type, severity FROM sinks")
def g17_sink_hits(spark, sf_dir):
    return taint.sink_hits(event_lines(spark, sf_dir)).drop("text")


@query(f"{FINDINGS} SELECT file_id, var, origin, line_no, hops FROM tainted")
def g1_taint_closure(spark, sf_dir):
    return taint.closure(taint.assigns(event_lines(spark, sf_dir))).select("file_id", "var", "origin", "line_no", "hops")


@query(f"{FINDINGS} SELECT file_id, line_no, seq, var, vuln_type, severity, source_line, origin, hops FROM flows")
def j5_flows(spark, sf_dir):
    lines = event_lines(spark, sf_dir)
    return taint.flows(taint.closure(taint.assigns(lines)), taint.sink_hits(lines)).drop("text")


@query(f"{FINDINGS} SELECT file_id, line_no, var, assigned_at, clean, dirty FROM latest")
def j9_sanitized_as_of(spark, sf_dir):
    lines = event_lines(spark, sf_dir)
    return taint.sanitized_before(taint.sink_hits(lines), taint.assigns(lines))


@query(f"""WITH {ASSIGNS}, {SINKS} SELECT s.file_id, a.line_no AS source_line, s.var, s.vuln_type, min(s.line_no) AS line_no, max(s.severity) AS severity FROM sinks s JOIN assigns a ON a.file_id = s.file_id AND a.lhs = s.var
    AND a.source IS NOT NULL AND s.line_no > a.line_no AND s.line_no <= a.line_no + 14 GROUP BY 1, 2, 3, 4""")
def c12_multiline(spark, sf_dir):
    return taint.multiline(event_lines(spark, sf_dir))


@query(f"{FINDINGS} SELECT file_id, line_no, seq, var, vuln_type, source_line, origin, hops, san, clean, confidence, severity FROM findings")
def c1_findings(spark, sf_dir):
    return findings(spark, sf_dir)


_BACK_STEPS = "".join(
    f""", h{d} AS (SELECT DISTINCT k.file_id, k.line_no, a.line_no AS l, a.source IS NOT NULL AS src, a.func = 'intval' AS san, a.rhs FROM k{d - 1} k JOIN assigns a ON a.file_id = k.file_id AND a.lhs = k.tracked AND a.line_no < k.line_no AND a.line_no >= k.line_no - {10 * d}),
    k{d} AS (SELECT * FROM k{d - 1} UNION SELECT file_id, line_no, regexp_extract(rhs, '\\$([a-zA-Z]\\w*)', 1) FROM h{d} WHERE regexp_extract(rhs, '\\$([a-zA-Z]\\w*)', 1) <> '')"""
    for d in range(1, 7)
)


@query(f"""WITH {ASSIGNS}, {SINKS}, k0 AS (SELECT DISTINCT file_id, line_no, var AS tracked FROM sinks){_BACK_STEPS},
    met AS ({' UNION ALL '.join(f'SELECT file_id, line_no, src, san, {d + 1} AS depth FROM h{d}' for d in range(1, 7))}),
    s AS (SELECT file_id, line_no, bool_or(src) AS tainted, coalesce(bool_or(san), false) AS sanitized, coalesce(min(CASE WHEN src THEN depth END), 0) AS hops FROM met GROUP BY 1, 2)
    SELECT k.file_id, k.line_no, coalesce(s.tainted, false) AS tainted, coalesce(s.sanitized, false) AS sanitized, CAST(coalesce(s.hops, 0) AS INTEGER) AS hops FROM (SELECT DISTINCT file_id, line_no FROM sinks) k LEFT JOIN s USING (file_id, line_no)""")
def c9_backward_tracking(spark, sf_dir):
    lines = event_lines(spark, sf_dir)
    return taint.backward(taint.sink_hits(lines), taint.assigns(lines))


_GRID = """g AS (SELECT event_id AS seq, event_id % 101 / 100e0 AS c, CASE event_id % 3 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' ELSE 'MEDIUM' END AS base, CASE event_id % 4 WHEN 0 THEN 'RCE' WHEN 1 THEN 'UNSAFE_UPLOAD' WHEN 2 THEN 'XSS' ELSE 'WEAK_CRYPTO' END AS vt, event_id % 2 = 0 AS admin,
    event_id % 7 AS k7, event_id % 5 AS k5 FROM events)"""


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_id")
    return e.select(
        i.alias("seq"),
        (i % 101 / F.lit(100.0)).alias("c"),
        F.when(i % 3 == 0, "CRITICAL").when(i % 3 == 1, "HIGH").otherwise("MEDIUM").alias("base"),
        F.when(i % 4 == 0, "RCE").when(i % 4 == 1, "UNSAFE_UPLOAD").when(i % 4 == 2, "XSS").otherwise("WEAK_CRYPTO").alias("vt"),
        (i % 2 == 0).alias("admin"),
        (i % 7).alias("k7"),
        (i % 5).alias("k5"),
    )


@query(f"""WITH {_GRID} SELECT seq, CASE WHEN c < 75e-2 THEN 'MEDIUM' WHEN c < 9e-1 THEN 'HIGH' WHEN base = 'CRITICAL' THEN 'CRITICAL' ELSE 'HIGH' END AS severity,
    CASE WHEN c < 4e-1 THEN 'LOW' WHEN c < 6e-1 THEN 'MEDIUM' WHEN c < 8e-1 THEN CASE WHEN base = 'CRITICAL' THEN 'HIGH' ELSE base END ELSE base END AS downgraded,
    CASE WHEN admin THEN greatest(5e-1, c * CASE vt WHEN 'RCE' THEN 7e-1 WHEN 'UNSAFE_UPLOAD' THEN 75e-2 ELSE 8e-1 END) ELSE c END AS scaled,
    CAST(least(100, greatest(5, floor(k7 * 15 + (c - 5e-1) * 6e1))) AS INTEGER) AS blended FROM g""")
def p6_p7_p13_c11_bins(spark, sf_dir):
    g, c = _grid(spark, sf_dir), F.col("c")
    return g.select("seq", S.severity(c, F.col("base")).alias("severity"), S.downgraded(c, F.col("base")).alias("downgraded"), S.admin_scaled(c, F.col("admin"), F.col("vt")).alias("scaled"), S.blended(F.col("k7") * 15, c).alias("blended"))


@query(f"""WITH {_GRID}, a AS (SELECT *, CASE WHEN k7 < 3 THEN 'strong' WHEN k7 = 3 THEN 'weak' ELSE '' END AS src, k5 IN (1, 3) AS builtin, k5 IN (2, 3) AS other, k7 % 2 = 0 AS tainted, k5 = 4 AS sanitized, CAST(k7 AS INTEGER) AS hops FROM g)
    SELECT seq, greatest(0e0, least(1e0, 85e-2 + CASE src WHEN 'strong' THEN 15e-2 WHEN 'weak' THEN 5e-2 ELSE CASE WHEN vt = 'WEAK_CRYPTO' THEN -5e-2 ELSE -4e-1 END END - CASE WHEN builtin THEN 35e-2 ELSE 0e0 END - CASE WHEN other THEN 2e-1 ELSE 0e0 END
      + CASE WHEN sanitized THEN -4e-1 WHEN tainted THEN 1e-1 ELSE 0e0 END + CASE WHEN NOT sanitized AND tainted AND hops <= 2 THEN 5e-2 ELSE 0e0 END - CASE WHEN base = 'HIGH' THEN 2e-1 ELSE 0e0 END - CASE WHEN admin THEN 15e-2 ELSE 0e0 END - CASE WHEN vt = 'RCE' THEN 15e-2 ELSE 0e0 END
      + CASE WHEN src <> '' AND tainted AND NOT sanitized THEN 1e-1 ELSE 0e0 END)) AS confidence, CASE WHEN admin OR other THEN 4e-1 ELSE 6e-1 END AS least FROM a""")
def c10_f5_confidence(spark, sf_dir):
    g = _grid(spark, sf_dir)
    k7, k5 = F.col("k7"), F.col("k5")
    none = F.array().cast("array<string>")
    sources = F.when(k7 < 3, F.array(F.lit("GET"))).when(k7 == 3, F.array(F.lit("WEAK_INPUT"))).otherwise(none)
    sans = F.concat(F.when(k5.isin(1, 3), F.array(F.lit("intval"))).otherwise(none), F.when(k5.isin(2, 3), F.array(F.lit("my_clean"))).otherwise(none))
    c = S.confidence(sources, sans, k7 % 2 == 0, k5 == 4, k7, F.col("base") == "HIGH", F.col("admin"), F.col("vt") == "RCE", F.col("vt"))
    return g.select("seq", c.alias("confidence"), S.least_confidence(sans, F.col("admin")).alias("least"))


@query(f"WITH {_GRID} SELECT seq, concat(CAST(round_even(c * 100, 0) AS INTEGER), '%') AS percent, 'https://cwe.mitre.org/data/definitions/' || split_part('CWE-' || k7, '-', 2) || '.html' AS url FROM g")
def p3_p5_percent_and_url(spark, sf_dir):
    return _grid(spark, sf_dir).select("seq", T.percent(F.col("c")).alias("percent"), T.cwe_url(F.concat(F.lit("CWE-"), F.col("k7").cast("string"))).alias("url"))
