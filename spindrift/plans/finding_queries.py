"""Queries on findings: dedup, ranking, top-k, aggregates, reports, joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import score as S
from ..functions import text as T
from ..operators import joins, ranking, reports, taint
from ..registry import query
from ..sources.catalog import catalog, rows
from ..sources.corpus import FILES, LINES, doc_files, event_lines, labelled, read
from .line_queries import ASSIGNS, FINDINGS, SINKS, findings

_KEEP = "file_id, line_no, seq, vuln_type, severity, confidence"
#: Findings of repeated places, for dedup: several analyses report the same lines with other confidences.
REPEATED = """rep AS (SELECT user_id % 97 AS file_id, CAST(event_id % 11 AS INTEGER) AS line_no, event_id AS seq, CASE event_id % 3 WHEN 0 THEN 'XSS' WHEN 1 THEN 'SQL_INJECTION' ELSE 'SSRF' END AS vuln_type,
    CASE WHEN event_id % 17 = 0 THEN 'CRITICAL' WHEN event_id % 5 = 0 THEN 'HIGH' WHEN event_id % 5 < 4 THEN 'MEDIUM' ELSE 'LOW' END AS severity, event_id % 13 / 13e0 AS confidence FROM events)"""


def repeated(spark, sf_dir):
    i = F.col("event_id")
    return read(spark, sf_dir, "events").select(
        (F.col("user_id") % 97).alias("file_id"),
        (i % 11).cast("int").alias("line_no"),
        i.alias("seq"),
        F.when(i % 3 == 0, "XSS").when(i % 3 == 1, "SQL_INJECTION").otherwise("SSRF").alias("vuln_type"),
        F.when(i % 17 == 0, "CRITICAL").when(i % 5 == 0, "HIGH").when(i % 5 < 4, "MEDIUM").otherwise("LOW").alias("severity"),
        (i % 13 / F.lit(13.0)).alias("confidence"),
    )


@query(f"WITH {REPEATED} SELECT {_KEEP} FROM rep QUALIFY row_number() OVER (PARTITION BY file_id, line_no, vuln_type ORDER BY confidence DESC, seq) = 1")
def a7_dedup_best(spark, sf_dir):
    return ranking.best(repeated(spark, sf_dir), ["file_id", "line_no", "vuln_type"])


@query(f"WITH {REPEATED} SELECT {_KEEP} FROM rep QUALIFY row_number() OVER (PARTITION BY file_id, vuln_type, severity ORDER BY seq) = 1")
def a8_dedup_first(spark, sf_dir):
    return ranking.first(repeated(spark, sf_dir), ["file_id", "vuln_type", "severity"])


@query(f"WITH {REPEATED} SELECT {_KEEP}, min(seq) OVER (PARTITION BY file_id, line_no, vuln_type) AS place FROM rep QUALIFY row_number() OVER (PARTITION BY file_id, line_no, vuln_type ORDER BY confidence DESC, seq) = 1")
def a9_dedup_merge(spark, sf_dir):
    return ranking.merged(repeated(spark, sf_dir), ["file_id", "line_no", "vuln_type"])


@query(f"WITH {REPEATED} SELECT {_KEEP} FROM rep QUALIFY row_number() OVER (PARTITION BY file_id, vuln_type ORDER BY confidence DESC, seq) <= 3 OR severity = 'CRITICAL'")
def w29_t4_top_per_type(spark, sf_dir):
    return ranking.top_per_type(repeated(spark, sf_dir))


@query(f"""WITH {REPEATED} SELECT seq, severity, confidence, row_number() OVER (ORDER BY CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END DESC, confidence DESC, seq) AS pos FROM rep""")
def w30_t1_ranked(spark, sf_dir):
    return ranking.ranked(repeated(spark, sf_dir)).select("seq", "severity", "confidence", "pos")


@query(f"WITH {REPEATED} SELECT seq, severity, CAST(row_number() OVER (PARTITION BY severity ORDER BY seq) AS INTEGER) AS rn FROM rep QUALIFY rn <= 10")
def t3_first_per_severity(spark, sf_dir):
    return ranking.first_per_severity(repeated(spark, sf_dir)).select("seq", "severity", "rn")


_COUNTS = "count(*) AS total, count_if(severity = 'CRITICAL') AS critical, count_if(severity = 'HIGH') AS high, count_if(severity = 'MEDIUM') AS medium, count_if(severity NOT IN ('CRITICAL', 'HIGH', 'MEDIUM')) AS low"


@query(f"WITH {REPEATED} SELECT {_COUNTS} FROM rep")
def a1_severity_counts(spark, sf_dir):
    return repeated(spark, sf_dir).agg(*reports.severity_counts())


@query(f"WITH {REPEATED} SELECT vuln_type AS value, count(*) AS n, min(seq) AS first_seq FROM rep GROUP BY 1 ORDER BY n DESC, first_seq LIMIT 10")
def a2_t2_common_types(spark, sf_dir):
    return reports.most_common(repeated(spark, sf_dir), F.col("vuln_type"), 10)


@query(f"WITH {FILES} SELECT split_part(path, '/', 3) AS value, count(*) AS n, min(file_id) AS first_seq FROM files GROUP BY 1 ORDER BY n DESC, first_seq LIMIT 5")
def a3_common_files(spark, sf_dir):
    return reports.most_common(doc_files(spark, sf_dir).withColumnRenamed("file_id", "seq"), F.split_part("path", F.lit("/"), F.lit(3)), 5)


@query(f"""{FINDINGS}, best AS (SELECT * FROM findings QUALIFY row_number() OVER (PARTITION BY file_id, line_no, vuln_type ORDER BY confidence DESC, seq) = 1), c AS (SELECT file_id, {_COUNTS} FROM best GROUP BY 1),
    r AS (SELECT *, least(100, 25 * critical + 10 * high + 3 * medium + low) AS risk FROM c) SELECT *, CASE WHEN risk >= 75 THEN 'CRITICAL' WHEN risk >= 50 THEN 'HIGH' WHEN risk >= 25 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM r""")
def a4_risk_by_file(spark, sf_dir):
    return reports.risk_by(ranking.best(findings(spark, sf_dir), ["file_id", "line_no", "vuln_type"]), "file_id")


@query(f"WITH {REPEATED}, c AS (SELECT severity, count(*) AS n FROM rep GROUP BY 1) SELECT severity, n, n * 1e2 / greatest(sum(n) OVER (), 1) AS share FROM c")
def a5_shares(spark, sf_dir):
    return reports.shares(repeated(spark, sf_dir))


@query(f"WITH {REPEATED} SELECT file_id, string_agg(DISTINCT vuln_type, ',' ORDER BY vuln_type) AS types, count(*) AS n, string_agg(CAST(seq AS VARCHAR), ',' ORDER BY seq) FILTER (severity = 'CRITICAL') AS critical FROM rep GROUP BY 1")
def a6_a10_grouped(spark, sf_dir):
    seqs = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("severity") == "CRITICAL", F.col("seq")))), lambda x: x.cast("string")), ",")
    return repeated(spark, sf_dir).groupBy("file_id").agg(F.array_join(F.array_sort(F.collect_set("vuln_type")), ",").alias("types"), F.count("*").alias("n"), F.nullif(seqs, F.lit("")).alias("critical"))


@query(f"WITH {REPEATED} SELECT file_id, max(line_no) AS deepest, CAST(count(DISTINCT vuln_type) = 3 AS BOOLEAN) AS all_types, count(DISTINCT line_no) AS lines FROM rep GROUP BY 1")
def a11_a12_a24_lattice_counts(spark, sf_dir):
    return repeated(spark, sf_dir).groupBy("file_id").agg(F.max("line_no").alias("deepest"), (F.count_distinct("vuln_type") == 3).alias("all_types"), F.count_distinct("line_no").alias("lines"))


@query(f"""WITH {ASSIGNS}, {SINKS}, s AS (SELECT s.file_id, s.line_no, a.func, s.line_no - a.line_no AS dist FROM sinks s LEFT JOIN assigns a ON a.file_id = s.file_id AND a.func IS NOT NULL AND a.line_no BETWEEN s.line_no - 19 AND s.line_no)
    SELECT file_id, line_no, count(func) > 0 AS any_sanitizer, count(func) AS n, coalesce(bool_or(func = 'intval'), false) AS type_match, CAST(min(dist) AS INTEGER) AS nearest FROM s GROUP BY 1, 2""")
def a14_sanitizer_stats(spark, sf_dir):
    lines = event_lines(spark, sf_dir)
    a = taint.assigns(lines).where("func IS NOT NULL").select(F.col("file_id").alias("k"), F.col("line_no").alias("l"), "func")
    s = taint.sink_hits(lines).select("file_id", "line_no").distinct()
    hit = (F.col("k") == F.col("file_id")) & F.col("l").between(F.col("line_no") - 19, F.col("line_no"))
    got = s.join(a, hit, "left")
    return got.groupBy("file_id", "line_no").agg((F.count("func") > 0).alias("any_sanitizer"), F.count("func").alias("n"), F.coalesce(F.bool_or(F.col("func") == "intval"), F.lit(False)).alias("type_match"), F.min(F.col("line_no") - F.col("l")).alias("nearest"))


_TRUTH = "truth AS (SELECT d.doc_id, d.lang, l.toxic AS expected, l.toxic AS truth, CAST(d.n_chars % 3 = 0 AS INTEGER) AS predicted, d.n_chars % 101 / 101e0 AS score FROM labels l JOIN documents d USING (doc_id))"


def _truth(spark, sf_dir):
    n = F.col("n_chars")
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", (n % 3 == 0).cast("int").alias("predicted"), (n % 101 / F.lit(101.0)).alias("score"))
    return d.join(read(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("expected"), F.col("toxic").alias("truth")), "doc_id")


_QUALITY = """count_if(expected = 1 AND predicted = 1) AS tp, count_if(expected = 0 AND predicted = 1) AS fp, count_if(expected = 1 AND predicted = 0) AS fn, count_if(expected = 0 AND predicted = 0) AS tn"""
_RATIOS = "CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) END AS precision, CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2e0 * tp / (2e0 * tp + fp + fn) END AS f1"


@query(f"WITH {_TRUTH}, c AS (SELECT {_QUALITY} FROM truth) SELECT *, {_RATIOS} FROM c")
def a18_quality(spark, sf_dir):
    return reports.quality(_truth(spark, sf_dir))


@query(f"WITH {_TRUTH} SELECT CASE WHEN score < 3e-1 THEN 'SAFE' WHEN score < 55e-2 THEN 'SUSPICIOUS' ELSE 'VULNERABLE' END AS band, count(*) AS n, count_if(truth = 1) AS tp, count_if(truth = 0) AS fp, count_if(truth = 1) * 1e2 / count(*) AS tp_share FROM truth GROUP BY 1")
def a20_m10_bands(spark, sf_dir):
    return reports.bands(_truth(spark, sf_dir))


@query(f"WITH {_TRUTH}, c AS (SELECT lang, {_QUALITY} FROM truth GROUP BY 1 HAVING count(*) >= 5) SELECT *, {_RATIOS} FROM c")
def a21_quality_by_group(spark, sf_dir):
    q = reports.quality(_truth(spark, sf_dir), "lang")
    return q.where(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn") >= 5)


@query(f"WITH {FILES}, l AS (SELECT CASE WHEN regexp_matches(lower(replace(path, 'src', 'safe_')), '(^|/)safe(_|/|$)') THEN 0 END AS label, split_part(path, '/', 4) AS lang FROM files) SELECT lang, CAST(label AS INTEGER) AS label, count(*) AS n FROM l GROUP BY 1, 2")
def a22_s11_labelled_counts(spark, sf_dir):
    f = doc_files(spark, sf_dir).withColumn("path", F.replace("path", F.lit("src"), F.lit("safe_")))
    return labelled(f).groupBy(F.split_part("path", F.lit("/"), F.lit(4)).alias("lang"), "label").agg(F.count("*").alias("n"))


@query(f"WITH {REPEATED} SELECT CASE max(CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END) WHEN 4 THEN 2 WHEN 3 THEN 1 ELSE 0 END AS exit_code FROM rep")
def k5_exit_code(spark, sf_dir):
    return repeated(spark, sf_dir).agg(reports.exit_code())


@query(f"""WITH {REPEATED} SELECT seq, concat('{{"file_id":', file_id, ',"line_no":', line_no, ',"vuln_type":"', vuln_type, '","severity":"', severity, '"}}') AS doc FROM rep""")
def k1_json_rows(spark, sf_dir):
    return reports.json_rows(repeated(spark, sf_dir).withColumn("confidence", F.lit(None).cast("double")))


@query(f"""WITH {REPEATED}, m AS (SELECT DISTINCT vuln_type, CASE vuln_type WHEN 'SQL_INJECTION' THEN 'CWE-89' WHEN 'XSS' THEN 'CWE-79' WHEN 'SSRF' THEN 'CWE-918' ELSE 'CWE-1035' END AS cwe FROM rep)
    SELECT vuln_type AS rule_id, cwe, 'https://cwe.mitre.org/data/definitions/' || split_part(cwe, '-', 2) || '.html' AS help_uri FROM m""")
def k2_j10_sarif_rules(spark, sf_dir):
    return reports.sarif_rules(repeated(spark, sf_dir))


@query(f"""WITH {REPEATED}, l AS (SELECT *, CASE severity WHEN 'CRITICAL' THEN 'error' WHEN 'HIGH' THEN 'error' WHEN 'MEDIUM' THEN 'warning' ELSE 'note' END AS level FROM rep)
    SELECT seq, vuln_type AS rule_id, level, concat('{{"ruleId":"', vuln_type, '","level":"', level, '","locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"', file_id, '"}},"region":{{"startLine":', line_no, '}}}}}}]}}') AS result FROM l""")
def k2_sarif_results(spark, sf_dir):
    return reports.sarif_results(repeated(spark, sf_dir))


@query(f"""WITH {REPEATED}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY severity ORDER BY seq) AS INTEGER) AS rn FROM rep QUALIFY rn <= 10)
    SELECT severity, rn, '[' || severity || '] ' || vuln_type || ' line ' || line_no || ' (' || CAST(round_even(confidence * 100, 0) AS INTEGER) || '%)' AS line FROM r""")
def k3_text_report(spark, sf_dir):
    return reports.text_report(repeated(spark, sf_dir))


# joins


@query(f"WITH {ASSIGNS}, c(name, strength) AS (VALUES ('intval', 'strong'), ('trim', 'weak')) SELECT a.file_id, a.line_no, a.func, coalesce(c.strength, 'none') AS strength FROM assigns a LEFT JOIN c ON c.name = a.func WHERE a.func IS NOT NULL")
def j2_catalog_lookup(spark, sf_dir):
    table = catalog(spark, "sanitizers").select(F.col("name").alias("func"), "strength")
    a = taint.assigns(event_lines(spark, sf_dir)).where("func IS NOT NULL").select("file_id", "line_no", "func")
    return joins.lookup(a, table, "func", {"strength": "none"})


_NAMES = "n AS (SELECT event_id AS seq, CASE event_id % 4 WHEN 0 THEN 'my_escape' WHEN 1 THEN 'clean' WHEN 2 THEN 'xclean_escape' ELSE 'other' END AS name FROM events), c(ord, entry) AS (VALUES (0, 'escape'), (1, 'clean'), (2, 'xclean'))"


@query(f"WITH {_NAMES} SELECT n.seq, n.name, c.entry FROM n JOIN c ON contains(n.name, c.entry) OR contains(c.entry, n.name) QUALIFY row_number() OVER (PARTITION BY n.seq ORDER BY c.ord) = 1")
def j3_containment_first(spark, sf_dir):
    i = F.col("event_id")
    n = read(spark, sf_dir, "events").select(i.alias("seq"), F.when(i % 4 == 0, "my_escape").when(i % 4 == 1, "clean").when(i % 4 == 2, "xclean_escape").otherwise("other").alias("name"))
    c = spark.createDataFrame([(0, "escape"), (1, "clean"), (2, "xclean")], "ord int, entry string")
    return joins.containing(n, c, F.col("name"), F.col("entry"), F.col("ord"), ["seq"]).select("seq", "name", "entry")


@query(f"WITH {ASSIGNS}, t AS (SELECT DISTINCT file_id, lhs AS var FROM assigns WHERE source IS NOT NULL) SELECT a.file_id, a.line_no, t.var FROM assigns a JOIN t ON a.file_id = t.file_id AND a.source IS NULL AND regexp_extract(a.rhs, '\\$(\\w+)', 1) = t.var")
def j4_tainted_in_rhs(spark, sf_dir):
    a = taint.assigns(event_lines(spark, sf_dir))
    t = a.where("source IS NOT NULL").select("file_id", F.col("lhs").alias("var")).distinct()
    return taint.copies(a).select("file_id", "line_no", F.col("rhs_var").alias("var")).join(t, ["file_id", "var"])


@query(f"WITH {ASSIGNS}, {SINKS} SELECT s.file_id, s.line_no, s.seq FROM sinks s WHERE NOT EXISTS (SELECT 1 FROM assigns a WHERE a.file_id = s.file_id AND a.source IS NOT NULL AND abs(a.line_no - s.line_no) <= 2)")
def j6_band_anti(spark, sf_dir):
    lines = event_lines(spark, sf_dir)
    o = taint.assigns(lines).where("source IS NOT NULL").withColumnRenamed("line_no", "at")
    return joins.near(taint.sink_hits(lines), o, "file_id", "line_no", "at", 2, "left_anti").select("file_id", "line_no", "seq")


@query(f"WITH {ASSIGNS}, {SINKS} SELECT s.file_id, s.line_no, s.seq FROM sinks s WHERE EXISTS (SELECT 1 FROM assigns a WHERE a.file_id = s.file_id AND a.func = 'intval' AND abs(a.line_no - s.line_no) <= 5)")
def j7_band_semi(spark, sf_dir):
    lines = event_lines(spark, sf_dir)
    o = taint.assigns(lines).where("func = 'intval'").withColumnRenamed("line_no", "at")
    return joins.near(taint.sink_hits(lines), o, "file_id", "line_no", "at", 5, "left_semi").select("file_id", "line_no", "seq")


@query(f"WITH {LINES}, {SINKS}, b AS (SELECT file_id, line_no AS start_line, line_no + 3 AS end_line FROM lines WHERE seq % 5 = 0) SELECT s.file_id, s.line_no, b.start_line, b.end_line FROM sinks s JOIN b ON b.file_id = s.file_id AND s.line_no BETWEEN b.start_line AND b.end_line")
def j8_interval_containment(spark, sf_dir):
    lines = event_lines(spark, sf_dir)
    b = lines.where("seq % 5 = 0").select("file_id", F.col("line_no").alias("start_line"), (F.col("line_no") + 3).alias("end_line"))
    return joins.contained_in(taint.sink_hits(lines).select("file_id", "line_no"), b, "file_id", "line_no", "start_line", "end_line")


@query("""WITH c(name) AS (SELECT DISTINCT source || '/' || lang || '/X' FROM documents), p(prefix, dir) AS (VALUES ('src1', 'a'), ('src1/en', 'b'), ('src', 'c'), ('src19/f', 'd'))
    SELECT name, prefix, dir FROM c JOIN p ON starts_with(name, prefix) QUALIFY row_number() OVER (PARTITION BY name ORDER BY length(prefix) DESC) = 1""")
def j11_t7_longest_prefix(spark, sf_dir):
    c = read(spark, sf_dir, "documents").select(F.concat("source", F.lit("/"), "lang", F.lit("/X")).alias("name")).distinct()
    p = spark.createDataFrame([("src1", "a"), ("src1/en", "b"), ("src", "c"), ("src19/f", "d")], "prefix string, dir string")
    return joins.longest_prefix(c, p, "name", "prefix", ["name"])


@query("""WITH f AS (SELECT DISTINCT '/src/' || source || '/' || lang || '.php' AS path FROM documents), r AS (SELECT DISTINCT source, lang FROM documents),
    c AS (SELECT source, lang, '/src/' || source || '/xx.php' AS p1, '/src/' || replace(source, 'src1', 'src') || '/' || lang || '.php' AS p2 FROM r)
    SELECT c.source, c.lang, coalesce(a.path, b.path) AS resolved FROM c LEFT JOIN f a ON a.path = c.p1 LEFT JOIN f b ON b.path = c.p2""")
def j12_candidate_paths(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("source", "lang").distinct()
    f = d.select(F.concat(F.lit("/src/"), "source", F.lit("/"), "lang", F.lit(".php")).alias("path"))
    first = T.normal_path(F.concat(F.lit("/src/"), "source", F.lit("/./sub/../xx.php")))
    second = T.normal_path(F.concat(F.lit("/src/../src//"), F.replace("source", F.lit("src1"), F.lit("src")), F.lit("/"), "lang", F.lit(".php")))
    return joins.candidates(d, f, first, second)


@query("""WITH c AS (SELECT o_orderkey AS call_id, 'f' || (o_custkey % 3) AS callee, ['$a' || (o_orderkey % 5), '$b', '$c' || (o_orderkey % 2)] AS args FROM orders),
    f(name, params) AS (VALUES ('f0', ['x']), ('f1', ['x', 'y']), ('f2', ['x', 'y', 'z', 'w']))
    SELECT call_id, callee, CAST(i - 1 AS INTEGER) AS idx, args[i] AS arg, params[i] AS param FROM (SELECT c.*, f.params, unnest(range(1, least(len(args), len(params)) + 1)) AS i FROM c JOIN f ON f.name = c.callee)""")
def j14_arguments_to_parameters(spark, sf_dir):
    k = F.col("o_orderkey")
    c = read(spark, sf_dir, "orders").select(k.alias("call_id"), F.concat(F.lit("f"), (F.col("o_custkey") % 3).cast("string")).alias("callee"), F.array(F.concat(F.lit("$a"), (k % 5).cast("string")), F.lit("$b"), F.concat(F.lit("$c"), (k % 2).cast("string"))).alias("args"))
    f = spark.createDataFrame([("f0", ["x"]), ("f1", ["x", "y"]), ("f2", ["x", "y", "z", "w"])], "name string, params array<string>")
    return joins.arguments_to_parameters(c, f)


@query(f"""{FINDINGS}, v AS (SELECT DISTINCT file_id, line_no, vuln_type FROM flows WHERE hops = 0)
    SELECT f.seq, CASE WHEN v.file_id IS NOT NULL THEN least(98e-2, f.confidence + 1e-1) ELSE greatest(0e0, f.confidence - 15e-2) END AS confidence, v.file_id IS NOT NULL AS verified FROM findings f LEFT JOIN v USING (file_id, line_no, vuln_type)""")
def j16_verification(spark, sf_dir):
    lines = event_lines(spark, sf_dir)
    direct = taint.flows(taint.closure(taint.assigns(lines), depth=0), taint.sink_hits(lines)).select("file_id", "line_no", "vuln_type").distinct().withColumn("v", F.lit(True))
    f = findings(spark, sf_dir).join(direct, ["file_id", "line_no", "vuln_type"], "left")
    c = F.when(F.col("v"), F.least(F.lit(0.98), F.col("confidence") + F.lit(0.1))).otherwise(F.greatest(F.lit(0.0), F.col("confidence") - F.lit(0.15)))
    return f.select("seq", c.alias("confidence"), F.coalesce("v", F.lit(False)).alias("verified"))


@query(f"WITH {REPEATED} SELECT r.seq, d.lang, d.doc_id IS NULL AS missing FROM rep r LEFT JOIN documents d ON d.doc_id = r.file_id * 20")
def j18_code_of_finding(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "lang")
    r = repeated(spark, sf_dir)
    return r.join(d, d["doc_id"] == r["file_id"] * 20, "left").select("seq", "lang", F.col("doc_id").isNull().alias("missing"))


@query("SELECT user_id % 50 AS key, arg_max(event_type, event_id) AS last_type, max(event_id) AS last_write FROM events GROUP BY 1")
def j19_last_write(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy((F.col("user_id") % 50).alias("key")).agg(F.max_by("event_type", "event_id").alias("last_type"), F.max("event_id").alias("last_write"))


@query(f"WITH {REPEATED} SELECT {_KEEP}, 'a' AS stage FROM rep WHERE vuln_type = 'XSS' UNION ALL SELECT {_KEEP}, 'b' AS stage FROM rep WHERE severity = 'CRITICAL' UNION ALL SELECT file_id, line_no, seq, vuln_type, NULL, NULL, 'c' FROM rep WHERE line_no = 3")
def u1_u2_stage_union(spark, sf_dir):
    r = repeated(spark, sf_dir)
    a, b = r.where("vuln_type = 'XSS'").withColumn("stage", F.lit("a")), r.where("severity = 'CRITICAL'").withColumn("stage", F.lit("b"))
    return a.unionByName(b).unionByName(r.where("line_no = 3").drop("severity", "confidence").withColumn("stage", F.lit("c")), allowMissingColumns=True)


@query(f"WITH {REPEATED} SELECT vuln_type, severity, count(*) AS n, grouping(vuln_type) AS all_types FROM rep GROUP BY CUBE (vuln_type, severity)")
def a_extra_report_cube(spark, sf_dir):
    return repeated(spark, sf_dir).cube("vuln_type", "severity").agg(F.count("*").alias("n"), F.grouping("vuln_type").cast("long").alias("all_types"))


@query(f"WITH {REPEATED} SELECT file_id, line_no, severity, CASE severity WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END AS rank FROM rep")
def s0_severity_rank(spark, sf_dir):
    return repeated(spark, sf_dir).select("file_id", "line_no", "severity", S.severity_rank(F.col("severity")).alias("rank"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{r['name']}', '{r['vuln_type']}', '{r['severity']}')" for r in rows("sinks")) + ") t(name, vuln_type, severity)")
def s7_x2_catalog(spark, sf_dir):
    return catalog(spark, "sinks").select("name", "vuln_type", "severity")
