"""Queries on sources and sanitisers near a line, chains of filters, caches, unions, features, and calls across functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lines as L
from ..operators import classify, graphs, matching, programs, reports
from ..registry import query
from ..sources import catalog, corpus
from ..sources.corpus import FILES, LINES, doc_files, event_lines, read
from .context_queries import MIXED, mixed
from .finding_queries import REPEATED, repeated


@query(f"""WITH {LINES}, s AS (SELECT *, coalesce(max(CASE WHEN contains(text, '$_GET[') THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN 14 PRECEDING AND CURRENT ROW), 0) = 1 AS strong FROM (SELECT file_id, line_no, seq, CASE WHEN seq % 40 = 0 THEN '$data[1]; ' || text ELSE replace(text, '_GET', CASE WHEN seq % 4 = 0 THEN '_GET' ELSE '_X' END) END AS text FROM lines) x)
    SELECT file_id, line_no, CASE WHEN strong THEN 'GET' WHEN starts_with(text, '$data[') THEN 'WEAK_INPUT' END AS source FROM s""")
def c3_source_lookup(spark, sf_dir):
    text = F.when(F.col("seq") % 40 == 0, F.concat(F.lit("$data[1]; "), "text")).otherwise(F.replace("text", F.lit("_GET"), F.when(F.col("seq") % 4 == 0, "_GET").otherwise("_X")))
    lines = event_lines(spark, sf_dir).withColumn("text", text)
    strong = L.seen(F.contains("text", F.lit("$_GET[")), "source")
    return lines.select("file_id", "line_no", F.when(strong, "GET").when(F.col("text").rlike(r"\$(?:post|data|input)\s*\["), "WEAK_INPUT").alias("source"))


@query(f"""WITH {LINES}, s(name, level) AS (VALUES ('$_GET', 'HIGH'), ('$_POST', 'HIGH'), ('$_REQUEST', 'HIGH'), ('$_FILES', 'HIGH'), ('$_COOKIE', 'MEDIUM'), ('$_SERVER', 'MEDIUM'), ('$HTTP_RAW_POST_DATA', 'MEDIUM'),
    ('php://input', 'HIGH'), ('filter_input', 'HIGH'), ('filter_input_array', 'HIGH'), ('http_get_request_body', 'HIGH'), ('getallheaders', 'HIGH'), ('apache_request_headers', 'HIGH'))
    SELECT s.name, s.level, count(l.file_id) AS lines FROM s LEFT JOIN lines l ON contains(l.text, s.name) GROUP BY 1, 2""")
def c4_live_sources(spark, sf_dir):
    """Sources that a scan asks for, and how many lines name them."""
    s = catalog.sources(spark)
    names = [r["name"] for r in s.collect()]  # a rule set, of bounded size
    named = F.filter(F.array(*map(F.lit, names)), lambda n: F.contains(F.col("text"), n))
    found = event_lines(spark, sf_dir).select(F.explode(named).alias("name")).groupBy("name").agg(F.count("*").alias("lines"))
    return s.select("name", "level").join(found, "name", "left").fillna({"lines": 0})


@query(f"""WITH {LINES}, w AS (SELECT file_id, line_no, text, string_agg(CASE WHEN contains(text, 'intval(') THEN 'intval' END, ',') OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS s FROM lines)
    SELECT file_id, line_no, CASE WHEN s IS NULL THEN '' ELSE 'intval' END AS sanitizers FROM w WHERE contains(text, 'mysql_query')""")
def c5_c14_sanitizers_in_window(spark, sf_dir):
    """Catalog sanitisers of the sink's type among the functions that the lines before call."""
    sans = [r["name"].lower() for r in catalog.rows("sanitizers") if "SQL_INJECTION" in r["protects"]]
    called = F.transform(F.regexp_extract_all("text", F.lit(r"(\w+)\s*\("), 1), F.lower)
    near = F.array_distinct(F.flatten(F.collect_list(called).over(L.frame("sanitizer"))))
    found = F.array_sort(F.array_intersect(near, F.array(*map(F.lit, sans))))
    return event_lines(spark, sf_dir).select("file_id", "line_no", "text", F.array_join(found, ",").alias("sanitizers")).where(F.contains("text", F.lit("mysql_query"))).drop("text")


@query(f"""WITH {REPEATED}, s AS (SELECT seq, CASE seq % 5 WHEN 0 THEN 'RCE' WHEN 1 THEN 'FILE_WRITE' ELSE 'XSS' END AS vt, confidence > 45e-2 AS tp, CASE WHEN seq % 3 = 0 THEN 'basename($f)' ELSE 'x' END AS code FROM rep)
    SELECT seq FROM s WHERE tp OR (vt IN ('RCE', 'FILE_WRITE') AND NOT contains(code, 'basename('))""")
def f22_critical_override(spark, sf_dir):
    s = repeated(spark, sf_dir).select("seq", F.when(F.col("seq") % 5 == 0, "RCE").when(F.col("seq") % 5 == 1, "FILE_WRITE").otherwise("XSS").alias("vuln_type"), (F.col("confidence") > 0.45).alias("is_tp"), F.when(F.col("seq") % 3 == 0, "basename($f)").otherwise("x").alias("code"))
    return classify.kept(s).select("seq")


@query(r"""SELECT s_suppkey AS file_id, prefix, dir FROM supplier, LATERAL (VALUES ('App' || s_nationkey || '\', 'src/'), ('Lib\', 'lib' || s_nationkey || '/'), ('Tests\', 'tests/')) t(prefix, dir)""")
def s8_composer(spark, sf_dir):
    """A project's file for each supplier, with a prefix that only development has, and one that it has as well."""
    n = F.col("s_nationkey").cast("string")
    main = F.concat(F.lit('{"App'), n, F.lit('\\\\": "src/", "Lib\\\\": ["lib'), n, F.lit('/", "old/"]}'))
    dev = F.concat(F.lit('{"App'), n, F.lit('\\\\": "dev/", "Tests\\\\": "tests/"}'))
    code = F.concat(F.lit('{"name": "x", "autoload": {"psr-4": '), main, F.lit('}, "autoload-dev": {"psr-4": '), dev, F.lit("}}"))
    return corpus.psr4_of(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("file_id"), code.alias("code")))


@query(f"WITH {FILES}, n AS (SELECT path, sha256(code) AS h FROM files), o AS (SELECT path, CASE WHEN file_id % 7 = 0 THEN 'x' ELSE sha256(code) END AS h FROM files WHERE file_id % 11 > 0) SELECT count_if(o.h = n.h) AS hits, count_if(o.h IS NULL OR o.h <> n.h) AS misses, (SELECT count(*) FROM o) AS entries FROM n LEFT JOIN o USING (path)")
def s9_a17_cache_stats(spark, sf_dir):
    f = doc_files(spark, sf_dir)
    h = F.sha2(F.col("code").cast("binary"), 256)
    cached = f.where("file_id % 11 > 0").select("path", F.when(F.col("file_id") % 7 == 0, "x").otherwise(h).alias("old"))
    got = f.select("path", h.alias("h")).join(cached, "path", "left")
    hit = F.coalesce(F.col("old") == F.col("h"), F.lit(False))
    return got.agg(F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"), F.count("old").alias("entries"))


@query("""SELECT 'fixtures' AS origin, toxic AS label, count(*) AS n FROM labels GROUP BY 2 UNION ALL SELECT 'scans', quality, count(*) FROM labels GROUP BY 2 UNION ALL SELECT 'synthetic', CAST(1 AS INTEGER), count(*) FROM benchmark""")
def u8_training_union(spark, sf_dir):
    l, b = read(spark, sf_dir, "labels"), read(spark, sf_dir, "benchmark")
    parts = [("fixtures", l.select(F.col("toxic").alias("label"))), ("scans", l.select(F.col("quality").alias("label"))), ("synthetic", b.select(F.lit(1).alias("label")))]
    rows = None
    for origin, part in parts:
        part = part.withColumn("origin", F.lit(origin))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("origin", "label").agg(F.count("*").alias("n"))


@query(f"""WITH {LINES}, {MIXED}, w AS (SELECT file_id, line_no, text, coalesce(string_agg(text, chr(10)) OVER (PARTITION BY file_id ORDER BY line_no ROWS BETWEEN 19 PRECEDING AND 10 FOLLOWING), '') AS ctx FROM mixed)
    SELECT file_id, line_no, CAST(regexp_matches(text, '\\$_(GET|POST|REQUEST|COOKIE)') AS INTEGER) AS has_direct_source, CAST(regexp_matches(text, '\\((int|integer|float|bool)\\)') AS INTEGER) AS type_cast_nearby, CAST(regexp_matches(text, '->(prepare|bindParam|bindValue)') AS INTEGER) AS prepared_stmt_nearby,
      CAST(regexp_matches(ctx, '(in_array|filter_var|preg_match)\\s*\\(') AS INTEGER) AS validation_nearby, CAST(least(len(regexp_extract_all(ctx, '(^|[^A-Za-z_])(if|elseif|case|while|for|foreach)[^A-Za-z_]')) + 1, 50) AS INTEGER) AS cyclomatic_complexity FROM w""")
def m1_features(spark, sf_dir):
    f = classify.features("text", "ctx")
    w = mixed(spark, sf_dir).select("file_id", "line_no", "text", L.context("features").alias("ctx"))
    return w.select("file_id", "line_no", *[f[n].cast("int").alias(n) for n in ("has_direct_source", "type_cast_nearby", "prepared_stmt_nearby", "validation_nearby", "cyclomatic_complexity")])


@query("""WITH RECURSIVE c AS (SELECT DISTINCT user_id AS f, event_id // 20 AS g FROM events), d AS (SELECT DISTINCT f FROM c WHERE f % 13 = 5), k AS (SELECT f FROM d UNION SELECT c.f FROM k JOIN c ON c.g = k.f)
    SELECT 'f' || f AS func, 0 AS idx, 'SQL_INJECTION' AS vuln_type FROM k""")
def g20_project_summaries(spark, sf_dir):
    """Parameters that reach sinks through calls, from source files: parsed, interpreted, and joined to a fixed point.

    A name's minus is an underscore in the files, and a function that has no name is anonymous there. A file that the front
    end fails on is an error.
    """
    named = lambda x: F.concat(F.lit("f"), F.translate(x.cast("string"), "-", "_"))
    body = F.array_join(F.transform(F.array_sort(F.collect_set(F.expr("event_id div 20"))), lambda x: F.concat(named(x), F.lit("($p);"))), " ")
    code = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("file_id")).agg(body.alias("body"))
    sink = F.when(F.col("file_id") % 13 == 5, "mysql_query($p);").otherwise("")
    files = code.select("file_id", F.concat(F.lit("<?php function "), F.coalesce(named(F.col("file_id")), F.lit("")), F.lit("($p) { "), "body", sink, F.lit(" }")).alias("code"))
    p = graphs.cut(programs.parameters(files, strict=True).withColumn("func", F.nullif("func", F.lit("{closure}"))))
    direct, passed = p.where("callee IS NULL"), p.where("callee IS NOT NULL")
    out = graphs.params_to_sinks(direct, passed)
    return out.withColumn("func", F.translate("func", "_", "-"))


@query()
def k4_html_report(spark, sf_dir):
    return spark.createDataFrame([(reports.html_report(repeated(spark, sf_dir), "Findings"),)], "page string")


@query()
def m5_stacked(spark, sf_dir):
    from ..operators import learning
    from .program_queries import _labelled

    rows = _labelled(spark, sf_dir)
    return learning.stacked(rows.where("id % 4 > 0"), ["size", "insults", "marks"], folds=2)(rows.where("id % 4 = 0")).select("id", "label", "ml_score")
