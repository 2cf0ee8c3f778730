"""Queries on programs, by the PHP front end, and models that Spark's library trains."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graphs, programs, taint
from ..registry import query
from ..sources.corpus import LINES, event_lines, read
from ..streaming import incremental
from .line_queries import ASSIGNS, SINKS
from .scan import scan


def whole_files(lines):
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    return lines.groupBy("file_id").agg(F.array_join(F.concat(F.array(F.lit("<?php")), F.transform(ordered, lambda x: x["text"])), "\n").alias("code"))


def _nested(spark, sf_dir):
    k = F.col("seq") % 6
    text = F.when(k == 0, F.concat(F.lit("if ($c) { "), "text", F.lit(" }"))).when(k == 1, F.concat(F.lit("while ($c) { "), "text", F.lit(" }"))).otherwise(F.col("text"))
    return whole_files(event_lines(spark, sf_dir).withColumn("text", text))


@query(f"WITH {LINES} SELECT file_id, CAST(count_if(starts_with(text, '$')) AS INTEGER) AS assigns, CAST(count_if(contains(text, '(')) AS INTEGER) AS calls, CAST(count_if(starts_with(text, 'echo')) AS INTEGER) AS echoes FROM lines GROUP BY 1")
def s15_g17_syntax_counts(spark, sf_dir):
    k = programs.kinds(whole_files(event_lines(spark, sf_dir)))
    n = lambda kind, name: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)).alias(name)
    return k.groupBy("file_id").agg(n("assign", "assigns"), n("call", "calls"), n("echo", "echoes"))


@query(f"WITH {LINES}, k AS (SELECT file_id, count_if(seq % 6 = 0) AS i, count_if(seq % 6 = 1) AS w FROM lines GROUP BY 1) SELECT file_id, CAST(3 + 2 * i + 3 * w AS INTEGER) AS blocks, CAST(2 + 3 * i + 4 * w AS INTEGER) AS edges, CAST(w AS INTEGER) AS back_edges FROM k")
def g10_control_flow(spark, sf_dir):
    return programs.graphs(_nested(spark, sf_dir)).select("file_id", "blocks", "edges", "back_edges")


@query(f"WITH {LINES}, k AS (SELECT file_id, count_if(seq % 6 = 0) AS i, count_if(seq % 6 = 1) AS w FROM lines GROUP BY 1) SELECT file_id, 2 + 3 * i + 4 * w AS edges, i + w + 0 AS joins_ FROM k")
def g11_dominators(spark, sf_dir):
    """Edges whose end isn't dominated by their start alone: each if and each loop has one block that two edges enter."""
    e = programs.edges(_nested(spark, sf_dir))
    per = e.groupBy("file_id", "dst").agg(F.count("*").alias("n"), F.count_if(F.col("idom") == F.col("src")).alias("own"))
    return per.groupBy("file_id").agg(F.sum("n").alias("edges"), F.count_if(F.col("n") > 1).alias("joins_"))


@query(f"WITH {LINES} SELECT file_id, '{{main}}' AS name, CAST(count_if(seq % 6 < 2 AND starts_with(text, '$')) AS INTEGER) AS phis FROM lines GROUP BY 1".replace("{{main}}", "{main}"))
def g12_ssa_phis(spark, sf_dir):
    return programs.graphs(_nested(spark, sf_dir)).select("file_id", "name", "phis")


@query(f"""WITH RECURSIVE {ASSIGNS}, {SINKS}, c AS (SELECT file_id, line_no, lhs, CASE WHEN source IS NOT NULL THEN 'source' WHEN func IS NOT NULL THEN 'clean' ELSE 'copy' END AS kind, regexp_extract(rhs, '\\$(\\w+)', 1) AS rhs_var FROM assigns),
    prev AS (SELECT c.file_id, c.line_no, max(p.line_no) AS at FROM c JOIN c p ON p.file_id = c.file_id AND p.lhs = c.rhs_var AND p.line_no < c.line_no WHERE c.kind = 'copy' GROUP BY 1, 2),
    start AS (SELECT s.file_id, s.line_no AS sink_line, s.vuln_type, max(p.line_no) AS at FROM sinks s JOIN c p ON p.file_id = s.file_id AND p.lhs = s.var AND p.line_no < s.line_no GROUP BY 1, 2, 3),
    tr AS (SELECT * FROM start UNION ALL SELECT tr.file_id, tr.sink_line, tr.vuln_type, prev.at FROM tr JOIN prev ON prev.file_id = tr.file_id AND prev.line_no = tr.at)
    SELECT DISTINCT tr.file_id, tr.sink_line AS line, tr.vuln_type, CASE tr.vuln_type WHEN 'XSS' THEN 85e-2 ELSE 9e-1 END AS confidence FROM tr JOIN c ON c.file_id = tr.file_id AND c.line_no = tr.at AND c.kind = 'source'""")
def g2_g13_abstract_interpretation(spark, sf_dir):
    f = programs.findings(whole_files(event_lines(spark, sf_dir)))
    return f.select("file_id", (F.col("line") - 1).alias("line"), "vuln_type", "confidence")


@query()
def g28_types(spark, sf_dir):
    return programs.types(_nested(spark, sf_dir))


@query("""WITH c AS (SELECT 'f' || user_id AS caller, 'f' || (event_id // 20) AS callee FROM events) SELECT DISTINCT caller AS src, callee AS dst FROM c WHERE callee IN (SELECT caller FROM c)""")
def g19_calls_by_parsing(spark, sf_dir):
    i, u = F.col("event_id"), F.col("user_id")
    code = read(spark, sf_dir, "events").groupBy(u.alias("file_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.floor(i / 20))), lambda x: F.concat(F.lit("f"), x.cast("string"), F.lit("($p, 1);"))), " ").alias("body"))
    files = code.select("file_id", F.concat(F.lit("<?php function f"), F.col("file_id").cast("string"), F.lit("($p) { "), "body", F.lit(" }")).alias("code"))
    c = programs.calls(files).where("idx = -1")
    return graphs.call_graph(c, programs.function_rows(files).where("name <> '{main}'"))


@query()
def c1_scan_corpus(spark, sf_dir):
    """The whole scan, on the event corpus as PHP files."""
    files = whole_files(event_lines(spark, sf_dir)).withColumn("path", F.concat(F.lit("/app/"), F.col("file_id").cast("string"), F.lit(".php")))
    return scan(files).select("file_id", "line_no", "vuln_type", "severity", "confidence", "source", "stage")


@query("SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def st1_finding_rate(spark, sf_dir):
    return incremental.finding_rate(read(spark, sf_dir, "events"))


@query("""WITH s AS (SELECT *, coalesce(date_diff('second', lag(ts) OVER w, ts) > 86400, true) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, count_if(fresh) AS sessions FROM s GROUP BY 1""")
def st2_sessions(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_timestamp("ts") - F.unix_timestamp(F.lag("ts").over(w))
    e = read(spark, sf_dir, "events").withColumn("fresh", F.coalesce(gap > 86400, F.lit(True)))
    return e.groupBy("user_id").agg(F.count_if("fresh").alias("sessions"))


_HOPS = "".join(
    f""", t{d} AS (SELECT s.file_id, s.lhs AS var, arg_min(t.origin, s.line_no) AS origin, min(s.line_no) AS line_no, {d} AS hops FROM steps s JOIN t{d - 1} t ON s.file_id = t.file_id AND s.rhs_var = t.var AND s.line_no >= t.line_no
    WHERE {' AND '.join(f'(s.file_id, s.lhs) NOT IN (SELECT (file_id, var) FROM t{k})' for k in range(d))} GROUP BY 1, 2)"""
    for d in range(1, 6)
)


@query(f"""WITH {ASSIGNS}, {SINKS}, steps AS (SELECT file_id, line_no, lhs, regexp_extract(rhs, '\\$(\\w+)', 1) AS rhs_var FROM assigns WHERE source IS NULL AND func IS NULL),
    t0 AS (SELECT file_id, lhs AS var, arg_min(source, line_no) AS origin, min(line_no) AS line_no, 0 AS hops FROM assigns WHERE source IS NOT NULL GROUP BY 1, 2){_HOPS}, every AS ({' UNION ALL '.join(f'SELECT * FROM t{d}' for d in range(6))})
    SELECT s.file_id, s.line_no, s.var, t.origin, t.hops FROM sinks s JOIN every t ON t.file_id = s.file_id AND t.var = s.var AND s.line_no > t.line_no""")
def g18_regex_trace(spark, sf_dir):
    lines = event_lines(spark, sf_dir)
    return taint.flows(taint.closure(taint.assigns(lines), depth=5), taint.sink_hits(lines)).select("file_id", "line_no", "var", "origin", "hops")


def _labelled(spark, sf_dir):
    t = F.col("text")
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.length(t).cast("double").alias("size"), F.regexp_count(t, F.lit(r"\b(?:idiot|moron|clown|loser|stupid|scum|trash)\b")).cast("double").alias("insults"), F.regexp_count(t, F.lit("[,.]")).cast("double").alias("marks"))
    return d.join(read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").cast("double").alias("label")), "id")


@query()
def m3_m4_boosted(spark, sf_dir):
    from ..operators import learning

    rows = _labelled(spark, sf_dir)
    model = learning.boosted(rows.where("id % 4 > 0"), ["size", "insults", "marks"])
    return learning.scored(model, rows.where("id % 4 = 0")).select("id", "label", "ml_score")


@query("""WITH d AS (SELECT d.doc_id AS id, CAST(length(text) AS DOUBLE) AS size, toxic FROM documents d JOIN labels USING (doc_id)), s AS (SELECT avg(size) AS m, stddev_pop(size) AS s FROM d WHERE toxic = 0)
    SELECT id, round(abs(size - m) / s, 6) AS anomaly FROM d, s""")
def m7_anomaly(spark, sf_dir):
    from ..operators import learning

    rows = _labelled(spark, sf_dir)
    return learning.anomaly(rows.where("label = 0"), rows, ["size"]).select("id", F.round("anomaly", 6).alias("anomaly"))


@query()
def m7_isolation(spark, sf_dir):
    """How soon random splits of the features of documents that are not toxic part each document from others."""
    from ..operators import learning

    rows, features = _labelled(spark, sf_dir), ["size", "insults", "marks"]
    return learning.isolated(learning.isolation_forest(rows.where("label = 0"), features), rows, features).select("id", "label", "anomaly")
