"""The whole scan of source files, as one lazily evaluated plan: files to lines, rules and flows to findings.

All context that a finding needs is a frame over its file's lines, so lines are shuffled by file once; the code itself
isn't carried past the line explode. Lines, hits, assignments and sinks are written once each, as several steps read them.
Everything that is joined grows with the corpus: joins are by merging, and nothing is broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lines as L
from ..functions import score as S
from ..functions import text as T
from ..operators import joins, matching, paths, ranking, stages, taint
from ..operators.graphs import cut
from ..sources import catalog

AUTH = r"(?i)\bif\s*\([^)]*(?:logged_?in|auth|admin|session|capab)|->is(?:Admin|Authenticated|LoggedIn)\(|\bcurrent_user_can\s*\(|\b(?:check|require)_(?:login|auth|permission)\s*\("
STRONG, WEAK = r"\$_(GET|POST|REQUEST|COOKIE|FILES|SERVER)", r"(?i)\$(?:post|data|input|request|params|args|body)\s*\["
CUSTOM = r"(?i)\b((?:my_|app_)?(?:sanitize|clean|escape|filter|safe)_?\w*)\s*\("
#: For some types, what in the lines around rules a finding out.
SAFE = {
    "SQL_INJECTION": r"(?i)\b(?:intval|floatval|is_numeric)\s*\(\s*\$|\((?:int|integer|float)\)\s*\$|->(?:prepare|bindParam|bindValue)\s*\(",
    "IDOR": r"(?i)\b(?:intval|is_numeric)\s*\(|owner_id|check_permission",
    "XSS": r"(?i)Content-Type:\s*application/json",
    "COMMAND_INJECTION": r"(?i)\bescapeshell(?:arg|cmd)\s*\(",
    "FILE_INCLUSION": r"(?i)\bin_array\s*\(\s*\$|\bbasename\s*\(",
    "FILE_READ": r"(?i)\b(?:realpath|basename)\s*\(",
    "FILE_WRITE": r"(?i)\b(?:realpath|basename)\s*\(",
    "RACE_CONDITION": r"(?i)\bflock\s*\(",
    "HEADER_INJECTION": r"(?i)str_replace\s*\([^)]*\\[rn]",
    "LOG_INJECTION": r"(?i)str_replace\s*\([^)]*\\[rn]",
}
MULTILINE_CONFIDENCE = 0.80


def file_facts(files: DataFrame, rules_dir: str) -> DataFrame:
    """(file_id, framework, admin_path, admin_only) of each file that isn't obfuscated, with its code."""
    c = F.col("code")
    f = stages.admin_files(files.where(~stages.packed(c)))
    return f.select("file_id", "code", matching.frameworks(c, catalog.rows("frameworks", rules_dir)).alias("framework"), "admin_path", "admin_only")


def _flag(pattern: str, text: str = "text"):
    return F.col(text).rlike(pattern)


def scan(files: DataFrame, rules_dir: str = catalog.OWN) -> DataFrame:
    """files (file_id, path, code) to findings: file_id, line_no, vuln_type, severity, confidence, source, sanitizers, code, stage."""
    facts = file_facts(files, rules_dir)
    # written once, as rules, frames, assignments and sinks all read them
    lines = cut(L.explode_lines(facts).withColumn("seq", F.col("line_no").cast("long")))
    sans = catalog.rows("sanitizers", rules_dir)
    called = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"(\w+)\s*\("), 1), F.lower))
    w = {k: L.ordered().rowsBetween(*L.FRAMES[k]) for k in ("sanitizer", "custom_sanitizer", "source", "auth", "safe_context")}
    known = F.array(*[F.lit(s["name"].lower()) for s in sans])
    context = lines.withColumns(
        {
            "in_comment": L.in_comment(),
            "sources": F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.regexp_extract_all("text", F.lit(STRONG + r"\s*\["), 1)).over(w["source"])))),
            "called": F.array_intersect(F.array_distinct(F.flatten(F.collect_list(called).over(w["sanitizer"]))), known),
            "custom": F.array_distinct(F.flatten(F.collect_list(F.regexp_extract_all("text", F.lit(CUSTOM), 1)).over(w["custom_sanitizer"]))),
            "in_auth": L.seen(_flag(AUTH), "auth"),
            **{f"safe_{t}": L.seen(_flag(p), "safe_context") for t, p in SAFE.items()},
        }
    )
    hits = matching.hits(context, catalog.rows("patterns", rules_dir))
    own = F.regexp_extract_all("text", F.lit(STRONG), 1)
    sources = F.when(F.size("sources") > 0, F.col("sources")).when(F.size(own) > 0, F.slice(own, 1, 1)).when(_flag(WEAK), F.array(F.lit("WEAK_INPUT"))).otherwise(F.array().cast("array<string>"))
    protects = F.create_map(*[F.lit(x) for s in sans for x in (s["name"].lower(), F.array(*map(F.lit, s["protects"])))])
    right = F.filter("called", lambda n: F.array_contains(F.coalesce(protects[n], F.array().cast("array<string>")), F.col("vuln_type")))
    safe = F.lit(False)
    for t in SAFE:
        safe = F.when(F.col("vuln_type") == t, F.col(f"safe_{t}")).otherwise(safe)
    fp = matching.fp_reason(F.col("text"), F.col("vuln_type"), catalog.rows("fp_rules", rules_dir))
    hits = hits.where(~F.col("in_comment") & ~safe & fp.isNull()).withColumns({"sources": sources, "sanitizers": F.array_union(right, F.col("custom"))})
    hits = cut(hits.select(*lines.columns, "in_auth", "sources", "sanitizers", "vuln_type", "severity"))
    assigned = cut(taint.assigns(lines))
    used = hits.select("file_id", "line_no", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\$([a-zA-Z]\w*)"), 1))).alias("var"))
    tracked = taint.backward(used, assigned)
    hits = hits.join(tracked.hint("merge"), ["file_id", "line_no"], "left").fillna({"tainted": False, "sanitized": False, "hops": 0})
    c = S.confidence(F.col("sources"), F.col("sanitizers"), F.col("tainted"), F.col("sanitized"), F.col("hops"), F.col("framework").isNotNull(), F.col("in_auth"), F.col("admin_path"), F.col("vuln_type"))
    pattern = hits.withColumn("confidence", S.admin_scaled(c, F.col("admin_only"), F.col("vuln_type"))).where(F.col("confidence") >= S.least_confidence(F.col("sanitizers"), F.col("admin_only")))
    code = T.preview(F.col("text"))
    out = ["file_id", "line_no", "vuln_type", S.severity(F.col("confidence"), F.col("severity")).alias("severity"), "confidence", F.get("sources", F.lit(0)).alias("source"), "sanitizers", code.alias("code")]
    pattern = pattern.select(*out, F.lit("pattern").alias("stage"))
    where = lines.select("file_id", "line_no", "text", "framework", "admin_path")
    sinks = cut(taint.sink_hits(lines))
    between = joins.near(sinks.select("file_id", "line_no").distinct(), assigned.where(taint.sanitising(F.col("func")) | F.col("cast")).select("file_id", F.col("line_no").alias("at")), "file_id", "line_no", "at", 19, "left_semi").withColumn("cleaned", F.lit(True))
    f = paths.findings(paths.uses(lines, rules_dir=rules_dir), own=False).select(F.col("file").alias("file_id"), "line_no", "vuln_type", F.substring("origin", 2, 99).alias("origin"))
    f = f.join(sinks.groupBy("file_id", "line_no", "vuln_type").agg(F.max("severity").alias("severity")).hint("merge"), ["file_id", "line_no", "vuln_type"]).join(between.hint("merge"), ["file_id", "line_no"], "left").join(where.hint("merge"), ["file_id", "line_no"])
    f = f.withColumn("confidence", taint.flow_confidence(F.col("origin"), F.coalesce("cleaned", F.lit(False)), F.col("framework").isNotNull(), F.col("admin_path"))).where("confidence >= 0.5")
    wide = f.where(fp.isNull()).select("file_id", "line_no", "vuln_type", "severity", "confidence", F.col("origin").alias("source"), F.array().cast("array<string>").alias("sanitizers"), code.alias("code"), F.lit("file").alias("stage"))
    m = taint.multiline(lines, assigned=assigned, sinks=sinks).join(between.hint("merge"), ["file_id", "line_no"], "left_anti").join(where.hint("merge"), ["file_id", "line_no"])
    less = F.when(F.col("framework").isNotNull(), F.lit(0.15)).otherwise(0.0) + F.when(F.col("admin_path"), F.lit(0.1)).otherwise(0.0)
    near = m.where(fp.isNull()).select("file_id", "line_no", "vuln_type", "severity", (F.lit(MULTILINE_CONFIDENCE) - less).alias("confidence"), F.lit(None).cast("string").alias("source"), F.array().cast("array<string>").alias("sanitizers"), code.alias("code"), F.lit("window").alias("stage"))
    rank = F.when(F.col("stage") == "pattern", 0).when(F.col("stage") == "window", 1).otherwise(2)
    every = pattern.unionByName(near).unionByName(wide).withColumn("seq", F.col("line_no") * 4 + rank)
    best = ranking.top_per_type(ranking.best(every, ["file_id", "line_no", "vuln_type"]))
    return best.where("confidence >= 0.5").withColumn("confidence", F.least(F.col("confidence"), F.lit(1.0)))
