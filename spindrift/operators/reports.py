"""Reports: counts, risk, JSON, SARIF, text and HTML, of findings."""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import score as S
from .ranking import first_per_severity


def severity_counts() -> list[Column]:
    """Conditional counters; all but the three higher severities count as low."""
    s = F.col("severity")
    named = [F.count_if(s == x).alias(x.lower()) for x in ("CRITICAL", "HIGH", "MEDIUM")]
    return [F.count("*").alias("total"), *named, F.count_if(~s.isin("CRITICAL", "HIGH", "MEDIUM")).alias("low")]


def risk_by(findings: DataFrame, *keys: str) -> DataFrame:
    out = findings.groupBy(*keys).agg(*severity_counts())
    out = out.withColumn("risk", S.risk(F.col("critical"), F.col("high"), F.col("medium"), F.col("low")))
    return out.withColumn("level", S.risk_level(F.col("risk")))


def most_common(findings: DataFrame, by: Column, n: int) -> DataFrame:
    """The n most frequent values, those that appear first before others as frequent."""
    return findings.groupBy(by.alias("value")).agg(F.count("*").alias("n"), F.min("seq").alias("first_seq")).orderBy(F.desc("n"), "first_seq").limit(n)


def exit_code() -> Column:
    """2 with a critical finding, 1 with a high one, else 0."""
    return F.when(F.max(S.severity_rank(F.col("severity"))) == 4, 2).when(F.max(S.severity_rank(F.col("severity"))) == 3, 1).otherwise(0).alias("exit_code")


def json_rows(findings: DataFrame) -> DataFrame:
    """A JSON document for each finding; what a sink writes as lines."""
    return findings.select("seq", F.to_json(F.struct("file_id", "line_no", "vuln_type", "severity", "confidence")).alias("doc"))


def sarif_rules(findings: DataFrame) -> DataFrame:
    """(rule_id, cwe, help_uri) of each type found."""
    cwe = F.coalesce(F.create_map(*[F.lit(x) for kv in S.CWE.items() for x in kv])[F.col("vuln_type")], F.lit("CWE-1035"))
    out = findings.select(F.upper(F.replace("vuln_type", F.lit(" "), F.lit("_"))).alias("rule_id"), cwe.alias("cwe")).distinct()
    return out.withColumn("help_uri", F.concat(F.lit("https://cwe.mitre.org/data/definitions/"), F.split_part("cwe", F.lit("-"), F.lit(2)), F.lit(".html")))


def sarif_results(findings: DataFrame) -> DataFrame:
    """(seq, rule_id, level, result): each result as SARIF's JSON."""
    level = F.coalesce(F.create_map(*[F.lit(x) for kv in S.LEVELS.items() for x in kv])[F.col("severity")], F.lit("note"))
    rule = F.upper(F.replace("vuln_type", F.lit(" "), F.lit("_")))
    region = F.struct(F.col("line_no").alias("startLine"))
    place = F.struct(F.struct(F.struct(F.col("file_id").cast("string").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
    result = F.struct(rule.alias("ruleId"), level.alias("level"), F.array(place).alias("locations"))
    return findings.select("seq", rule.alias("rule_id"), level.alias("level"), F.to_json(result).alias("result"))


def sarif(findings: DataFrame, path: str) -> None:
    """Results as JSON lines, written by all executors, and the run's rules beside them. Nothing is gathered in the driver."""
    sarif_results(findings).select("result").write.mode("overwrite").text(f"{path}/results")
    sarif_rules(findings).select(F.to_json(F.struct("*"))).write.mode("overwrite").text(f"{path}/rules")


def text_report(findings: DataFrame, n: int = 10) -> DataFrame:
    """(severity, rn, line): the first n of each severity, as printed."""
    top = first_per_severity(findings, n)
    return top.select("severity", "rn", F.format_string("[%s] %s line %d (%d%%)", "severity", "vuln_type", "line_no", F.bround(F.col("confidence") * 100).cast("int")).alias("line"))


def html_report(findings: DataFrame, title: str, n: int = 200) -> str:
    """A page with the counts and the first n of each severity: of bounded size."""
    total = findings.agg(*severity_counts()).first()
    rows = first_per_severity(findings, n).select("severity", "vuln_type", "file_id", "line_no", "confidence").collect()
    cells = "".join("<tr>" + "".join(f"<td>{html.escape(str(x))}</td>" for x in r) + "</tr>" for r in rows)
    counts = "".join(f"<li>{k}: {v}</li>" for k, v in total.asDict().items())
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><ul>{counts}</ul><table>{cells}</table></body></html>"


def shares(findings: DataFrame) -> DataFrame:
    """Count and percentage of each severity."""
    counts = findings.groupBy("severity").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") * F.lit(100.0) / F.greatest(F.sum("n").over(Window.partitionBy()), F.lit(1)))  # as many rows as severities


def quality(truth: DataFrame, *keys: str) -> DataFrame:
    """truth (expected 0/1, predicted 0/1): confusion counts, precision, recall, F1; null where undefined."""
    e, p = F.col("expected") == 1, F.col("predicted") == 1
    c = truth.groupBy(*keys).agg(F.count_if(e & p).alias("tp"), F.count_if(~e & p).alias("fp"), F.count_if(e & ~p).alias("fn"), F.count_if(~e & ~p).alias("tn"))
    ratio = lambda a, b: F.when(b > 0, a / b)
    tp, fp, fn = (F.col(x).cast("double") for x in ("tp", "fp", "fn"))
    return c.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def bands(scored: DataFrame, low: float = 0.3, high: float = 0.55) -> DataFrame:
    """scored (score, truth 0/1): SAFE, SUSPICIOUS and VULNERABLE with counts and the share of true ones."""
    band = F.when(F.col("score") < low, "SAFE").when(F.col("score") < high, "SUSPICIOUS").otherwise("VULNERABLE")
    out = scored.groupBy(band.alias("band")).agg(F.count("*").alias("n"), F.count_if(F.col("truth") == 1).alias("tp"), F.count_if(F.col("truth") == 0).alias("fp"))
    return out.withColumn("tp_share", F.col("tp") * F.lit(100.0) / F.col("n"))


def fenced_json(text: Column, schema: str) -> Column:
    """The JSON that a verifier's answer holds: what stands between fences, or else from the first brace to the last; null if it can't be read."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    bare = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.from_json(F.when(fenced != "", fenced).otherwise(F.nullif(bare, F.lit(""))), schema)


def dated(findings: DataFrame, target: str, at: Column | None = None) -> DataFrame:
    """One row for a report's head: scan_date (ISO 8601, UTC), target, and counts by severity."""
    when = F.date_format(F.to_utc_timestamp(at if at is not None else F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return findings.agg(*severity_counts()).select(when.alias("scan_date"), F.lit(target).alias("target"), "*")


def json_line(finding: dict) -> str:
    """A finding as one line of JSON, confidence as a percentage."""
    return json.dumps({**finding, "confidence": f"{finding['confidence']:.0%}"}, ensure_ascii=False, sort_keys=True)
