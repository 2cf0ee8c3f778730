"""Rules on lines and files.

Spark compiles a regex once for a literal, and again for each row if it comes from a column. Rules of a catalog are
therefore literals in one projection: a line is read once, whatever the number of rules, and nothing is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def hits(lines: DataFrame, rules: list[dict], text: str = "text", flags: str = "(?i)") -> DataFrame:
    """A row for each line and rule that it matches: rule (its number), vuln_type, severity, n (matches)."""
    text_col = F.col(text)
    found = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(r["vuln_type"]).alias("vuln_type"), F.lit(r["severity"]).alias("severity"), F.regexp_count(text_col, F.lit(flags + r["regex"])).alias("n")) for i, r in enumerate(rules)])
    out = lines.withColumn("hit", F.explode(F.filter(found, lambda x: x["n"] > 0)))
    return out.select(*lines.columns, "hit.*")


def first_reason(reasons: list[tuple[str, Column]]) -> Column:
    """The name of the first test that holds, or null."""
    return F.coalesce(*[F.when(test, name) for name, test in reasons])


def fp_reason(text: Column, vuln_type: Column, rules: list[dict]) -> Column:
    """The first false-positive rule that applies to the type and matches, by its category, or null."""
    return first_reason([(r["category"], text.rlike("(?i)" + r["regex"]) & (F.lit(not r["applies_to"]) | vuln_type.isin(r["applies_to"] or [""]))) for r in rules])


def frameworks(code: Column, rules: list[dict]) -> Column:
    """The first framework, alphabetically, of which the code holds a mark, or null."""
    return first_reason([(r["name"], F.exists(F.array(*map(F.lit, r["detect"])), lambda d: F.contains(code, d))) for r in sorted(rules, key=lambda r: r["name"])])


def framework_votes(code: Column, rules: list[dict]) -> Column:
    """(name, marks) of the framework with most marks in the code, the alphabetically first of equals; null if none."""
    votes = F.array(*[F.struct(sum((F.contains(code, F.lit(d)).cast("int") for d in r["detect"]), F.lit(0)).alias("marks"), F.lit(-i).alias("back"), F.lit(r["name"]).alias("name")) for i, r in enumerate(sorted(rules, key=lambda r: r["name"]))])
    top = F.array_max(votes)
    return F.when(top["marks"] > 0, F.struct(top["name"].alias("name"), top["marks"].alias("marks")))


ROLES = {
    "routing": r"(?:\bRoute::|->(?:get|post|any)\s*\(\s*['\"]/)",
    "admin": r"(?:is_?admin|admin_)",
    "ajax": r"(?:wp_ajax_|HTTP_X_REQUESTED_WITH)",
    "auth": r"(?:login|password_verify|session_start)\s*\(",
    "file_ops": r"\b(?:fopen|file_get_contents|file_put_contents|unlink)\s*\(",
    "dangerous": r"\b(?:eval|exec|system|unserialize)\s*\(",
    "db": r"(?:mysqli?_query|new\s+PDO|->query)\s*\(",
}
UPLOAD = [r"\$_FILES", r"move_uploaded_file", r"multipart/form-data", r"tmp_name"]


def roles(code: Column) -> Column:
    """All roles of a file; upload if at least two of its four marks are there, entry point by the file's beginning."""
    tests = [F.when(code.rlike("(?i)" + p), r) for r, p in ROLES.items()]
    tests.append(F.when(sum((code.rlike("(?i)" + p).cast("int") for p in UPLOAD), F.lit(0)) >= 2, "upload"))
    tests.append(F.when(F.substring(code, 1, 500).rlike(r"(?i)(?:require|include)(?:_once)?\b"), "entry_point"))
    return F.array_compact(F.array(*tests))
