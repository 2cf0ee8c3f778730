"""What a program or a shell asks for: findings of a piece of code, a file or a directory, and reports of them.

`python -m spindrift.api PATH [--mode quick|standard|deep] [--format json|text] [--max-files N] [--with-vendor]` ends with 2
if a finding is critical, 1 if one is high, else 0.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import context, reports, stages, taint
from .plans.full import MODES, scan_full
from .sources import catalog, corpus


def scan_code(spark: SparkSession, code: str, path: str = "code.php", mode: str = "quick", rules_dir: str = catalog.OWN) -> list[dict]:
    """Findings of one piece of code, by line. Line numbers are those of the code as given, whether it opens with <?php or not."""
    files = spark.createDataFrame([(0, path, code)], "file_id long, path string, code string")
    return [r.asDict() for r in scan_full(files, mode, rules_dir).orderBy("line_no", "vuln_type").collect()]  # a file's findings


def scan_file(spark: SparkSession, path: str, mode: str = "quick", rules_dir: str = catalog.OWN) -> list[dict]:
    """Findings of one file; none if it can't be read."""
    try:
        found = corpus.source_files(spark, path, "*").select("code").first()
    except Exception:  # no such file, no right to read it, a store that isn't there
        return []
    return scan_code(spark, found.code, path, mode, rules_dir) if found else []


def scan_directory(spark: SparkSession, path: str, mode: str = "standard", vendor: bool = False, max_files: int | None = None, rules_dir: str = catalog.OWN) -> DataFrame:
    """Findings of all source files under a directory, with file_id as their path and seq as their order; other people's code is left out unless vendor. Only names below the directory count for that, not those of where it stands."""
    files = corpus.source_files(spark, path)
    if not vendor:
        root = path.split("://")[-1].rstrip("/")
        below = F.when(F.instr("path", root) > 0, F.expr("substring(path, _at)")).otherwise(F.col("path"))
        files = files.withColumn("_at", F.instr("path", root) + len(root)).withColumn("_below", below)
        files = corpus.without_vendor(files, path_col="_below").drop("_at", "_below")
    if max_files is not None:
        files = corpus.first_files(files, max_files)
    found = scan_full(files.selectExpr("path AS file_id", "path", "code"), mode, rules_dir)
    return found.withColumn("seq", F.col("line_no").cast("long"))


def file_facts(files: DataFrame, key: str = "file_id") -> DataFrame:
    """What a classifier is told of each variable of a file: (key, var, casts, checks) and how many of each, from the analyses of its lines."""
    from .functions import lines as L

    lines = L.explode_lines(files.select(key, "code"))
    c = context.casts(lines, key).groupBy(key, "var").agg(F.array_sort(F.collect_set("kind")).alias("casts"))
    w = context.whitelisted(lines, key).groupBy(key, "var").agg(F.array_sort(F.collect_set("kind")).alias("checks"))
    none = F.array().cast("array<string>")
    return c.join(w, [key, "var"], "full").select(key, "var", F.coalesce("casts", none).alias("casts"), F.coalesce("checks", none).alias("checks"))


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="spindrift")
    p.add_argument("path")
    p.add_argument("--mode", choices=MODES, default="standard")
    p.add_argument("--format", choices=("json", "text"), default="text")
    p.add_argument("--max-files", type=int)
    p.add_argument("--with-vendor", action="store_true")
    p.add_argument("--rules", default=catalog.OWN)
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("spindrift").getOrCreate()
    found = scan_directory(spark, a.path, a.mode, a.with_vendor, a.max_files, a.rules).cache()
    for row in found.orderBy("file_id", "line_no").toLocalIterator():
        if a.format == "json":
            print(reports.json_line(row.asDict()))
        else:
            print(f"{row.severity:8} {row.confidence:4.0%} {row.vuln_type:20} {row.file_id}:{row.line_no}  {row.code}")
    return found.agg(reports.exit_code()).first()[0]


#: Names of single analyses, for those who want one alone: lines in, rows out.
ANALYSES = {
    "assignments": taint.assigns, "sinks": taint.sink_hits, "multiline": taint.multiline, "includes": context.includes, "globals": context.globals_, "whitelists": context.whitelisted, "casts": context.casts, "dead_lines": context.dead_lines, "project_stats": stages.project_stats,
}


if __name__ == "__main__":
    sys.exit(main())
