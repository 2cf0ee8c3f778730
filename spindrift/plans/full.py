"""The scan of a whole project: lines and flows of files, and what only shows across functions and files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lines as L
from ..functions import score as S
from ..functions import text as T
from ..operators import context, programs, ranking, summaries, taint
from ..operators.graphs import cut
from ..sources import catalog
from .scan import scan

#: What each mode adds to the one before: lines and flows; the front end and calls; globals across files.
MODES = ("quick", "standard", "deep")
CALL_CONFIDENCE = 0.85
COLUMNS = ["file_id", "line_no", "vuln_type", "severity", "confidence", "source", "sanitizers", "code", "stage"]


def interprocedural(files: DataFrame, rules_dir: str = catalog.OWN, lines: DataFrame | None = None) -> DataFrame:
    """(file_id, line, vuln_type, callee, source, confidence): sources that reach a sink through values that calls hand in or out, not made harmless for its type.

    callee is the function called at the line, null where the sink itself stands there. A call means the function of its
    own file, or else those of that name in other files. lines: those of files, if they are known already.
    """
    lines = L.explode_lines(files.select("file_id", "code")) if lines is None else lines
    found = summaries.findings(summaries.program(lines, rules_dir=rules_dir))
    file = F.regexp_extract("func", r"(?s)^(.*):[^:]*$", 1).cast(files.schema["file_id"].dataType)
    return found.select(file.alias("file_id"), F.col("line_no").alias("line"), "vuln_type", F.element_at(F.split("callee", ":"), -1).alias("callee"), "source", F.lit(CALL_CONFIDENCE).alias("confidence")).distinct()


def across_files(files: DataFrame, lines: DataFrame) -> DataFrame:
    """(source_file, sink_file, name, line_no, vuln_type, severity, confidence): globals that one file taints and another's sink takes, where an include, at any distance, makes them see each other."""
    refs = context.includes(lines).join(files.select("file_id", "path"), "file_id").select("path", "ref")
    edges = context.include_edges(refs, files.select("path")).groupBy("src", "dst").agg(F.max("is_resolved").alias("is_resolved"))
    paths = files.select("file_id", "path")
    tainted = context.globals_(lines).where("tainted").join(paths, "file_id").select(F.col("path").alias("file"), "name", F.lit(True).alias("direct"))
    taken = context.globals_(lines).select("file_id", "name").distinct()
    sinks = taint.sink_hits(lines).join(taken.withColumnRenamed("name", "var"), ["file_id", "var"]).join(paths, "file_id")
    flows = context.cross_file_flows(edges, tainted, sinks.select(F.col("path").alias("file"), F.col("var").alias("name")))
    at = sinks.select(F.col("path").alias("sink_file"), F.col("var").alias("name"), "line_no", "vuln_type", "severity").distinct()
    return flows.join(at, ["sink_file", "name"])


def scan_full(files: DataFrame, mode: str = "standard", rules_dir: str = catalog.OWN) -> DataFrame:
    """files (file_id, path, code) to findings as `scan` makes them, with what the mode adds; of equal file, line and type the surest stays.

    Files that the front end fails on have the findings of their lines; `programs.failed` lists them.
    """
    if mode not in MODES:
        raise ValueError(f"mode is one of {', '.join(MODES)}, not {mode!r}")
    found = scan(files, rules_dir).select(*COLUMNS)
    if mode == "quick":
        return found
    none = F.array().cast("array<string>")
    lines = cut(L.explode_lines(files.select("file_id", "code")).withColumn("seq", F.col("line_no").cast("long")))
    of = lines.select("file_id", "line_no", T.preview(F.col("text")).alias("code"))
    walked = programs.findings(files, rules_dir=rules_dir).where("source NOT LIKE 'param:%'").select("file_id", F.col("line").alias("line_no"), "vuln_type", "confidence", "source", F.lit("program").alias("stage"))
    called = interprocedural(files, rules_dir, lines).select("file_id", F.col("line").alias("line_no"), "vuln_type", "confidence", "source", F.lit("call").alias("stage"))
    more = walked.unionByName(called).withColumn("severity", S.program_severity(F.col("vuln_type"), F.col("confidence")))
    if mode == "deep":
        paths = files.select("file_id", F.col("path").alias("sink_file"))
        far = across_files(files, lines).join(paths, "sink_file")
        more = more.unionByName(far.select("file_id", "line_no", "vuln_type", "confidence", F.concat(F.lit("global:"), "name", F.lit("@"), "source_file").alias("source"), F.lit("files").alias("stage"), "severity"))
    more = more.where("confidence >= 0.6").join(of, ["file_id", "line_no"]).withColumn("sanitizers", none).select(*COLUMNS)
    order = F.create_map(*[F.lit(x) for k, s in enumerate(("pattern", "window", "file", "program", "call", "files")) for x in (s, k)])
    every = found.unionByName(more).withColumn("seq", F.col("line_no").cast("long") * 8 + order[F.col("stage")])
    return ranking.best(every, ["file_id", "line_no", "vuln_type"]).select(*COLUMNS)
