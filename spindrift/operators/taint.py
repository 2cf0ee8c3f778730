"""Taint: sources, assignments and sinks of lines, and how taint reaches one from the other.

What is joined here grows with the corpus, and intermediate tables are much smaller in their files than in memory, so that
Spark would take them for small ones and send them to the driver. Joins are therefore by merging, whatever the sizes look like.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lines as L
from ..sources import catalog
from . import calls
from .graphs import cut

SOURCE = r"\$_(GET|POST|REQUEST|COOKIE)"


def assigns(lines: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, line_no, seq, lhs, rhs, source, func, cast): each line's first assignment to a variable."""
    at = r"^\s*\$(\w+)\s*=(?!=)\s*(.+?)\s*;"
    rhs = F.regexp_extract("text", at, 2)
    out = lines.select(key, "line_no", "seq", F.regexp_extract("text", at, 1).alias("lhs"), rhs.alias("rhs")).where("lhs <> ''")
    return out.withColumns(
        {
            "source": F.nullif(F.regexp_extract("rhs", SOURCE, 1), F.lit("")),
            "func": F.nullif(F.lower(F.regexp_extract("rhs", r"^(\w+)\s*\(", 1)), F.lit("")),
            "cast": F.col("rhs").rlike(r"(?i)^\((?:int|integer|float|double|bool|boolean)\)"),
        }
    )


def sanitising(func: Column) -> Column:
    """Whether a function makes a value harmless for any type: one of the catalog's, or one whose name says so."""
    return F.coalesce(func.isin(list(calls.sanitizers())) | func.rlike(calls.CUSTOM), F.lit(False))


def sink_hits(lines: DataFrame, key: str = "file_id", rules_dir: str = catalog.OWN) -> DataFrame:
    """(key, line_no, seq, text, var, vuln_type, severity): the variables that the catalog's sinks take, in the arguments that do harm. One pass over the lines, without a shuffle."""
    some = lines.where(calls.may_sink("text", rules_dir))
    return some.select(key, "line_no", "seq", "text", F.inline(calls.sink_variables("text", rules_dir)))


def seeds(assigned: DataFrame) -> DataFrame:
    """Assignments that take a source as it is, neither cast nor sanitised."""
    return assigned.where(F.col("source").isNotNull() & ~F.col("cast") & ~sanitising(F.col("func")))


def copies(assigned: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, line_no, lhs, rhs_var, clean): what an assignment's variable takes from which other."""
    taken = assigned.where("source IS NULL").select(key, "line_no", "lhs", F.explode(F.array_distinct(F.regexp_extract_all("rhs", F.lit(r"\$(\w+)"), 1))).alias("rhs_var"), (sanitising(F.col("func")) | F.col("cast")).alias("clean"))
    return taken


def closure(assigned: DataFrame, depth: int = 3, key: str = "file_id") -> DataFrame:
    """(key, var, line_no, origin, hops): variables that taint reaches from a source of the same file within depth copies.

    A variable's taint begins at its source, or at the first copy, not before the copied variable's own, that isn't
    sanitised. Each round joins the last round's variables only, from a written table, so that plans don't double.
    """
    first = seeds(assigned).groupBy(key, F.col("lhs").alias("var")).agg(F.min_by("source", F.struct("line_no", "seq")).alias("origin"), F.min("line_no").alias("line_no"))
    steps = copies(assigned, key).where("NOT clean").select(F.col(key).alias("k"), F.col("line_no").alias("l"), "lhs", "rhs_var")
    known = cut(first.select(key, "var", "line_no", "origin", F.lit(0).alias("hops")))
    fresh = known
    for hop in range(1, depth + 1):
        hit = (F.col("k") == F.col(key)) & (F.col("rhs_var") == F.col("var")) & (F.col("l") >= F.col("line_no"))
        reached = steps.join(fresh.hint("merge"), hit).groupBy(F.col("k").alias(key), F.col("lhs").alias("var")).agg(F.min_by("origin", F.struct("l", "rhs_var")).alias("origin"), F.min("l").alias("line_no"))
        fresh = cut(reached.join(known.select(key, "var").hint("merge"), [key, "var"], "left_anti").select(key, "var", "line_no", "origin", F.lit(hop).alias("hops")))
        known = known.unionByName(fresh)
    return known


def flows(tainted: DataFrame, sinks: DataFrame, key: str = "file_id") -> DataFrame:
    """Tainted variables in later sinks of their file: an equi-join on file and variable with a range of lines."""
    t = tainted.select(F.col(key).alias("k"), F.col("var").alias("v"), F.col("line_no").alias("source_line"), "origin", "hops")
    hit = (t["k"] == sinks[key]) & (t["v"] == sinks["var"]) & (sinks["line_no"] > t["source_line"])
    return sinks.join(t.hint("merge"), hit).drop("k", "v")


def flow_confidence(origin: Column, sanitized: Column, framework: Column, admin: Column) -> Column:
    d = lambda x: F.lit(float(x))
    c = d(0.75) + F.when(origin.isin("GET", "POST", "REQUEST"), d(0.1)).when(origin.endswith("_WRAP"), d(0.08)).otherwise(d(0))
    for flag, less in ((sanitized, 0.25), (framework, 0.1), (admin, 0.1)):
        c = c - F.when(flag, d(less)).otherwise(d(0))
    return F.least(c, d(1))


def backward(hits: DataFrame, assigned: DataFrame, depth: int = 7, step: int = 10, key: str = "file_id") -> DataFrame:
    """For each hit (key, line_no, var): tainted, sanitized, hops, by following assignments backwards.

    At depth d the lines from 10*d above the hit on are open; an assignment to a tracked variable adds the variables it
    takes. hops is the least depth at which a source is met, plus one. A hit sees the assignments of so many lines above
    it by one window, and all depths are steps of one expression over them: one shuffle, no rounds.
    """
    vars_ = F.array_distinct(F.regexp_extract_all("rhs", F.lit(r"\$([a-zA-Z]\w*)"), 1))
    one = F.struct(F.col("line_no").alias("l"), "lhs", F.col("source").isNotNull().alias("src"), sanitising(F.col("func")).alias("san"), vars_.alias("vars"))
    a = assigned.select(key, "line_no", one.alias("a"), F.lit(None).cast("array<string>").alias("tracked"))
    h = hits.groupBy(key, "line_no").agg(F.collect_set("var").alias("tracked")).select(key, "line_no", F.lit(None).cast(a.schema["a"].dataType).alias("a"), "tracked")
    w = Window.partitionBy(key).orderBy("line_no").rangeBetween(-step * (depth - 1), -1)
    seen = a.unionByName(h).withColumn("near", F.collect_list("a").over(w)).where("tracked IS NOT NULL")
    state = lambda tracked, tainted, sanitized, hops: F.struct(tracked.alias("tracked"), tainted.alias("tainted"), sanitized.alias("sanitized"), hops.alias("hops"))

    def deeper(s: Column, d: Column) -> Column:
        met = F.filter("near", lambda x: (x["l"] >= F.col("line_no") - d * step) & F.array_contains(s["tracked"], x["lhs"]))
        add = lambda m: state(
            F.array_union(s["tracked"], F.flatten(F.transform(m, lambda x: x["vars"]))), s["tainted"] | F.exists(m, lambda x: x["src"]), s["sanitized"] | F.exists(m, lambda x: x["san"]), F.when((s["hops"] == 0) & F.exists(m, lambda x: x["src"]), d + 1).otherwise(s["hops"])
        )
        return F.transform(F.array(met), add)[0]

    start = state(F.col("tracked"), F.lit(False), F.lit(False), F.lit(0))
    out = seen.withColumn("s", F.aggregate(F.sequence(F.lit(1), F.lit(depth - 1)), start, deeper))
    return out.select(key, "line_no", "s.tainted", "s.sanitized", "s.hops")


def sanitized_before(hits: DataFrame, assigned: DataFrame, key: str = "file_id") -> DataFrame:
    """hits with the variable's latest assignment before each hit, as of it: clean if that one sanitises. One sort, no range join."""
    a = assigned.select(key, "line_no", F.col("lhs").alias("var"), F.struct(F.col("line_no").alias("at"), (sanitising(F.col("func")) | F.col("cast")).alias("clean"), F.col("source").isNotNull().alias("dirty")).alias("state"), F.lit(0).alias("is_hit"))
    h = hits.select(key, "line_no", "var", F.lit(None).cast(a.schema["state"].dataType).alias("state"), F.lit(1).alias("is_hit"))
    w = Window.partitionBy(key, "var").orderBy("line_no", F.desc("is_hit")).rowsBetween(Window.unboundedPreceding, -1)
    both = a.unionByName(h).withColumn("last", F.last("state", ignorenulls=True).over(w))
    return both.where("is_hit = 1").select(key, "line_no", "var", F.col("last.at").alias("assigned_at"), F.coalesce("last.clean", F.lit(False)).alias("clean"), F.coalesce("last.dirty", F.lit(False)).alias("dirty"))


def multiline(lines: DataFrame, key: str = "file_id", assigned: DataFrame | None = None, sinks: DataFrame | None = None) -> DataFrame:
    """A source assignment and a sink of the same variable within the 15 lines that begin with it: (key, line_no, source_line, vuln_type, severity).

    assigned, sinks: those of lines, if they are known already."""
    first, last = L.FRAMES["multiline"]
    a = seeds(assigns(lines, key) if assigned is None else assigned).select(F.col(key).alias("k"), "lhs", F.col("line_no").alias("source_line"))
    s = sink_hits(lines, key) if sinks is None else sinks
    hit = (F.col("k") == F.col(key)) & (F.col("lhs") == F.col("var")) & F.col("line_no").between(F.col("source_line") + first, F.col("source_line") + last)
    found = s.join(a.hint("merge"), hit).where("line_no > source_line")
    return found.groupBy(key, "source_line", "var", "vuln_type").agg(F.min("line_no").alias("line_no"), F.max("severity").alias("severity"))
