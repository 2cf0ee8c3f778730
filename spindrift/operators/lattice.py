"""The taint lattice and set-valued cells, as expressions. Levels: 0 bottom, 1 untainted, 2 weak, 3 tainted, 4 top."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOP = 4


def join(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def meet(a: Column, b: Column) -> Column:
    return F.least(a, b)


def widen(old: Column, new: Column) -> Column:
    """What grows goes to the top, so that loops end."""
    return F.when(new > old, F.lit(TOP)).otherwise(old)


def active(types: Column, sanitized: Column) -> Column:
    """Taint types that aren't sanitised, sorted."""
    return F.array_sort(F.array_except(types, sanitized))


def merge(a: DataFrame, b: DataFrame, key: str = "var") -> DataFrame:
    """Two states at a join point (key, level, types, sanitized): the higher level, types of either, sanitised in both. A
    variable that one state lacks is taken as it is in the other."""
    x, y = a.alias("x"), b.alias("y")
    both = x.join(y, F.col(f"x.{key}") == F.col(f"y.{key}"), "full")
    pick = lambda c: F.coalesce(f"x.{c}", f"y.{c}")
    types = F.array_sort(F.array_union(F.coalesce("x.types", F.array().cast("array<string>")), F.coalesce("y.types", F.array().cast("array<string>"))))
    san = F.when(F.col("x.sanitized").isNull() | F.col("y.sanitized").isNull(), pick("sanitized")).otherwise(F.array_intersect("x.sanitized", "y.sanitized"))
    return both.select(pick(key).alias(key), F.greatest("x.level", "y.level").alias("level"), types.alias("types"), F.array_sort(san).alias("sanitized"))


#: Types of values, and which of them can't carry an injection.
TYPES = ["BOTTOM", "NULL", "BOOL", "INT", "FLOAT", "STRING", "ARRAY", "OBJECT", "RESOURCE", "CALLABLE", "MIXED"]
HARMLESS = {"SQL_INJECTION": ["BOTTOM", "NULL", "BOOL", "INT", "FLOAT"], "XSS": ["BOTTOM", "NULL", "BOOL", "INT", "FLOAT"], "COMMAND_INJECTION": ["BOTTOM", "NULL", "BOOL", "INT", "FLOAT"]}


def type_safe(types: Column, vuln_type: Column) -> Column:
    """Whether every type that a value may have is harmless; never for other kinds, nor for an unknown value."""

    def all_in(good: list[str]) -> Column:
        return (F.size(types) > 0) & F.forall(types, lambda t: t.isin(good))

    out = F.lit(False)
    for v, good in HARMLESS.items():
        out = F.when(vuln_type == v, all_in(good)).otherwise(out)
    return out


def complement(asserted: Column) -> Column:
    return F.array_sort(F.array_except(F.array(*map(F.lit, TYPES[1:-1])), asserted))


def sink_position(prefix: Column, vuln_type: Column) -> Column:
    """How exposed a tainted fragment is, by the literal text before it."""
    sql = F.when(prefix.rlike(r"(?i)\b(?:where|and|or|having|set|values)\b[^;]*$"), "high").when(prefix.rlike(r"(?i)\b(?:from|into|table|join)\s*$"), "medium").otherwise("low")
    xss = F.when(prefix.rlike(r"<!--[^>]*$"), "safe").when(prefix.rlike(r"(?i)<script[^>]*>[^<]*$|<[a-z][^>]*=\s*[\"']?[^\"'>]*$"), "high").otherwise("medium")
    cmd = F.when(F.trim(prefix) == "", "high").when(prefix.rlike(r"\s$"), "medium").otherwise("low")
    return F.when(vuln_type == "SQL_INJECTION", sql).when(vuln_type == "XSS", xss).when(vuln_type == "COMMAND_INJECTION", cmd).otherwise("medium")


def first_tainted_prefix(fragments: Column) -> Column:
    """Of fragments (value, tainted), the literal text before the first tainted one; of all if none is."""
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("done"))
    step = lambda acc, f: F.struct(F.when(acc["done"] | f["tainted"], acc["text"]).otherwise(F.concat(acc["text"], F.coalesce(f["value"], F.lit("")))).alias("text"), (acc["done"] | f["tainted"]).alias("done"))
    return F.aggregate(fragments, start, step)["text"]
