"""Small derivations from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def preview(text: Column, n: int = 100) -> Column:
    return F.substring(stripped(text), 1, n)


def percent(confidence: Column) -> Column:
    """As text; halves go to the even number."""
    return F.concat(F.bround(confidence * 100).cast("int").cast("string"), F.lit("%"))


def type_of_pattern(name: Column) -> Column:
    return F.substring_index(name, "_", 2)


def rule_id(vuln_type: Column) -> Column:
    return F.upper(F.replace(vuln_type, F.lit(" "), F.lit("_")))


def cwe_url(cwe: Column) -> Column:
    return F.concat(F.lit("https://cwe.mitre.org/data/definitions/"), F.split_part(cwe, F.lit("-"), F.lit(2)), F.lit(".html"))


def normal_variable(name: Column) -> Column:
    return F.translate(name, '" ', "'")


def array_key(access: Column) -> Column:
    return F.regexp_extract(access, r"""\[\s*['"]?(\w+)['"]?\s*\]""", 1)


def normal_path(path: Column) -> Column:
    """With . and .. segments folded; a leading / stays, and .. can't climb above it."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    empty = F.array().cast("array<string>")
    last = lambda a: F.element_at(a, -1)
    rooted = path.startswith("/")
    fold = lambda a, x: F.when((x == "..") & (F.size(a) > 0) & (last(a) != ".."), F.slice(a, 1, F.size(a) - 1)).when((x == "..") & rooted, a).otherwise(F.concat(a, F.array(x)))
    folded = F.array_join(F.aggregate(parts, empty, lambda a, x: F.when(F.size(a) == 0, F.when((x == "..") & rooted, a).otherwise(F.array(x))).otherwise(fold(a, x))), "/")
    return F.when(rooted, F.concat(F.lit("/"), folded)).otherwise(folded)


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)
