"""The rule catalog: YAML files of a directory, as typed tables. Rule sets are of bounded size, and may be broadcast."""

from __future__ import annotations

import os
from functools import lru_cache

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OWN = os.path.join(os.path.dirname(os.path.dirname(__file__)), "rules")
SCHEMAS = {
    "sources": "name string, group string, level string, live boolean",
    "sinks": "name string, group string, vuln_type string, severity string, cwe string, arg int",
    "sanitizers": "name string, group string, strength string, protects array<string>",
    "patterns": "vuln_type string, severity string, cwe string, regex string",
    "fp_rules": "name string, category string, regex string, applies_to array<string>",
    "frameworks": "name string, detect array<string>",
}


@lru_cache
def rows(name: str, rules_dir: str = OWN) -> list[dict]:
    """A rule set, a row for each rule. A rule that has `calls` (name to argument) or `names` stands for one of each."""
    with open(os.path.join(rules_dir, f"{name}.yml"), encoding="utf-8") as f:
        found = yaml.safe_load(f) or []
    out = []
    for r in found:
        shared = {k: v for k, v in r.items() if k not in ("calls", "names")}
        if "calls" in r:
            out += [{**shared, "name": n, "arg": arg} for n, arg in r["calls"].items()]
        elif "names" in r:
            out += [{**shared, "name": n} for n in r["names"]]
        else:
            out.append(shared)
    return out


def catalog(spark: SparkSession, name: str, rules_dir: str = OWN) -> DataFrame:
    """A rule set with ord, its order in the file; fields that a row lacks are null."""
    fields = [f.split()[0] for f in SCHEMAS[name].split(", ")]
    return spark.createDataFrame([(i, *(r.get(f) for f in fields)) for i, r in enumerate(rows(name, rules_dir))], "ord int, " + SCHEMAS[name])


def sinks_of(spark: SparkSession, vuln_type: str | None = None, rules_dir: str = OWN) -> DataFrame:
    return catalog(spark, "sinks", rules_dir).where(F.lit(vuln_type is None) | (F.col("vuln_type") == vuln_type))


def sanitizers_for(spark: SparkSession, vuln_type: str, rules_dir: str = OWN) -> DataFrame:
    return catalog(spark, "sanitizers", rules_dir).where(F.array_contains("protects", vuln_type))


def sources(spark: SparkSession, live: bool = True, rules_dir: str = OWN) -> DataFrame:
    """Sources that a scan asks for, or, with live=False, all of them."""
    return catalog(spark, "sources", rules_dir).where(F.col("live") | F.lit(not live))


def patterns_of(spark: SparkSession, vuln_type: str | None = None, rules_dir: str = OWN) -> DataFrame:
    return catalog(spark, "patterns", rules_dir).where(F.lit(vuln_type is None) | (F.col("vuln_type") == vuln_type))


def fp_rules_for(spark: SparkSession, vuln_type: str, rules_dir: str = OWN) -> DataFrame:
    """False-positive rules that apply to a type: those that name it, and those that name none."""
    return catalog(spark, "fp_rules", rules_dir).where((F.coalesce(F.size("applies_to"), F.lit(0)) <= 0) | F.array_contains("applies_to", vuln_type))


def frameworks(spark: SparkSession, rules_dir: str = OWN) -> DataFrame:
    return catalog(spark, "frameworks", rules_dir)


def is_sink(spark: SparkSession, name: str, rules_dir: str = OWN) -> bool:
    return any(r["name"].lower() == name.lower() for r in rows("sinks", rules_dir))


def severity_of(vuln_type: str, rules_dir: str = OWN) -> str | None:
    """The highest severity that a sink of the type has, or null."""
    order = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
    return max((r["severity"] for r in rows("sinks", rules_dir) if r["vuln_type"] == vuln_type), key=order.index, default=None)


def cwe_of(vuln_type: str, rules_dir: str = OWN) -> str | None:
    """The first CWE that a sink or a pattern of the type has, or null."""
    return next((r["cwe"] for name in ("sinks", "patterns") for r in rows(name, rules_dir) if r["vuln_type"] == vuln_type), None)


def stats(spark: SparkSession, rules_dir: str = OWN) -> DataFrame:
    """(rule_set, n) of all rule sets."""
    return spark.createDataFrame([(name, len(rows(name, rules_dir))) for name in SCHEMAS], "rule_set string, n int")
