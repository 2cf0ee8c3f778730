"""Dedup, ranking and top-k of findings. Every tie is broken by seq, the order in which findings are made."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.score import severity_rank
from ..sources.tables import written


def best(findings: DataFrame, keys: list[str], value: str = "confidence") -> DataFrame:
    """Of each group the row of the highest value, the first of equals."""
    w = Window.partitionBy(*keys).orderBy(F.desc(value), "seq")
    return findings.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def first(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Of each group the first row."""
    w = Window.partitionBy(*keys).orderBy("seq")
    return findings.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def merged(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Of each group the row of the highest confidence, in the place of the first."""
    at = findings.groupBy(*keys).agg(F.max_by(F.struct("*"), F.struct("confidence", -F.col("seq"))).alias("r"), F.min("seq").alias("place"))
    return at.select("r.*", "place")


def top_per_type(findings: DataFrame, n: int = 3, group: tuple[str, ...] = ("file_id", "vuln_type")) -> DataFrame:
    """The n of highest confidence in each group, and all critical ones."""
    w = Window.partitionBy(*group).orderBy(F.desc("confidence"), "seq")
    return findings.withColumn("rn", F.row_number().over(w)).where((F.col("rn") <= n) | (F.col("severity") == "CRITICAL")).drop("rn")


def ranked(findings: DataFrame) -> DataFrame:
    """With pos: by severity, then confidence, then seq.

    Rows are range-partitioned by the whole order and sorted within partitions, and written, so that partitions stay; a
    row's place is its place in its partition and the sizes of those before. So one severity may fill many partitions.
    """
    r = findings.withColumn("severity_rank", severity_rank(F.col("severity")))
    order = [F.desc("severity_rank"), F.desc("confidence"), F.asc("seq")]
    r = r.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    r = written(r, "ranked").withColumns({"_part": F.shiftright("_at", 33), "_row": F.col("_at").bitwiseAND((1 << 33) - 1)})
    sizes = r.groupBy("_part").agg(F.count("*").alias("_n"))  # a row for each partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return r.join(sizes, "_part").withColumn("pos", F.col("_row") + F.col("_before") + 1).drop("_at", "_part", "_row", "_before")


def first_per_severity(findings: DataFrame, n: int = 10) -> DataFrame:
    w = Window.partitionBy("severity").orderBy("seq")
    return findings.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)
