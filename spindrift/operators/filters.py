"""Pluggable filters of findings, by name, and a hook for an outside verifier."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Filter = Callable[[DataFrame], DataFrame]
REGISTRY: dict[str, Filter] = {}


def register(name: str) -> Callable[[Filter], Filter]:
    def put(f: Filter) -> Filter:
        REGISTRY[name] = f
        return f

    return put


@register("none")
def keep_all(findings: DataFrame) -> DataFrame:
    return findings


@register("binary")
def binary(findings: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Drops findings that a model is sure about: ml_score at most 1 - threshold."""
    return findings.where(F.coalesce(F.col("ml_score"), F.lit(1.0)) > 1 - threshold)


@register("multiclass")
def multiclass(findings: DataFrame, least: float = 0.8) -> DataFrame:
    """Drops findings whose most likely class is SAFE with at least this probability."""
    return findings.where(~((F.col("ml_class") == "SAFE") & (F.col("ml_prob") >= least)) | F.col("ml_class").isNull())


@register("flow")
def flow(findings: DataFrame) -> DataFrame:
    """Drops findings with neither a source nor a verified flow."""
    return findings.where(F.col("source").isNotNull() | F.coalesce("verified", F.lit(False)))


def create(name: str) -> Filter:
    if name not in REGISTRY:
        raise KeyError(f"no filter {name!r}; there are {', '.join(sorted(REGISTRY))}")
    return REGISTRY[name]


def verified(findings: DataFrame, verify: Callable[[list[dict]], list[bool | None]], batch: int = 16) -> DataFrame:
    """findings with is_real by an outside verifier, a batch at a time on the executors. It fails open: null where it errs."""
    names = findings.columns

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            rows, said = b.to_pylist(), []
            for k in range(0, len(rows), batch):
                try:
                    said += verify(rows[k : k + batch])
                except Exception:  # whatever the verifier raises, findings stay
                    said += [None] * len(rows[k : k + batch])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(said, pa.bool_())], [*names, "is_real"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in findings.schema)
    return findings.mapInArrow(run, schema + ", is_real boolean")


def verifier_cost(findings: DataFrame, per_finding: int = 800, per_million: float = 3.0) -> DataFrame:
    """(findings, tokens, cost) that a verifier that is paid by tokens would take."""
    n = F.count("*")
    return findings.agg(n.alias("findings"), (n * per_finding).alias("tokens"), (n * per_finding * F.lit(per_million) / F.lit(1e6)).alias("cost"))


def per_type_blend(type_score, ensemble_score, least: float = 0.25):
    """A type's own model weighs .6 where there is one; kept from least on: (score, kept)."""
    s = F.when(type_score.isNull(), ensemble_score).otherwise(F.lit(0.6) * type_score + F.lit(0.4) * ensemble_score)
    return F.struct(s.alias("score"), (s >= least).alias("kept"))
