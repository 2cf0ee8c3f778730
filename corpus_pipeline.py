"""The corpus pipeline: stages over `documents`, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from spindrift.llm import exact_dedup, packing, simhash, toxicity
from spindrift.llm.queries import VOCABULARY
from spindrift.llm.shared import table
from spindrift.sources.tables import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold stay; labels are learned from rows that aren't held out.

    Null and empty texts are scored as texts without features, and stay. Rows that repeat stay or go together. All columns
    stay as they are, whatever their names; an empty table stays empty.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id stays.

    A null text counts as empty, and one of all empty ones stays; a null id is the smallest. Of rows that repeat id and
    text, the one whose columns as JSON are least stays. Columns may have any names; an empty table stays empty.
    """
    return exact_dedup.drop_exact(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked fingerprints, the document with the smallest doc_id stays.

    Texts without words have fingerprint zero and are one component. Null ids are passed over where others are. Of rows
    that share the id, that of the least SHA-256 stays. Columns may have any names; an empty table stays empty.
    """
    return simhash.drop_near(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left, in sequences.

    A null or empty text is one id, that of its end. Rows that repeat are packed each. Other columns are left out; an
    empty table gives no pieces.
    """
    return packing.pack(docs, public_tokenizers.path(VOCABULARY))


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_exact), ("near dedup", drop_near), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each on what the one before has left."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


#: None: SQL can't express the classifier, the fingerprints or the packing.
ORACLE_SQL = None
