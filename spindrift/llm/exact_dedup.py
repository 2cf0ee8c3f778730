"""Exact dedup by deterministic block naming.

Texts are cut into blocks of a fixed number of bytes. Distinct blocks are sorted and numbered, so that each has an
integer name; then adjacent pairs of names are named in the same way, again and again, until one name is left for
each document. Two texts of as many blocks have the same last name if and only if they are equal: names are given to
contents, not to hashes, so nothing can collide. Everything is a DataFrame expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written
from .shared import only_kept

BLOCK_BYTES = 4096
#: Names the second of a pair that has none.
NONE = -1


def _named(keys: DataFrame, name: str) -> DataFrame:
    """Each distinct row of keys with an integer name, by sorting. The table is written, so that names stay."""
    cols = keys.columns
    return written(keys.distinct().sortWithinPartitions(*cols).withColumn("name", F.monotonically_increasing_id()), name)


def _cut(raw: Column, n: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(raw, i * size + 1, F.lit(size)))


def _level0(src: DataFrame, size: int) -> DataFrame:
    """A row for each block of each row of src(id, raw): row, id, sha (with the first block alone), n, pos, name."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length("raw") / size)).cast("int")
    src = src.withColumn("n", n)
    blocks = src.select(F.explode(_cut(F.col("raw"), F.col("n"), size)).alias("block"))
    names = blocks.groupBy(F.xxhash64("block").alias("h"), "block").agg(F.lit(1).alias("one")).sortWithinPartitions("block")
    names = written(names.select("h", F.monotonically_increasing_id().alias("name")), "block-names")
    heads = src.select(
        F.monotonically_increasing_id().alias("row"),
        "id",
        F.sha2("raw", 256).alias("sha"),
        "n",
        F.transform(_cut(F.col("raw"), F.col("n"), size), lambda b: F.xxhash64(b)).alias("hs"),
    )
    heads = written(heads, "block-heads")
    at = heads.select("row", "id", "sha", "n", F.posexplode("hs").alias("pos", "h"))
    at = at.withColumn("sha", F.when(F.col("pos") == 0, F.col("sha")))
    twice = names.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
    if twice.isEmpty():  # each hash has one content, as good as always: blocks find their name by it alone
        return at.join(names, "h").select("row", "id", "sha", "n", "pos", "name")
    raw = src.select(F.monotonically_increasing_id().alias("row"), "id", F.sha2("raw", 256).alias("sha"), "n", _cut(F.col("raw"), F.col("n"), size).alias("blocks"))
    raw = written(raw, "blocks").select("row", "id", "sha", "n", F.posexplode("blocks").alias("pos", "block"))
    raw = raw.withColumn("sha", F.when(F.col("pos") == 0, F.col("sha")))
    return raw.join(_named(raw.select("block"), "block-names"), "block").select("row", "id", "sha", "n", "pos", "name")


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of docs: row, id, sha (of the text's UTF-8), n (blocks) and name; (n, name) identifies the text."""
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("raw"))
    now = written(_level0(src, block_bytes).withColumn("left_over", F.col("n")), "names-0")
    done = now.where("n = 1")
    most = now.agg(F.max("n")).first()[0] or 1
    level = 0
    while most > 1:
        level += 1
        even = F.col("pos") % 2 == 0
        pairs = now.where("left_over > 1").groupBy("row", "n", F.shiftright("pos", 1).alias("pos"), F.expr("(left_over + 1) div 2").cast("int").alias("left_over"))
        pairs = pairs.agg(F.max("id").alias("id"), F.max("sha").alias("sha"), F.max(F.when(even, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(NONE)).alias("b"))
        pairs = written(pairs, f"pairs-{level}")
        names = _named(pairs.select("a", "b"), f"pair-names-{level}")
        now = written(pairs.join(names, ["a", "b"]).select("row", "id", "sha", "n", "pos", "name", "left_over"), f"names-{level}")
        done = done.unionByName(now.where("left_over = 1"))
        most = (most + 1) // 2
    return done.select("row", "id", "sha", "n", "name")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Groups of equal texts: one row for each row of docs, with keep_id, group_size, kept and text_sha256.

    Of equal texts the row with the largest id stays (a null id is the smallest); of rows that repeat an id and a text,
    the first in the input. A null text counts as empty, and empty texts are equal. Other columns of docs are ignored,
    whatever their names. Long texts are many blocks, which are rows of their own. An empty table gives an empty result.
    """
    rows = identities(docs, id_col, text_col, block_bytes)
    groups = rows.groupBy("n", "name").agg(F.max(F.struct("id", (-F.col("row")).alias("back"))).alias("top"), F.count("*").alias("group_size"))
    groups = groups.select("n", "name", F.col("top.id").alias("keep_id"), F.col("top.back").alias("back"), "group_size")
    out = rows.join(written(groups, "exact-groups"), ["n", "name"])  # written, so that the join can split a large group
    return out.select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("row") == -F.col("back")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns."""
    found = exact_dedup(docs, id_col, text_col)
    return only_kept(docs, found.select(F.col(id_col).alias("id"), F.col("text_sha256").alias("sha"), "kept"), id_col, text_col)
