"""What the operators of this subpackage share: reading inputs, batches for Python, and which rows stay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import written


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows, and bytes, that a Python function works on at a time.
ROWS, BYTES = 256, 4 << 20


def rows_of(batches, rows: int = ROWS, size: int = BYTES):
    """Arrow batches of so many rows and bytes at most (one row at least), cut out of larger ones without copying."""
    for b in batches:
        todo = [b]
        while todo:
            b = todo.pop()
            if b.num_rows > 1 and (b.num_rows > rows or b.nbytes > size):
                half = b.num_rows // 2
                todo += [b.slice(half), b.slice(0, half)]
            elif b.num_rows:
                yield b


def text_sha(text_col: str):
    """SHA-256 of the text's UTF-8, null as empty."""
    return F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)


def only_kept(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs, with all columns, that stay. found: id, sha (of the text) and kept, a row for each row of docs.

    Rows are told apart by id and text, as scans needn't number rows alike. Of rows that repeat both, one stays if any
    does: the one whose columns as JSON are least. Whole rows are carried as one struct, so no name of a column can clash.
    """
    sums = found.groupBy("id", "sha").agg(F.count_if("kept").alias("k"), F.count("*").alias("c"))
    sums = written(sums.where("k = 0 or c > 1"), "kept-sums")
    same = lambda a, b: a["id"].eqNullSafe(b["id"]) & (a["sha"] == b["sha"])
    gone, many = sums.where("k = 0"), sums.where("k > 0")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    out = docs.select(F.col(id_col).alias("id"), text_sha(text_col).alias("sha"), whole.alias("whole"))
    out = out.join(gone, same(out, gone), "left_anti")
    if not many.isEmpty():
        again = out.join(many, same(out, many), "left_semi")
        firsts = again.groupBy("id", "sha").agg(F.min_by("whole", F.to_json("whole")).alias("whole"))
        out = out.join(many, same(out, many), "left_anti").select("whole").unionByName(firsts.select("whole"))
    return out.select("whole.*")
