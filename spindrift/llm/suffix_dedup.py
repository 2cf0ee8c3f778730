"""Removal of repeated byte strings by a radix sort of suffixes that goes no deeper than the threshold.

Suffixes are sorted by their first WIDTH bytes alone, most significant digit first; those that are still together after
the last pass are the windows that repeat. A window's first digit is a gram of it, the one of GRAM bytes whose hash is
least: it depends on the window's bytes alone, so equal windows have it in common, and neighbouring windows mostly have,
so that windows next to each other with the same gram are sorted as one piece. Each further pass (BLOCKS) cuts pieces by
where in the window the gram stands, and its digit is all that the cut windows have in common, more and more bytes until
the last pass has single windows and all of their bytes. In each pass

* pieces whose digit no other piece has are left out: nothing in them repeats;
* pieces that are equal as a whole repeat as a whole; one of them goes on, for the sake of others;
* what else shares its digit goes on to the next pass.

Places within text are carried as numbers, and pieces as 128 bits of BLAKE2b or SHA-256; nothing is told equal by a weaker
hash. Groups are counted, never gathered, and each row is joined to one row for its group.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import dropped, written
from .line_dedup import Stream, probable, text_bytes
from .shared import rows_of

#: Bytes of a string that is removed if it repeats; of the gram that is its first digit.
WIDTH, GRAM = 200, 64
#: Places of the gram that windows of a piece have in common, pass by pass.
BLOCKS = (32, 8, 1)
#: Bytes that are looked at together.
_PART = 1 << 18
_AT = (1 << 31) - 1
_U = np.uint64


def _cut(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts (bytes, one after the other, and where each begins and the last one ends): for each piece its text, the
    place of its first byte, how many windows it has, where from there its gram begins, the gram's hash."""
    n, wide = len(raw), WIDTH - GRAM + 1
    hashes = Stream(raw.astype(_U) + _U(1)).runs(np.arange(n - GRAM + 1), np.arange(GRAM, n + 1))
    least, size = (hashes & ~_U(_AT)) | np.arange(len(hashes), dtype=_U), 1
    while 2 * size <= wide:  # the least of each window, by doubling
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    least = np.minimum(least[: n - WIDTH + 1], least[wide - size :][: n - WIDTH + 1])
    chosen = (least & _U(_AT)).astype(np.int64)
    count = np.maximum(np.diff(at) - WIDTH + 1, 0)  # windows of each text
    text = np.repeat(np.arange(len(count)), count)
    here = np.arange(len(text)) - (np.cumsum(count) - count)[text] + at[:-1][text]  # windows that lie within one text
    chosen = chosen[here]
    new = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (here[1:] != here[:-1] + 1)])[: len(here)])
    first = here[new]
    return text[new], first, np.diff(np.concatenate([new, [len(here)]])), chosen[new] - first, hashes[chosen[new]]


def pieces(texts: pa.StringArray) -> tuple[np.ndarray, ...]:
    """text, first byte (within the text), windows, gram's place and hash, and digest (two numbers) of each piece of all texts."""
    raw, at = text_bytes(texts)
    parts = []
    for low in range(0, len(raw), _PART):  # windows that begin here; a piece that is cut by this is two pieces
        high = min(len(raw), low + _PART + WIDTH - 1)
        if high - low < WIDTH:
            break
        t0, t1 = int(np.searchsorted(at, low, "right")) - 1, int(np.searchsorted(at, high, "left"))
        text, first, count, gram_at, gram = _cut(raw[low:high], np.clip(at[t0 : t1 + 1], low, high) - low)
        parts.append((text + t0, first + low, count, gram_at, gram))
    text, first, count, gram_at, gram = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, t) for t in (np.int64, np.int64, np.int64, np.int64, _U))
    view = memoryview(np.ascontiguousarray(raw))
    digests = b"".join([hashlib.blake2b(view[a:z], digest_size=16).digest() for a, z in zip(first.tolist(), (first + count + WIDTH - 1).tolist(), strict=True)])
    both = np.frombuffer(digests, np.int64).reshape(-1, 2)
    return text, first - at[text], count, gram_at, gram, both[:, 0], both[:, 1]


def _bytes(n: Column) -> Column:
    return n + (WIDTH - 1)


def _key(raw: Column) -> Column:
    """128 bits of the bytes' SHA-256: what is compared and shuffled in their place."""
    return F.substring(F.unhex(F.sha2(raw, 256)), F.lit(1), F.lit(16))


def _split(parts: DataFrame, block: int) -> DataFrame:
    """Pieces cut by where the gram stands, numbered, with a digit, which is what all windows of the block have in common, and whole, all that they cover; the bytes are kept for a next pass."""
    low, high = F.col("gram_at") - F.col("n") + 1, F.col("gram_at")
    blocks = F.sequence(F.call_function("div", low, F.lit(block)), F.call_function("div", high, F.lit(block)))
    parts = parts.select("*", F.explode(blocks).alias("block")).withColumn("block", F.col("block").cast("int"))
    last = F.least(F.col("gram_at"), F.col("block") * block + (block - 1))
    first = F.greatest(F.col("gram_at") - F.col("n") + 1, F.col("block") * block)
    parts = parts.withColumn("skip", F.col("gram_at") - last).withColumn("n", last - first + 1)
    raw = F.substring(F.col("raw"), F.col("skip") + 1, _bytes(F.col("n")))
    parts = parts.select("gram", "block", "row", (F.col("a") + F.col("skip")).alias("a"), "n", (F.col("gram_at") - F.col("skip")).alias("gram_at"), "c", raw.alias("raw"))
    digit = F.substring("raw", F.col("gram_at") - F.col("block") * block + 1, F.lit(WIDTH - block + 1))
    parts = parts.withColumn("whole", _key(F.col("raw")))
    parts = parts.withColumn("digit", _key(digit)) if block > 1 else parts.drop("raw")
    return parts.withColumn("id", F.monotonically_increasing_id())


def _passes(parts: DataFrame) -> list[DataFrame]:
    """Spans (row, a, z) of windows that repeat, from pieces (gram, row, a, n, gram_at, c, raw). c: places that the piece stands for; those of several have been told already."""
    spans = []
    for block in BLOCKS:
        now = written(_split(parts, block), f"pieces-{block}")
        group = ["gram", "block", "digit"] if block > 1 else ["gram", "block"]
        equal = now.groupBy(*group, "whole").agg(F.min("id").alias("id"), F.sum("c").alias("c"))
        equal = written(equal if block > 1 else equal.where("c > 1"), f"equal-pieces-{block}")
        more = equal.where("c > 1").select(*group, "whole")
        alone = now.where("c = 1").select(*group, "whole", "row", "a", "n")
        spans.append(alone.join(more.hint("shuffle_hash"), [*group, "whole"], "left_semi").select("row", "a", (F.col("a") + _bytes(F.col("n"))).alias("z")))
        if block > 1:
            open_ = equal.groupBy(*group).agg(F.count("*").alias("k"), F.count_if(F.col("c") == 1).alias("ones")).where("k > 1 and ones > 0").select(*group)
            going = written(equal.join(written(open_, f"open-{block}").hint("shuffle_hash"), group, "left_semi").select("id", "c"), f"going-{block}")
            parts = probable(now.drop("c", "block", "digit", "whole"), going, "id").where("maybe").join(going, "id").drop("id", "maybe")
    return spans


def repeated(base: DataFrame) -> DataFrame:
    """(row, spans): of rows of base (row, id, text) in which any window repeats, the places of repeated bytes, array<struct<a, z>>."""

    def first_digits(batches):
        for b in rows_of(batches):
            text, a, n, gram_at, gram, *digest = pieces(b.column(1))
            columns = [gram.view(np.int64), *digest, *(x.astype(np.int32) for x in (a, n, gram_at))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(text)), *map(pa.array, columns)], ["row", "gram", "d1", "d2", "a", "n", "gram_at"])

    found = base.select("row", "text").mapInArrow(first_digits, "row long, gram long, d1 long, d2 long, a int, n int, gram_at int")
    found = written(found, "first-digits")
    counts = found.groupBy("gram").agg(F.count("*").alias("c"), (F.min("d1") != F.max("d1")).alias("many")).where("c > 1")
    counts = written(counts.select("gram", "many"), "recurring-digits")
    again = written(probable(found, counts, "gram").where("maybe").drop("maybe").join(counts.hint("shuffle_hash"), "gram"), "recurring-pieces")
    dropped(found)
    keys = ["gram", "d1", "d2"]
    firsts = again.groupBy(*keys).agg(F.min(F.struct("row", "a", "n", "gram_at")).alias("first"), F.count("*").alias("c"), F.max("many").alias("many"))
    firsts = written(firsts.where("c > 1 or many"), "first-pieces")
    spans = [again.join(firsts.where("c > 1").select(*keys).hint("shuffle_hash"), keys, "left_semi").select("row", "a", (F.col("a") + _bytes(F.col("n"))).alias("z"))]
    wanted = firsts.where("many").groupBy("first.row").agg(F.collect_list(F.struct("gram", "first.a", "first.n", "first.gram_at", "c")).alias("own"))
    wanted = written(wanted, "open-pieces")
    raw = F.col("text").cast("binary")
    texts = probable(base, wanted, "row").where("maybe").join(wanted, "row")
    of = lambda x: F.struct(x["gram"].alias("gram"), x["a"].alias("a"), x["n"].alias("n"), x["gram_at"].alias("gram_at"), x["c"].alias("c"), F.substring(raw, x["a"] + 1, _bytes(x["n"])).alias("raw"))
    parts = texts.select("row", F.inline(F.transform("own", of)))
    spans += _passes(written(parts, "pieces"))
    out = spans[0]
    for s in spans[1:]:
        out = out.unionByName(s)
    out = written(out.groupBy("row").agg(F.collect_list(F.struct("a", "z")).alias("spans")), "spans")
    dropped(again, firsts, wanted)
    return out


def merged(a: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans [a, z) that touch or overlap as one, in order."""
    order = np.argsort(a, kind="stable")
    a, z = a[order], np.maximum.accumulate(z[order])
    new = np.concatenate([[True], a[1:] > z[:-1]])
    return a[new], z[np.concatenate([new[1:], [True]])]


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row of docs with the bytes of its text that stay (kept) and what was removed (spans, array<struct<start, length>>).

    A byte goes if a string of 200 bytes that covers it also starts anywhere else, in the same text or another, also if
    the two overlap. All copies go, the first one, too; strings are judged as the texts were given. Texts are UTF-8, and
    may be cut within a character, so what stays is binary. Shorter texts stay whole, a null one counts as empty. Rows
    that repeat are texts of their own, so of 200 bytes or more nothing stays of them. Very long texts are read whole, in
    parts. Ids may be null; other columns are ignored, whatever their names; an empty table gives an empty result.
    """

    def cleaned(batches):
        for b in rows_of(batches):
            kept, spans = [], []
            for text, own in zip(b.column(1), b.column(2), strict=True):
                raw, own = text.as_py(), own.values
                if own is None:  # let through by the filter, though it loses nothing
                    kept.append(raw)
                    spans.append([])
                    continue
                a, z = merged(*(own.field(c).to_numpy(zero_copy_only=False) for c in ("a", "z")))
                kept.append(b"".join([raw[i:j] for i, j in zip([0, *z.tolist()], [*a.tolist(), len(raw)], strict=True)]))
                spans.append([{"start": i, "length": j - i} for i, j in zip(a.tolist(), z.tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kept, pa.binary()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])))], [id_col, "kept", "spans"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = src.schema[0].dataType.simpleString()
    # written, so that the numbers stay
    base = written(src.select(F.monotonically_increasing_id().alias("row"), "id", "text"), "texts")
    found = repeated(base)
    # texts that lose nothing are neither shuffled nor handed to Python
    parts = probable(base, found, "row").withColumn("raw", F.coalesce("text", F.lit("")).cast("binary"))
    some = parts.where("maybe").select("row", "id", "raw").join(found, "row", "left").select("id", "raw", "spans")
    changed = some.mapInArrow(cleaned, f"`{id_col}` {kind}, kept binary, spans array<struct<start:long,length:long>>")
    none = F.expr("cast(array() as array<struct<start:bigint,length:bigint>>)")
    return changed.unionByName(parts.where("not maybe").select(F.col("id").alias(id_col), F.col("raw").alias("kept"), none.alias("spans")))
