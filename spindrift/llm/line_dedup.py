"""Dedup of recurring passages by winnowing over words and over lines.

A gram is a run of GRAM words, wherever it stands in lines, or of LINE_GRAM lines. Of each window of RUN words (LINE_RUN
lines) the gram of the least hash is selected, the first one of equals, so equal windows select the same gram at the same
distance. A selected gram's place stands for the stretch of all windows that selected it. Places are joined by gram:

* of places whose whole stretches are equal, too, the first stays, and the stretches of all others are deleted;
* where a gram stands in different stretches, the first place of each stretch is extended both ways window by window, and
  each window that some earlier place has goes.

Windows of lines that hold RUN words or more are left to the windows of words, which find them as well. So a window of RUN words (LINE_RUN lines) goes if and only if an earlier place has the same one, and nothing is joined to
anything but the first of its kind: work and rows grow with the text, not with the square of a group. Places are in order
of id, then text, then word.

Sums of a polynomial choose grams and bring together what may be equal; they are the same for equal words, and may be for
others. What is deleted rests on the words themselves: stretches and windows are told equal by BLAKE2b with 128 bits of
their words, parted by spaces, or by newlines where lines are compared.
"""

from __future__ import annotations

import hashlib
import re
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written
from .shared import rows_of
from .url_filter import WORDS, _bits, _block, bloom_filter

#: Words of a recurring run that is deleted, at least, and of a gram; the same of lines that have words.
RUN, GRAM = 50, 16
LINE_RUN, LINE_GRAM = 3, 2
_BASE = 0x9E3779B97F4A7C15
_AT = (1 << 31) - 1
_U = np.uint64


#: Bytes that are white space, and the UTF-8 of other white space, by first byte.
_SPACE = np.isin(np.arange(256), [*range(9, 14), *range(28, 33)])
_WIDE = {0xC2: [b"\x85", b"\xa0"], 0xE1: [b"\x9a\x80"], 0xE2: [*(bytes([0x80, x]) for x in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), b"\x81\x9f"], 0xE3: [b"\x80\x80"]}
#: Bytes that are hashed at a time; a longer word is hashed on its own.
_PART = 1 << 20


class _Powers:
    """Powers of the base and of its inverse, modulo 2**64, as many as have been asked for."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            rows = np.empty((2, max(n, 2 * len(cls.up))), np.uint64)
            rows[:] = np.array([[_BASE], [pow(_BASE, -1, 1 << 64)]], np.uint64)
            rows[:, 0] = 1
            cls.up, cls.down = np.cumprod(rows, axis=1)
        return cls.up, cls.down


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


class Stream:
    """Hashes of tokens, one text after the other, and of any run of them: a polynomial modulo 2**64, then mixed."""

    def __init__(self, hashes: np.ndarray):
        self.up, self.down = _Powers.of(len(hashes) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * self.up[: len(hashes)])])

    def runs(self, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Hash of the tokens from a up to z, z left out."""
        return mixed((self.sums[z] - self.sums[a]) * self.down[a])


class Words(NamedTuple):
    """The words of all texts: their bytes, each word with one byte after it if white space follows, and where each begins and ends. lined: the same with newlines after lines."""

    flat: np.ndarray
    lined: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    def digests(self, first: np.ndarray, last: np.ndarray, lined: np.ndarray) -> np.ndarray:
        """Of stretches (first and last word): two numbers each, from their words and from where lines end, if that counts."""
        views = memoryview(self.flat), memoryview(self.lined)
        own = zip(self.starts[first].tolist(), self.ends[last].tolist(), lined.tolist(), strict=True)
        return np.frombuffer(b"".join([hashlib.blake2b(views[k][a:z], digest_size=16).digest() for a, z, k in own]), np.int64).reshape(-1, 2)


def selected(stream: Stream, lengths: np.ndarray, run: int, gram: int, salt: int, counts: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Of texts of so many tokens each: text, gram (hash), first window (over all texts) and number of windows of each place.

    counts: words of each token; windows with RUN words or more are left out then."""
    n = len(stream.sums) - 1
    none = tuple(np.empty(0, t) for t in (np.int64, np.uint64, np.int64, np.int64))
    if n < run:
        return none
    grams = stream.runs(np.arange(n - gram + 1), np.arange(gram, n + 1)) ^ _U(salt)
    least, size, width = (grams & ~_U(_AT)) | np.arange(len(grams), dtype=np.uint64), 1, run - gram + 1
    while 2 * size <= width:  # the least of each window, by doubling
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    least = np.minimum(least[: n - run + 1], least[width - size :][: n - run + 1])
    ends = np.cumsum(lengths)
    text = np.repeat(np.arange(len(lengths)), np.maximum(lengths - run + 1, 0))
    if not len(text):
        return none
    first_of = np.cumsum(np.maximum(lengths - run + 1, 0)) - np.maximum(lengths - run + 1, 0)
    at = np.arange(len(text)) - first_of[text] + (ends - lengths)[text]  # windows that lie within one text
    if counts is not None:
        total = np.concatenate([[0], np.cumsum(counts)])
        few = total[at + run] - total[at] < RUN
        at, text = at[few], text[few]
        if not len(text):
            return none
    chosen = (least[at] & _U(_AT)).astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (at[1:] != at[:-1] + 1)]))
    count = np.diff(np.concatenate([starts, [len(chosen)]]))
    return text[starts], grams[chosen[starts]], at[starts], count


def text_bytes(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 of all texts, one after the other, and where each begins, and where the last one ends. Nulls are empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def spaces(raw: np.ndarray) -> np.ndarray:
    """Which bytes belong to white space, of any kind that parts words in Python."""
    out = _SPACE[raw]
    for lead, tails in _WIDE.items():
        at = np.flatnonzero(raw == lead)
        for tail in tails if len(at) else ():
            here = at[at + len(tail) < len(raw)]
            for k, x in enumerate(tail, 1):
                here = here[raw[here + k] == x]
            for k in range(len(tail) + 1):
                out[here + k] = True
    return out


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    long = np.flatnonzero(ends - starts > _PART // 2)
    for k in long.tolist():
        out[k] = xxhash.xxh64_intdigest(raw[starts[k] : ends[k]].tobytes())
    short, k = np.delete(np.arange(len(starts)), long), 0
    while k < len(short):
        first = starts[short[k]]
        to = int(np.searchsorted(ends[short], first + _PART, "right"))
        own = short[k : max(to, k + 1)]
        out[own] = Stream(raw[first : ends[own[-1]]].astype(np.uint64) + _U(1)).runs(starts[own] - first, ends[own] - first)
        k = max(to, k + 1)
    return out


def tokens(texts: pa.StringArray) -> tuple[Stream, np.ndarray, Stream, np.ndarray, np.ndarray, Words]:
    """The stream of all texts' words and how many each has, that of their lines that have words and how many, the words of each line, and all words."""
    raw, at = text_bytes(texts)
    space = spaces(raw)
    edge = np.zeros(len(raw) + 1, bool)  # where a word can't go on from the byte before
    edge[at] = True
    edge[:-1] |= space
    edge[1:] |= space
    edge[0] = True
    word = ~space
    starts, ends = np.flatnonzero(word & edge[:-1]), np.flatnonzero(word & edge[1:]) + 1
    stream = Stream(word_hashes(raw, starts, ends))
    own = np.diff(np.searchsorted(starts, at))
    lines = np.union1d(at[:-1], np.flatnonzero(raw == 10) + 1)  # where lines begin; texts that are empty share theirs with the next
    counts = np.diff(np.concatenate([np.searchsorted(starts, lines), [len(starts)]]))
    full = counts > 0
    counts, lines = counts[full], lines[full]
    stops = np.cumsum(counts)
    after = np.append(space, False)[ends]  # whether white space follows the word
    size = ends - starts + after
    first = np.cumsum(size) - size
    flat = raw[word | (space & np.append(False, word[:-1]))] if len(raw) else raw.copy()
    last = first + ends - starts
    flat[last[after]] = 32
    lined, of_lines = flat.copy(), stops - 1
    lined[last[of_lines[after[of_lines]]]] = 10
    return stream, own, Stream(stream.runs(stops - counts, stops)), np.diff(np.searchsorted(lines, at)), counts, Words(flat, lined, first, last)


def _digests(words: Words, counts: np.ndarray, kind: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Of stretches of words or lines (first and last one, over all texts): two numbers each."""
    stops = np.append(np.cumsum(counts), 0)
    lines = kind == 1
    a, z = first.copy(), last.copy()
    a[lines], z[lines] = stops[first[lines]] - counts[first[lines]], stops[last[lines]] - 1
    return words.digests(a, z, lines)


def places(texts: pa.StringArray) -> tuple[np.ndarray, ...]:
    """text, kind (0: words, 1: lines), gram, digest (two numbers), first token and number of windows of each selected gram's place."""
    stream, own, lines, per_text, counts, words = tokens(texts)
    found = (selected(stream, own, RUN, GRAM, 0), selected(lines, per_text, LINE_RUN, LINE_GRAM, _BASE, counts))
    text, gram, at, n = (np.concatenate(x) for x in zip(*found, strict=True))
    kind = np.repeat([0, 1], [len(f[0]) for f in found])
    digest = _digests(words, counts, kind, at, at + n + np.where(kind == 0, RUN, LINE_RUN) - 2)
    begin = np.where(kind == 0, (np.cumsum(own) - own)[text], (np.cumsum(per_text) - per_text)[text])
    return text, kind, gram, digest[:, 0], digest[:, 1], at - begin, n


def windows(texts: pa.StringArray, text: np.ndarray, kind: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of places (text, kind, first and last token): for each of their windows, the place's number, the digest (two numbers) and the first token."""
    _, own, _, per_text, counts, words = tokens(texts)
    run = np.where(kind == 0, RUN, LINE_RUN)
    n = last - first - run + 2
    place = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(place)) - (np.cumsum(n) - n)[place] + first[place]
    k = kind[place]
    begin = np.where(k == 0, (np.cumsum(own) - own)[text[place]], (np.cumsum(per_text) - per_text)[text[place]])
    digest = _digests(words, counts, k, at + begin, at + begin + run[place] - 1)
    return place, digest[:, 0], digest[:, 1], at


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans [first, last] that touch or overlap as one, in order."""
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], z))
        else:
            out.append((a, z))
    return out


def without(text: str, spans: list[tuple[int, int, int]]) -> tuple[str, int, int, list[tuple[int, int]]]:
    """(text, lines, removed lines, the [first, last] words of what is gone) less the [first, last] tokens of spans (kind, first, last).

    A line goes if all of its words do, or if it has none and stands between words that go. Of other lines the words go,
    with the white space up to the next word, or after the last word that stays.
    """
    lines = text.split("\n")
    if (whole := _merged([(a, z) for kind, a, z in spans if not kind])) and whole[0] == (0, len(text.split()) - 1):
        has = [k for k, x in enumerate(lines) if x and not x.isspace()]
        left = lines[: has[0]] + lines[has[-1] + 1 :]
        return "\n".join(left), len(lines), has[-1] + 1 - has[0], whole
    counts = [len(x.split()) for x in lines]
    starts = list(accumulate(counts, initial=0))
    full = [k for k, c in enumerate(counts) if c]
    gone = _merged([(starts[full[a]], starts[full[z] + 1] - 1) if kind else (a, z) for kind, a, z in spans])
    left, k = [], 0
    for x, n, at in zip(lines, counts, starts, strict=False):
        while k < len(gone) and gone[k][1] < at:
            k += 1
        if k == len(gone) or gone[k][0] >= at + n:  # nothing of this line goes
            left.append(x)
        elif not n:
            if gone[k][0] == at:
                left.append(x)
        elif gone[k][0] > at or gone[k][1] < at + n - 1:
            out = bytearray(n)
            for a, z in gone[k:]:
                if a >= at + n:
                    break
                a, z = max(a, at) - at, min(z, at + n - 1) - at
                out[a : z + 1] = b"\1" * (z + 1 - a)
            own, stay = [m.span() for m in re.finditer(r"\S+", x)], [j for j in range(n) if not out[j]]
            parts = [x[: own[0][0]]]
            for j in stay:
                after = own[j + 1][0] if j + 1 < n else len(x)
                parts.append(x[own[j][0] : own[j][1] if j == stay[-1] and j + 1 < n else after])
            left.append("".join(parts))
    return "\n".join(left), len(lines), len(lines) - len(left), gone


def probable(df: DataFrame, rows: DataFrame, key: str = "row") -> DataFrame:
    """df with `maybe`: whether its key passes a Bloom filter, of bounded size, of the keys in rows. Of those in rows each does."""
    filter_, blocks = bloom_filter(rows, key)
    hit = F.lit(True)
    for i, bit in enumerate(_bits(F.col(key))):
        hit &= F.col(f"w{i}").bitwiseAND(bit) != 0
    out = df.withColumn("block", _block(F.col(key), blocks)).join(F.broadcast(filter_), "block", "left")
    return out.withColumn("maybe", F.coalesce(hit, F.lit(False))).drop("block", *[f"w{i}" for i in range(WORDS)])


def _batch(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns], names)


#: What places are ordered by.
_PLACE = ("id", "text_hash", "row", "a")


def _firsts(rows: DataFrame, keys: list[str], carried: tuple[str, ...] = (), *more) -> DataFrame:
    """Of each group of rows the first place, with columns that are carried, and c, how many it has. To be written, so that a join with it can split a group that many rows belong to."""
    return rows.groupBy(*keys).agg(F.min(F.struct(*_PLACE, *carried)).alias("first"), F.count("*").alias("c"), *more)


#: What stretches and windows are told equal by: all of their words, and of lines where these end.
_KEYS = ["d1", "d2"]


def _later(rows: DataFrame, keys: list[str], firsts: DataFrame) -> DataFrame:
    """rows with a place (id, text_hash, row, kind, a, z) that some earlier row has the same keys as. Only firsts, of which each partition has few, are put into a hash table; nothing is sorted."""
    firsts = firsts.where("c > 1").select(*keys, F.struct(*(f"first.{c}" for c in _PLACE)).alias("first"))
    return rows.join(firsts.hint("shuffle_hash"), keys).where(F.struct(*_PLACE) > F.col("first")).select("row", "kind", "a", "z")


def repeated(base: DataFrame, kind: str) -> DataFrame:
    """(row, spans): what goes from the rows of base (row, id, text_hash, text) that lose anything."""

    def grams(batches):
        for b in rows_of(batches):
            text, which, gram, d1, d2, at, n = places(b.column(3))
            take = pa.array(text)
            run = np.where(which == 0, RUN, LINE_RUN)
            yield _batch(names, gram, d1, d2, *(b.column(c).take(take) for c in range(3)), which.astype(np.int8), at.astype(np.int32), (at + n + run - 2).astype(np.int32))

    def exploded(batches):
        for b in rows_of(batches):
            own = b.column(4)
            p = own.flatten()
            text = np.repeat(np.arange(b.num_rows), np.diff(own.offsets.to_numpy()))
            which, first, last = (p.field(c).to_numpy(zero_copy_only=False) for c in ("kind", "a", "z"))
            place, d1, d2, at = windows(b.column(3), text, which, first.astype(np.int64), last.astype(np.int64))
            take = pa.array(text[place])
            yield _batch(names[1:-1], d1, d2, *(b.column(c).take(take) for c in range(3)), which[place], at.astype(np.int32))

    names = ["gram", "d1", "d2", "row", "id", "text_hash", "kind", "a", "z"]
    schema = f"gram long, d1 long, d2 long, row long, id {kind}, text_hash long, kind byte, a int, z int"
    found = written(base.mapInArrow(grams, schema), "grams")
    counts = found.groupBy("gram").agg(F.count("*").alias("c"), (F.min("d1") != F.max("d1")).alias("many")).where("c > 1").select("gram", "many")
    again = written(found.join(written(counts, "recurring-grams").hint("shuffle_hash"), "gram").drop("gram"), "recurring-places")
    firsts = written(_firsts(again, _KEYS, ("z", "kind"), F.max("many").alias("many")).where("c > 1 or many"), "first-places")
    spans = _later(again.drop("many"), _KEYS, firsts)
    # the first place of each stretch of a gram that stands in several
    wanted = firsts.where("many").groupBy("first.row").agg(F.collect_list(F.struct("first.kind", "first.a", "first.z")).alias("own"))
    wanted = written(wanted, "stretches")
    texts = probable(base, wanted.select("row")).where("maybe").drop("maybe")
    of_windows = ", ".join(c for c in schema.split(", ") if c not in ("gram long", "z int"))
    parts = written(texts.join(wanted, "row").select("row", "id", "text_hash", "text", "own").mapInArrow(exploded, of_windows), "windows")
    last = F.col("a") + F.when(F.col("kind") == 0, RUN - 1).otherwise(LINE_RUN - 1)
    spans = spans.unionByName(_later(parts.withColumn("z", last), _KEYS, written(_firsts(parts, _KEYS).where("c > 1"), "first-windows")))
    return spans.groupBy("row").agg(F.collect_list(F.struct("kind", "a", "z")).alias("spans"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row of docs with its text less the later repeated runs: id, text, n_lines, removed_lines, removed_words and
    spans (first and last word of what was removed, from 0).

    Lines are parted by newlines, words by any white space. A word goes if it stands in a window of 50 words, or of 3
    lines that have words, that an earlier place has as well, wherever the words stand in their lines and whatever blank
    lines part the lines; all other words stay. So runs of 50 words or 3 lines and more that recur are deleted in full,
    in one text or several, and shorter ones stay. The place of the least id is the earliest (a null id is the least); of
    equal ids, that of the text with the lesser hash; rows that repeat both are alike, so one of them stays. Lines of which
    all words are deleted are removed, as are lines without words between deleted words; lines that lose no word are
    unchanged. A null text counts as empty, which is one line without words. Very long texts are read whole, one at a
    time. Other columns are ignored, whatever their names; an empty table gives an empty result.
    """

    def cleaned(batches):
        for b in rows_of(batches):
            out = []
            for text, kinds, firsts, lasts in zip(*(b.column(c).to_pylist() for c in range(1, 5)), strict=True):
                if kinds is None:  # let through by the filter, though it loses nothing
                    out.append((text or "", (text or "").count("\n") + 1, 0, 0, ""))
                    continue
                left, n, removed, gone = without(text, list(zip(kinds, firsts, lasts, strict=True)))
                out.append((left, n, removed, sum(z - a + 1 for a, z in gone), " ".join(f"{a}-{z}" for a, z in gone)))
            types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True))], made)

    made = [id_col, "text", "n_lines", "removed_lines", "removed_words", "spans"]
    src = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    kind = src.schema[0].dataType.simpleString()
    # written, so that the numbers stay
    base = written(src.select(F.monotonically_increasing_id().alias("row"), "id", "text_hash", "text"), "texts")
    spans = written(repeated(base, kind), "spans")
    # texts that lose nothing are neither shuffled nor handed to Python
    parts = probable(base, spans.select("row"))
    some = parts.where("maybe").select("row", "id", "text").join(spans, "row", "left")
    changed = some.select("id", "text", "spans.kind", "spans.a", "spans.z")
    changed = changed.mapInArrow(cleaned, f"`{id_col}` {kind}, text string, n_lines long, removed_lines long, removed_words long, spans string")
    rest = parts.where("not maybe").select("id", "text")
    text = F.coalesce("text", F.lit(""))
    n = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    zero = F.lit(0).cast("long")
    return changed.unionByName(rest.select(F.col("id").alias(id_col), text.alias("text"), n.cast("long").alias("n_lines"), zero.alias("removed_lines"), zero.alias("removed_words"), F.lit("").alias("spans")))
