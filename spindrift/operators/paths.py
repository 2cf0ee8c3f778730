"""Taint of access paths within a file: variables and cells of arrays, with what overwrites them.

A path is a variable with a key: `` for the whole, `*` for a key that isn't known, else the key itself. A definition of the
whole kills what all of its cells had; one of a cell with a known key kills that cell's; one of an unknown key kills
nothing. An epoch of a variable begins at a definition of the whole. A read of a cell takes what its last definition within
the epoch gave it, or else the whole's, and of cells with unknown keys all that the epoch has before. A read of the whole
takes the definition of the whole, and all cells that the epoch has before.

So each read has one exact definition, found by windows, and for the rest an epoch, of which only the first tainted line
for each source counts: rows grow with lines, not with pairs of them. Taint is a set of types that it has not been made
harmless for. Rounds join what is new, and end when nothing is. As in `taint`, tables that grow with the corpus are merged.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import defaultdict
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import catalog
from . import calls, graphs
from .graphs import _Known, _solved, cut
from .summaries import _OUTER, _least, _news, _Sets, _with, within_functions

#: A variable, with what stands in its first brackets.
PATH = r"\$(\w+)(?:\[\s*+([^\]]*+)\])?"
INPUT = "php://input"


class Uses(NamedTuple):
    """defs: file, line_no, var, key, epoch. reads: file, line_no, var, key, cleaned, epoch, exact (the line of the definition that is read), vuln_type (of sinks; else null). seeds: file, line_no, origin, cleaned, vuln_type."""

    defs: DataFrame
    reads: DataFrame
    seeds: DataFrame


def _key(inside: str) -> str:
    """SQL: the key of what stands in brackets; null brackets are the whole."""
    return f"CASE WHEN {inside} RLIKE '^[A-Za-z0-9_]+$' THEN {inside} WHEN {inside} RLIKE {calls._q(chr(94) + chr(39) + '[^' + chr(39) + ']*' + chr(39) + '$')} OR {inside} RLIKE '^\"[^\"$]*\"$' THEN substring({inside}, 2, length({inside}) - 2) ELSE '*' END"


def _paths(text: str) -> str:
    """SQL: array<struct<var, key>> of an expression."""
    whole = f"regexp_extract_all({text}, {calls._q(PATH)}, 0)"
    var, inside = f"regexp_extract(x, {calls._q(PATH)}, 1)", f"trim(regexp_extract(x, {calls._q(PATH)}, 2))"
    return f"array_distinct(transform({whole}, x -> named_struct('var', {var}, 'key', CASE WHEN contains(x, '[') THEN {_key(inside)} ELSE '' END)))"


def _reads(text: str, rules_dir: str) -> str:
    """SQL: array<struct<path, cleaned>>: paths of an expression, and the types that the calls around each make it harmless for."""
    bare = f"regexp_replace({text}, {calls._q('(?i)' + calls.CAST)}, ' ')"
    outer = f"transform(arrays_zip(regexp_extract_all({bare}, {calls._q(_OUTER)}, 1), regexp_extract_all({bare}, {calls._q(_OUTER)}, 2)), o -> named_struct('name', o.`0`, 'args', o.`1`))"
    nested = f"flatten(transform(filter({calls.calls_sql('o.args')}, c -> array_contains({_paths('c.args')}, p)), c -> {calls._cleans('c.name', rules_dir)}))"
    within = f"flatten(transform({outer}, o -> transform({_paths('o.args')}, p -> named_struct('path', p, 'cleaned', array_sort(array_union({calls._cleans('o.name', rules_dir)}, {nested}))))))"
    left = f"transform({_paths(f'regexp_replace({bare}, {calls._q(_OUTER)}, chr(32))')}, p -> named_struct('path', p, 'cleaned', cast(array() AS array<string>)))"
    return f"array_distinct(concat({left}, {within}))"


def uses(lines: DataFrame, key: str = "file_id", rules_dir: str = catalog.OWN) -> Uses:
    """lines (key, line_no, text) as definitions and reads. A line has one assignment at most; `.=` and the like keep what was there."""
    at = r"^\s*\$(\w+)(?:\[\s*([^\]]*)\])?\s*([-+.*/|&^%]|\?\?)?=(?![=>])\s*(.*?);"
    lines = lines.select(F.col(key).alias("file"), "line_no", "text")
    request = sorted({r["name"].removeprefix("$") for r in catalog.rows("sources", rules_dir) if r.get("live") and r["name"].startswith("$_")})
    part = lambda i: F.regexp_extract("text", at, i)
    made = lines.where(F.col("text").rlike(at)).withColumns({"var": part(1), "inside": F.trim(part(2)), "kept": part(3) != "", "rhs": part(4)})
    made = made.withColumn("key", F.when(~F.regexp_extract("text", r"^\s*\$\w+(\[)?", 1).contains("["), "").otherwise(F.expr(_key("inside"))))
    made = cut(made.drop("text", "inside").withColumn("reads", F.expr(_reads("rhs", rules_dir))))
    none = F.array().cast("array<string>")
    taken = made.select("file", "line_no", F.explode("reads").alias("r")).select("file", "line_no", "r.path.*", "r.cleaned")
    own = made.where("kept").select("file", "line_no", "var", "key", none.alias("cleaned"))
    no_type = F.lit(None).cast("string").alias("vuln_type")
    sunk = lines.where(calls.may_sink("text", rules_dir)).select("file", "line_no", F.explode(calls.calls("text")).alias("c"))
    sunk = sunk.select("file", "line_no", "c.args", F.explode(calls.sinks("c.name", rules_dir)).alias("s")).select("file", "line_no", calls.argument("args", "s.arg").alias("arg"), "s.vuln_type")
    sunk = cut(sunk.select("*", F.explode(F.expr(_reads("arg", rules_dir))).alias("r")).select("file", "line_no", "r.path.*", "r.cleaned", "vuln_type").distinct())
    reads = taken.unionByName(own).select("*", no_type).unionByName(sunk)
    # functions that return a source as it is
    found, inside = within_functions(lines, "file")
    wraps = inside.where("name <> ''").select("file", F.lower("name").alias("name"), F.explode(F.expr(_reads(f"regexp_extract(text, {calls._q('(?i)^[^;]*' + chr(92) + 'breturn' + chr(92) + 'b(.*?);')}, 1)", rules_dir))).alias("r"))
    wraps = wraps.where(F.col("r.path.var").isin(request) & (F.size("r.cleaned") == 0)).select("file", "name", F.concat("r.path.var", F.lit("_WRAP")).alias("origin")).distinct()
    called = made.select("file", "line_no", F.explode(F.expr(f"array_distinct(transform({calls.calls_sql('rhs')}, c -> c.name))")).alias("name")).join(wraps.hint("merge"), ["file", "name"]).select("file", "line_no", "origin", none.alias("cleaned"), no_type)
    body = made.where(F.col("rhs").contains(INPUT)).select("file", "line_no", F.lit("_INPUT").alias("origin"), none.alias("cleaned"), no_type)
    seeds = reads.where(F.col("var").isin(request)).select("file", "line_no", F.col("var").alias("origin"), "cleaned", "vuln_type").unionByName(called).unionByName(body)
    reads = reads.where(~F.col("var").isin(request))
    # windows: definitions and reads of a variable in order; a read comes before what its own line defines
    d = made.select("file", "line_no", "var", "key", F.lit(1).alias("is_def"), none.alias("cleaned"), no_type)
    both = d.unionByName(reads.select("file", "line_no", "var", "key", F.lit(0).alias("is_def"), "cleaned", "vuln_type"))
    before = Window.partitionBy("file", "var").orderBy("line_no", "is_def").rowsBetween(Window.unboundedPreceding, -1)
    same = Window.partitionBy("file", "var", "key").orderBy("line_no", "is_def").rowsBetween(Window.unboundedPreceding, -1)
    is_whole = (F.col("is_def") == 1) & (F.col("key") == "")
    both = both.withColumn("epoch", F.coalesce(F.last(F.when(is_whole, F.col("line_no")), ignorenulls=True).over(before), F.lit(0)))
    both = both.withColumn("exact", F.greatest("epoch", F.coalesce(F.last(F.when((F.col("is_def") == 1) & (F.col("key") != "*"), F.col("line_no")), ignorenulls=True).over(same), F.lit(0))))
    both = cut(both)
    return Uses(both.where("is_def = 1").select("file", "line_no", "var", "key", "epoch"), both.where("is_def = 0").drop("is_def"), cut(seeds.distinct()))


def tainted(u: Uses) -> DataFrame:
    """(file, line_no, origin, cleaned): definitions that a source reaches, and the types that it was made harmless for.

    All of it lies within files. Those of up to LOCAL definitions, reads and sources are solved many at a time in a task, larger ones by rounds.
    """
    kind, sets, no = u.defs.schema["file"].dataType.simpleString(), F.array_join("cleaned", "\n").alias("types"), F.lit(None)
    columns = {"what": "string", "file": kind, "line_no": "int", "var": "string", "key": "string", "epoch": "int", "exact": "int", "origin": "string", "types": "string"}
    row = lambda df, what, **more: df.select(*[F.lit(what).alias(c) if c == "what" else more.get(c, F.col(c) if c in df.columns else no).cast(t).alias(c) for c, t in columns.items()])
    seeds = u.seeds.where("vuln_type IS NULL")
    rows = row(u.defs, "def").unionByName(row(u.reads.where("vuln_type IS NULL"), "read", types=sets)).unionByName(row(seeds, "seed", types=sets))
    small, large = graphs._bucketed(cut(rows.where("file IS NOT NULL").withColumn("part", F.col("file"))), graphs.LOCAL)
    found = _solved(small, _tainted_of, f"file {kind}, line_no int, origin string, cleaned string")
    out = found.withColumn("cleaned", F.filter(F.split("cleaned", "\n"), lambda t: t != ""))
    if large is None:
        return out
    of = lambda df: df.join(large.select("file").distinct().hint("merge"), "file", "left_semi")
    return out.unionByName(_tainted_by_rounds(Uses(of(u.defs), of(u.reads), of(u.seeds))))


def _tainted_of(frame: pd.DataFrame) -> pd.DataFrame:
    """`tainted` of a bucket's files. Tainted definitions go to the reads that they are exact for, and cells to later reads of their epoch, if these are of the whole or of unknown keys, or the cells' own keys are unknown."""
    sets, frame = _Sets(), frame.sort_values("line_no")
    exact, cells, wholes, defs, known, work = defaultdict(list), defaultdict(list), defaultdict(list), {}, defaultdict(list), []
    since: dict[tuple, int] = {}
    for what, file, line, var, key, epoch, at, origin, types in zip(*(frame[c].tolist() for c in ("what", "file", "line_no", "var", "key", "epoch", "exact", "origin", "types")), strict=True):
        if what == "def":
            defs[file, line] = var, key, epoch
        elif what == "seed":
            work.append((file, line, origin, sets.of(types)))
        else:
            mask = sets.of(types)
            exact[file, at].append((line, mask))
            cells[file, var, epoch].append((line, mask))
            if key in ("", "*"):
                wholes[file, var, epoch].append((line, mask))
    while work:
        file, line, origin, mask = work.pop()
        if not _least(known[file, line, origin], mask):
            continue
        to = exact.get((file, line), ())
        if (own := defs.get((file, line))) and own[1] != "":
            var, key, epoch = own
            star = key == "*"
            reads = (cells if star else wholes).get((file, var, epoch), ())
            # of an epoch's cells only the first tainted line counts: reads after it have been reached from there
            slot = file, var, epoch, star, origin, mask
            first = bisect_right(reads, line, key=lambda r: r[0]) if reads else 0
            last = since.get(slot, len(reads))
            if first < last:
                since[slot] = first
                to = [*to, *reads[first:last]]
        work += [(file, x, origin, mask | more) for x, more in to]
    rows = [(file, line, origin, sets.names(m)) for (file, line, origin), masks in known.items() for m in masks]
    return pd.DataFrame(rows, columns=["file", "line_no", "origin", "cleaned"])


def _tainted_by_rounds(u: Uses) -> DataFrame:
    fresh = cut(u.seeds.where("vuln_type IS NULL").select("file", "line_no", "origin", "cleaned").distinct())
    known = _Known(fresh)
    moves = u.reads.where("vuln_type IS NULL").drop("vuln_type")
    while not fresh.isEmpty():
        fresh = cut(_news(_onward(fresh, moves, u.defs), known.rows, ["file", "line_no", "origin"]))
        known.add(fresh)
    return known.rows


def _undefined(u: Uses) -> Uses:
    """u with a source, UNDEFINED, where what is read was never assigned: nothing is known of it."""
    none = F.array().cast("array<string>")
    more = u.reads.where("exact = 0").select("file", "line_no", F.lit("UNDEFINED").alias("origin"), F.coalesce("cleaned", none).alias("cleaned"), "vuln_type")
    return u._replace(seeds=cut(u.seeds.unionByName(more).distinct()))


def _common(cleaned: str, rules_dir: str) -> Column:
    """Of a group's sets the types that all of them have; all types if it has no set."""
    every = F.array(*map(F.lit, calls.all_types(rules_dir)))
    return F.aggregate(F.collect_set(cleaned), every, F.array_intersect)


def intervals(u: Uses, rules_dir: str = catalog.OWN) -> DataFrame:
    """(file, var, key, from_line, to_line, types): between which lines a path has a definition's value, and the types that this is harmless for: all of them for constants, and none for what no one has assigned.

    An interval ends at the next definition of the same key or of the whole, and at the last line of all if there is none.
    """
    dirty = tainted(_undefined(u)).groupBy("file", "line_no").agg(_common("cleaned", rules_dir).alias("types"))
    every = F.array(*map(F.lit, calls.all_types(rules_dir)))
    d = u.defs.join(dirty, ["file", "line_no"], "left").withColumn("types", F.coalesce("types", every))
    later = Window.partitionBy("file", "var").orderBy("line_no").rowsBetween(1, Window.unboundedFollowing)
    same = Window.partitionBy("file", "var", "key").orderBy("line_no").rowsBetween(1, Window.unboundedFollowing)
    next_whole = F.min(F.when(F.col("key") == "", F.col("line_no"))).over(later)
    next_same = F.when(F.col("key") != "*", F.min("line_no").over(same))
    end = F.least(F.coalesce(next_whole, F.lit(2**31 - 1)), F.coalesce(next_same, F.lit(2**31 - 1)))
    return d.select("file", "var", "key", (F.col("line_no") + 1).alias("from_line"), end.alias("to_line"), F.array_sort("types").alias("types"))


def presink(u: Uses, rules_dir: str = catalog.OWN) -> DataFrame:
    """(file, line_no, vuln_type, var, key, assigned_at, is_clean): each path that a sink reads, where it was assigned (0: nowhere), and whether it is harmless for the sink's type there.

    The path itself is looked up, then its whole variable, then cells of unknown keys, with what the sink's own line does
    to it. What it was made of counts as it was at that line; a later source makes it harmful again.
    """
    u = _undefined(u)
    sinks = u.reads.where("vuln_type IS NOT NULL")
    named = sinks.select("*", F.col("var").alias("of_var"), F.col("key").alias("of_key"))
    arriving = _onward(cut(tainted(u)), named, u.defs).select("file", "line_no", "vuln_type", "of_var", "of_key", "cleaned")
    lost = sinks.where("exact = 0").select("file", "line_no", "vuln_type", F.col("var").alias("of_var"), F.col("key").alias("of_key"), "cleaned")
    bad = arriving.unionByName(lost).where(~F.array_contains("cleaned", F.col("vuln_type"))).select("file", "line_no", "vuln_type", F.col("of_var").alias("var"), F.col("of_key").alias("key"), F.lit(True).alias("bad")).distinct()
    one = sinks.groupBy("file", "line_no", "vuln_type", "var", "key").agg(F.max("exact").alias("assigned_at"))
    return one.join(bad, ["file", "line_no", "vuln_type", "var", "key"], "left").select("file", "line_no", "vuln_type", "var", "key", "assigned_at", F.col("bad").isNull().alias("is_clean"))


def _onward(fresh: DataFrame, reads: DataFrame, defs: DataFrame) -> DataFrame:
    """What reads (with all of their columns) take from tainted definitions: file, line_no, origin, cleaned."""
    more = [c for c in reads.columns if c not in ("file", "line_no", "cleaned", "var", "key", "epoch", "exact")]
    r = reads.withColumnRenamed("cleaned", "more")
    out = ["file", "line_no", *more, "origin", _with("cleaned", "more").alias("cleaned")]
    exact = r.join(fresh.withColumnRenamed("line_no", "exact").hint("merge"), ["file", "exact"]).select(*out)
    cells = fresh.join(defs.where("key <> ''").hint("merge"), ["file", "line_no"])
    first = cells.groupBy("file", "var", "epoch", (F.col("key") == "*").alias("star"), "origin", "cleaned").agg(F.min("line_no").alias("since"))
    reach = F.col("key").isin("", "*") | F.col("star")
    rest = r.join(first.hint("merge"), ["file", "var", "epoch"]).where(reach & (F.col("line_no") > F.col("since"))).select(*out)
    return exact.unionByName(rest).distinct()


def findings(u: Uses, own: bool = True) -> DataFrame:
    """(file, line_no, vuln_type, origin): sinks that a source reaches along paths, not made harmless for their type; with own also sources within the sink's own line.

    Origins are a request's names, those with _WRAP where a function returns it, and _INPUT for a request's body."""
    at = _onward(cut(tainted(u)), u.reads.where("vuln_type IS NOT NULL"), u.defs)
    every = at.select("file", "line_no", "vuln_type", "origin", "cleaned")
    if own:
        every = every.unionByName(u.seeds.where("vuln_type IS NOT NULL").select("file", "line_no", "vuln_type", "origin", "cleaned"))
    return every.where(~F.array_contains("cleaned", F.col("vuln_type"))).select("file", "line_no", "vuln_type", "origin").distinct()

