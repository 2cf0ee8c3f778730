"""Taint through calls: summaries of functions, what of a parameter or a source reaches their value and their sinks.

A program is a set of relations, which `program` reads off lines. A fact says that what a function got as a parameter, or
took from a source, is in one of its nodes (variables, values of calls, the value that it returns), and for which types of
sink it has been made harmless on the way. Facts go along moves within functions. A fact at a returned value is a summary;
where the function is called it is one more move, from the argument to the call's value, so taint comes back only to the
call that handed it in. New facts meet all moves, and new moves meet all facts, until nothing is new: sets are finite. Of
facts that differ in what was cleaned, those that have another one's cleanings and more say nothing new, and are left out.
Then sinks are handed up from callees to callers in the same way. No order of functions is needed, and recursion is no case
of its own.

A call means the function of that name in its file, or else all functions of that name anywhere: these share one summary,
so calls and functions of a frequent name are joined to it, never with each other.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lines as L
from ..sources import catalog
from . import calls, graphs, joins
from .graphs import _Known, _solved, cut

RETURN = "#return"
_OUTER = rf"(?<![\w$>:])([A-Za-z_]\w*+)\s*+\(((?:{calls.INNER})*+)\)"
#: Arguments that a call's are read up to, which is what `calls.argument` does.
ARGUMENTS = 4


class Program(NamedTuple):
    """params: func, idx, node. moves: func, src, dst, cleaned. seeds: func, node, source. args: func, line_no, callee, idx, node, value. sinks: func, line_no, node, vuln_type.

    func and callee are `file:name`; callees of other files are `*:name`. value is the node of a call's value."""

    params: DataFrame
    moves: DataFrame
    seeds: DataFrame
    args: DataFrame
    sinks: DataFrame


def _atoms(text: str) -> str:
    """SQL: the nodes that an expression takes its value from: variables, and values of the outermost calls."""
    bare = f"regexp_replace({text}, {calls._q('(?i)' + calls.CAST)}, ' ')"
    found = lambda i: f"regexp_extract_all({bare}, {calls._q(_OUTER)}, {i})"
    values = f"transform(arrays_zip({found(1)}, {found(2)}), c -> concat(lower(c.`0`), '(', c.`1`, ')'))"
    return f"array_distinct(concat(regexp_extract_all(regexp_replace({bare}, {calls._q(_OUTER)}, ' '), {calls._q(calls.VARIABLE)}, 1), {values}))"


def within_functions(lines: DataFrame, key: str = "file_id") -> tuple[DataFrame, DataFrame]:
    """Functions (key, name, start_line, end_line) and lines with `name`, that of the function that they stand in, `` outside. A function that isn't closed ends with its file."""
    found = L.function_extents(lines, key).withColumn("end_line", F.coalesce("end_line", F.lit(2**31 - 1)))
    last = lines.groupBy(key).agg(F.max("line_no").alias("last"))
    found = cut(found.join(last.hint("merge"), key).withColumn("end_line", F.least("end_line", "last")).drop("last"))
    inside = joins.contained_in(lines, found.select(key, "name", "start_line", "end_line").hint("merge"), key, "line_no", "start_line", "end_line")
    one = inside.groupBy(key, "line_no").agg(F.max_by("name", "start_line").alias("name"))  # the innermost
    return found, lines.join(one.hint("merge"), [key, "line_no"], "left").fillna({"name": ""})


def program(lines: DataFrame, key: str = "file_id", rules_dir: str = catalog.OWN) -> Program:
    """lines (key, line_no, text) as relations. An assignment or return is one to a line; methods are left out, and what stands outside of functions is one of its own."""
    found, lines = within_functions(lines.select(key, "line_no", "text"), key)
    of = lambda file, name: F.concat(file.cast("string"), F.lit(":"), F.lower(name))
    func = of(F.col(key), F.col("name")).alias("func")
    heads = found.join(lines.select(key, F.col("line_no").alias("start_line"), "text"), [key, "start_line"])
    given = F.regexp_extract_all(F.regexp_extract("text", r"(?i)\bfunction\s+\w+\s*\(([^)]*)\)", 1), F.lit(calls.VARIABLE), 1)
    params = heads.select(func, F.posexplode(given).alias("idx", "node"))
    known = found.select(F.col(key).alias("k"), F.lower("name").alias("n")).distinct()
    body = lines.where(~F.col("text").rlike(r"(?i)\bfunction\s+\w+\s*\(")).withColumns({"func": of(F.col(key), F.col("name")), "made": calls.calls("text")})
    body = cut(body.where("contains(text, '$') OR size(made) > 0"))
    none = F.array().cast("array<string>")
    target = F.when(F.col("text").rlike(r"(?i)^\s*(?:\}\s*)?return\b"), RETURN).otherwise(F.nullif(F.regexp_extract("text", r"^\s*\$(\w+)\s*\.?=(?!=)", 1), F.lit("")))
    value = F.regexp_extract("text", r"(?i)^\s*(?:(?:\}\s*)?return\b|\$\w+\s*\.?=(?!=))\s*(.*?);", 1)
    moved = body.select("func", target.alias("dst"), value.alias("rhs")).where("dst IS NOT NULL")
    moves = moved.select("func", F.explode(F.expr(_atoms("rhs"))).alias("src"), "dst", none.alias("cleaned"))
    made = body.select(key, "func", "line_no", F.explode("made").alias("c")).select(key, "func", "line_no", "c.name", "c.args")
    sunk = made.select("func", "line_no", "args", F.explode(calls.sinks("name", rules_dir)).alias("s"))
    sinks = sunk.select("func", "line_no", calls.argument("args", "s.arg").alias("arg"), "s.vuln_type").select("func", "line_no", F.explode(F.expr(_atoms("arg"))).alias("node"), "vuln_type").distinct()
    used = made.where("name NOT LIKE '->%'").withColumn("value", F.concat("name", F.lit("("), "args", F.lit(")")))
    each = used.select("*", F.posexplode(F.array(*[calls.argument("args", str(k)) for k in range(ARGUMENTS)])).alias("idx", "arg"))
    each = each.select(key, "func", "line_no", "name", "value", "idx", F.explode(F.expr(_atoms("arg"))).alias("node"))
    here = known.select(F.col("k").alias(key), F.col("n").alias("name"), F.lit(True).alias("here"))
    there = known.select(F.col("n").alias("name"), F.lit(True).alias("there")).distinct()
    each = each.join(here, [key, "name"], "left").join(there, "name", "left")
    callee = F.when(F.col("here"), of(F.col(key), F.col("name"))).when(F.col("there"), F.concat(F.lit("*:"), "name"))
    each = cut(each.withColumn("callee", callee))
    args = each.where("callee IS NOT NULL").select("func", "line_no", "callee", "idx", "node", "value")
    # a function that isn't the program's own makes its value of its arguments
    own = each.where("callee IS NULL").select("func", F.col("node").alias("src"), F.col("value").alias("dst"), F.array_sort(calls.cleans("name", rules_dir)).alias("cleaned"))
    request = sorted({r["name"].removeprefix("$") for r in catalog.rows("sources", rules_dir) if r.get("live") and r["name"].startswith("$_")})
    nodes = moves.select("func", F.col("src").alias("node")).unionByName(sinks.select("func", "node")).unionByName(each.select("func", "node")).distinct()
    seeds = nodes.where(F.col("node").isin(request)).select("func", "node", F.col("node").alias("source"))
    # calls without arguments have values, too
    bare = used.join(here, [key, "name"], "left").join(there, "name", "left").withColumn("callee", callee).where("callee IS NOT NULL")
    args = args.unionByName(bare.select("func", "line_no", "callee", F.lit(-1).alias("idx"), F.lit("").alias("node"), "value"))
    return Program(*[cut(x.distinct()) for x in (params, moves.unionByName(own), seeds, args, sinks)])


def _both(df: DataFrame, name: str = "func") -> DataFrame:
    """Rows of a function, for calls from its own file and for those from others."""
    out = df.select(F.explode(F.array(F.col(name), F.concat(F.lit("*:"), F.element_at(F.split(name, ":"), -1)))).alias("callee"), *[c for c in df.columns if c != name])
    return out.distinct()


def _with(a: Column | str, b: Column | str) -> Column:
    return F.array_sort(F.array_union(a, b))


def _news(found: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of found that no row of known says already: one that has the same keys, and cleaned no more."""
    k = known.select(*[F.col(c).alias(f"k_{c}") for c in keys], F.col("cleaned").alias("k_cleaned"))
    same = F.size(F.array_except("k_cleaned", "cleaned")) == 0
    for c in keys:
        same = (F.col(c) == F.col(f"k_{c}")) & same
    return found.distinct().join(k.hint("merge"), same, "left_anti")


#: A file's rows as tasks get them: `what` they are, and what that needs. types are joined by line feeds.
_ROWS = {"what": "string", "func": "string", "a": "string", "b": "string", "idx": "int", "callee": "string", "to_idx": "int", "types": "string"}


def _row(df: DataFrame, what: str, **given: Column | str) -> DataFrame:
    one = lambda c: F.col(given[c]) if isinstance(given.get(c), str) else given.get(c, F.lit(None))
    return df.select(F.lit(what).alias("what"), *[one(c).cast(t).alias(c) for c, t in _ROWS.items() if c != "what"])


def _joined(types: str = "cleaned") -> Column:
    return F.array_join(types, "\n")


def _across(rows: DataFrame, solve: Callable[[pd.DataFrame], pd.DataFrame], schema: str, told: Callable[[DataFrame], DataFrame], news: Callable[[DataFrame, DataFrame], DataFrame], heard: Callable[[DataFrame, str], DataFrame], by_rounds: Callable[[DataFrame, DataFrame | None], DataFrame]) -> DataFrame:
    """What solve finds in rows (_ROWS), many files in a task, until files have nothing to tell each other.

    told: what the found rows say of functions (callee is `*:name`). What of this is new, by news, goes to the files that
    call one of these: they are solved once more with all that they have heard (heard), and only what that adds is found.
    So there is a round for each call from file to file, not for each move. Files of more than LOCAL rows go by by_rounds.
    """
    rows = rows.where("func IS NOT NULL").withColumn("file", F.regexp_extract("func", r"(?s)^(.*):", 1)).withColumn("part", F.col("file"))
    small, large = graphs._bucketed(cut(rows), graphs.LOCAL)
    cross = lambda df, *c: cut(df.where("startswith(callee, '*:')").select(*c).distinct())
    called, far = cross(small, "file", "bucket", "callee"), None if large is None else cross(large, "file", "callee")
    names = called.select("callee") if far is None else called.select("callee").unionByName(far.select("callee"))
    names = cut(names.distinct())
    found, past, now = None, None, None
    while True:
        if past is None and now is None:
            todo, old = small, large
        else:
            hit = called.join(now.select("callee").distinct(), "callee", "left_semi").select("file").distinct()
            at = called.join(hit, "file", "left_semi").select("bucket", "callee").distinct()
            ext = heard(now, "new") if past is None else heard(now, "new").unionByName(heard(past, "known"))
            todo = small.join(hit.hint("merge"), "file", "left_semi").unionByName(ext.join(at.hint("merge"), "callee"), allowMissingColumns=True)
            old = large
        fresh = _solved(todo.drop("file"), solve, schema)
        if old is not None:
            every = now if past is None else past.unionByName(now)
            more = by_rounds(old.drop("file"), every).distinct()
            fresh = fresh.unionByName(more if found is None else more.join(found.rows, more.columns, "left_anti"))
        fresh = cut(fresh)
        if found is None:
            found = _Known(fresh)
        else:
            found.add(fresh)
        said = told(fresh).join(names, "callee", "left_semi").distinct()
        past = now if past is None or now is None else cut(past.unionByName(now))
        now = cut(said if past is None else news(said, past))
        if now.isEmpty():
            return found.rows


def facts(p: Program) -> DataFrame:
    """(func, origin, node, cleaned): what reaches each node. origin: `param:idx` of its function, or `source:name`, taken in the function or in one that it calls. Files are solved in tasks, as `_across` goes."""
    rows = _row(p.params, "param", func="func", a="node", b=F.concat(F.lit("param:"), F.col("idx").cast("string")))
    rows = rows.unionByName(_row(p.seeds, "seed", func="func", a="node", b=F.concat(F.lit("source:"), "source")))
    rows = rows.unionByName(_row(p.moves, "move", func="func", a="src", b="dst", types=_joined()))
    rows = rows.unionByName(_row(p.args, "arg", func="func", a="node", b="value", idx="idx", callee="callee"))
    split = lambda df: df.withColumn("cleaned", F.filter(F.split("cleaned", "\n"), lambda t: t != ""))
    told = lambda df: split(df.where(F.col("node") == RETURN).select(_anywhere("func").alias("callee"), "origin", "cleaned"))
    heard = lambda df, what: _row(df, what, callee="callee", a="origin", types=_joined()).drop("func")

    def by_rounds(large: DataFrame, ext: DataFrame | None) -> DataFrame:
        of = lambda what, **names: large.where(F.col("what") == what).select("func", *[F.col(c).alias(n) for n, c in names.items()])
        own = p._replace(params=of("param", node="a", origin="b"), seeds=of("seed", node="a", origin="b"), moves=split(of("move", src="a", dst="b", cleaned="types")), args=of("arg", callee="callee", idx="idx", node="a", value="b"))
        return _facts_by_rounds(own, ext).withColumn("cleaned", _joined())

    return split(_across(rows, _facts_of, "func string, origin string, node string, cleaned string", told, lambda new, old: _news(new, old, ["callee", "origin"]), heard, by_rounds))


def _anywhere(func: str) -> Column:
    """A function as calls from other files name it."""
    return F.concat(F.lit("*:"), F.element_at(F.split(func, ":"), -1))


class _Sets:
    """Sets of types as bits."""

    def __init__(self):
        self.bits, self.masks = {}, {"": 0, None: 0}

    def of(self, joined: str | None) -> int:
        if joined not in self.masks:
            self.masks[joined] = sum(1 << self.bits.setdefault(t, len(self.bits)) for t in joined.split("\n"))
        return self.masks[joined]

    def names(self, mask: int) -> str:
        return "\n".join(sorted(t for t, i in self.bits.items() if mask >> i & 1))


def _least(masks: list[int], mask: int) -> bool:
    """Puts mask among masks, none of which has all of another's; whether that is news."""
    if any(m & mask == m for m in masks):
        return False
    masks[:] = [m for m in masks if m & mask != mask] + [mask]
    return True


def _new_rows(frame: pd.DataFrame) -> tuple[list[tuple], list[tuple]]:
    """The rows of a frame, and those of them that have been heard just now."""
    rows = list(zip(*(frame[c].tolist() for c in _ROWS), strict=True))
    return [r for r in rows if r[0] != "new"], [r for r in rows if r[0] == "new"]


def _facts_of(frame: pd.DataFrame) -> pd.DataFrame:
    """The facts of a bucket's files; of files that have heard something new those that this adds."""
    rows, new = _new_rows(frame)
    sets, at, nodes = _Sets(), {}, []
    after, known, handed, taken = defaultdict(dict), defaultdict(dict), defaultdict(set), defaultdict(set)
    work, added = [], []

    def node(func: str, name: str) -> int:
        if (i := at.setdefault((func, name), len(nodes))) == len(nodes):
            nodes.append((func, name))
        return i

    def add(i: int, origin: str, mask: int) -> None:
        if _least(known[i].setdefault(origin, []), mask):
            work.append((i, origin, mask))

    def returned(callee: str, origin: str, mask: int) -> None:
        if origin.startswith("param:"):
            for src, dst in handed.get((callee, int(origin[6:])), ()):
                if _least(after[src].setdefault(dst, []), mask):
                    for o, masks in list(known[src].items()) if src in known else ():
                        for m in list(masks):
                            add(dst, o, m | mask)
        else:
            for dst in taken.get(callee, ()):
                add(dst, origin, mask)

    def settle() -> None:
        while work:
            i, origin, mask = work.pop()
            added.append((i, origin, mask))
            for dst, masks in list(after[i].items()) if i in after else ():
                for m in masks:
                    add(dst, origin, mask | m)
            func, name = nodes[i]
            if name == RETURN:
                returned(func, origin, mask)

    heard = []
    for what, func, a, b, idx, callee, _, types in rows:
        if what == "move":
            _least(after[node(func, a)].setdefault(node(func, b), []), sets.of(types))
        elif what == "arg":
            handed[callee, int(idx)].add((node(func, a), node(func, b)))
            taken[callee].add(node(func, b))
        elif what == "known":
            heard.append((callee, a, sets.of(types)))
    for what, func, a, b, *_ in rows:
        if what in ("param", "seed"):
            add(node(func, a), b, 0)
    for h in heard:
        returned(*h)
    settle()
    if new:
        added.clear()
        for _, _, a, _, _, callee, _, types in new:
            returned(callee, a, sets.of(types))
        settle()
    told = [(*nodes[i], o, m) for i, o, m in added if m in known[i][o]]
    return pd.DataFrame({"func": [t[0] for t in told], "origin": [t[2] for t in told], "node": [t[1] for t in told], "cleaned": [sets.names(t[3]) for t in told]})


def _facts_by_rounds(p: Program, ext: DataFrame | None) -> DataFrame:
    """`facts` by rounds of joins, of a program whose params and seeds have origins, with what returns from elsewhere (callee, origin, cleaned)."""
    none = F.array().cast("array<string>")
    fresh = cut(p.params.unionByName(p.seeds).select("func", "origin", "node", none.alias("cleaned")).distinct())
    known, moved = _Known(fresh), _Known(p.moves)
    keys = ["func", "origin", "node"]
    over = lambda facts, moves: facts.join(moves.select("func", F.col("src").alias("node"), "dst", F.col("cleaned").alias("more")), ["func", "node"]).select("func", "origin", F.col("dst").alias("node"), _with("cleaned", "more").alias("cleaned"))
    while ext is not None or not fresh.isEmpty():
        found = over(fresh, moved.rows)
        out = _both(fresh.where(F.col("node") == RETURN).select("func", "origin", "cleaned"))
        out, ext = cut(out if ext is None else out.unionByName(ext)), None
        given = out.where("origin LIKE 'param:%'").select("callee", F.substring("origin", 7, 9).cast("int").alias("idx"), "cleaned")
        steps = p.args.join(given, ["callee", "idx"]).select("func", F.col("node").alias("src"), F.col("value").alias("dst"), "cleaned")
        steps = cut(_news(steps, moved.rows, ["func", "src", "dst"]))
        taken = p.args.select("func", "callee", "value").distinct().join(out.where("origin LIKE 'source:%'"), "callee").select("func", "origin", F.col("value").alias("node"), "cleaned")
        found = found.unionByName(over(known.rows, steps)).unionByName(taken)
        fresh = cut(_news(found, known.rows, keys))
        moved.add(steps)
        known.add(fresh)
    return known.rows


def parameters_to_sinks(p: Program, known: DataFrame) -> DataFrame:
    """(func, idx, vuln_type): parameters that reach a sink of the type, not made harmless for it, in the function or through those that it calls. Files are solved in tasks, as `_across` goes."""
    given = known.where("origin LIKE 'param:%'").select("func", F.substring("origin", 7, 9).cast("int").alias("idx"), "node", "cleaned")
    direct = given.join(p.sinks, ["func", "node"]).where(~F.array_contains("cleaned", F.col("vuln_type"))).select("func", "idx", "vuln_type").distinct()
    a = p.args.select("func", "node", "callee", F.col("idx").alias("callee_idx"))
    handed = given.join(a, ["func", "node"]).select("func", "idx", "callee", "callee_idx", "cleaned").distinct()
    rows = _row(direct, "sink", func="func", idx="idx", a="vuln_type").unionByName(_row(handed, "handed", func="func", idx="idx", callee="callee", to_idx="callee_idx", types=_joined()))
    told = lambda df: df.select(_anywhere("func").alias("callee"), "idx", "vuln_type")
    heard = lambda df, what: _row(df, what, callee="callee", to_idx="idx", a="vuln_type").drop("func")
    return _across(rows, _sinks_of, "func string, idx int, vuln_type string", told, lambda new, old: new.join(old, ["callee", "idx", "vuln_type"], "left_anti"), heard, _sinks_by_rounds)


def _sinks_of(frame: pd.DataFrame) -> pd.DataFrame:
    """What `_facts_of` is for facts, for parameters that reach sinks."""
    rows, new = _new_rows(frame)
    callers, known, work, added = defaultdict(list), set(), [], []

    def add(func: str, idx: int, t: str) -> None:
        if (func, idx, t) not in known:
            known.add((func, idx, t))
            work.append((func, idx, t))
            added.append((func, idx, t))

    def up(callee: str, idx: int, t: str) -> None:
        for func, i, cleaned in callers.get((callee, idx), ()):
            if t not in cleaned:
                add(func, i, t)

    def settle() -> None:
        while work:
            up(*work.pop())

    for what, func, _, _, idx, callee, to_idx, types in rows:
        if what == "handed":
            callers[callee, int(to_idx)].append((func, int(idx), frozenset(types.split("\n"))))
    for what, func, a, _, idx, callee, to_idx, _ in rows:
        if what == "sink":
            add(func, int(idx), a)
        elif what == "known":
            up(callee, int(to_idx), a)
    settle()
    if new:
        added.clear()
        for _, _, a, _, _, callee, to_idx, _ in new:
            up(callee, int(to_idx), a)
        settle()
    return pd.DataFrame(added, columns=["func", "idx", "vuln_type"])


def _sinks_by_rounds(large: DataFrame, ext: DataFrame | None) -> DataFrame:
    """`parameters_to_sinks` by rounds of joins, with what others' parameters reach (callee, idx, vuln_type)."""
    fresh = cut(large.where("what = 'sink'").select("func", "idx", F.col("a").alias("vuln_type")))
    handed = large.where("what = 'handed'").select("func", "idx", "callee", F.col("to_idx").alias("callee_idx"), F.split("types", "\n").alias("cleaned"))
    found = _Known(fresh)
    while ext is not None or not fresh.isEmpty():
        up = _both(fresh)
        up, ext = (up if ext is None else up.unionByName(ext)).withColumnRenamed("idx", "callee_idx"), None
        new = handed.join(up, ["callee", "callee_idx"]).where(~F.array_contains("cleaned", F.col("vuln_type"))).select("func", "idx", "vuln_type").distinct()
        fresh = cut(new.join(found.rows, ["func", "idx", "vuln_type"], "left_anti"))
        found.add(fresh)
    return found.rows


def findings(p: Program) -> DataFrame:
    """(func, line_no, vuln_type, source, callee): sources that reach a sink of the function (callee is null), or a parameter of a callee that does, and weren't made harmless for it.

    A sink is found at its line, a call at the line of the call. Lines of one function are in no order here: a variable
    has all that it is ever given.
    """
    known = cut(facts(p))
    sums = parameters_to_sinks(p, known)
    harmful = ~F.array_contains("cleaned", F.col("vuln_type"))
    taken = known.where("origin LIKE 'source:%'").select("func", F.substring("origin", 8, 99).alias("source"), "node", "cleaned")
    here = taken.join(p.sinks, ["func", "node"]).where(harmful).select("func", "line_no", "vuln_type", "source", F.lit(None).cast("string").alias("callee"))
    called = taken.join(p.args, ["func", "node"]).join(_both(sums), ["callee", "idx"]).where(harmful).select("func", "line_no", "vuln_type", "source", "callee")
    return here.unionByName(called).distinct()
