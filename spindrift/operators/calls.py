"""Calls on lines: their names and arguments, and what the rule catalog says of them.

Expressions are put together as SQL text, which Spark parses once: catalogs make long ones. Names of columns are given as text.
Loops in patterns are possessive: they never try again, and Java runs them without recursion, whatever a line's length.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources import catalog

_STRING = r"\"(?:[^\"\\]++|\\.)*+\"|'(?:[^'\\]++|\\.)*+'"


def _nested(depth: int) -> str:
    within = rf"|\((?:{_nested(depth - 1)})*+\)|\[(?:{_nested(depth - 1)})*+\]" if depth else ""
    return rf"[^()\[\]\"']++|{_STRING}{within}"


#: What stands within brackets, and one argument: text and strings, with brackets within brackets three deep.
INNER = _nested(2)
ARGUMENT = rf"(?:[^,()\[\]\"']++|{_STRING}|\((?:{INNER})*+\)|\[(?:{INNER})*+\])*+"
#: A call, as a function or (group 1) of an object or class: name and arguments. Calls within arguments are found as well.
CALL = rf"(?:(->|::)\s*+|(?<![\w$>:]))([A-Za-z_]\w*+)\s*+\((?=({ARGUMENT}(?:,{ARGUMENT})*+))"
#: What takes an expression without being a function, and a command in backticks.
CONSTRUCTS = ["echo", "print", "include", "include_once", "require", "require_once", "exit", "die"]
CONSTRUCT = rf"(?i)(?<![\w$>:])({'|'.join(sorted(CONSTRUCTS, reverse=True))})\b\s*+((?:[^;\"']++|{_STRING})*+)"
BACKTICK = r"`([^`]*+)`"
#: A cast that leaves a number or a truth value, with what it is applied to.
CAST = r"\(\s*+(?:int|integer|float|double|bool|boolean)\s*+\)\s*+\$\w++(?:\[[^\]]*+\]|->\w++)*+"
VARIABLE = r"\$(\w+)"
#: Names that programs give to functions that clean.
CUSTOM = "sanitize|escape|clean|filter|safe|valid"


def _q(text: str) -> str:
    """text as a literal of SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def calls_sql(text: str) -> str:
    """`calls` as SQL, to be part of more."""
    every = lambda p, i: f"regexp_extract_all({text}, {_q(p)}, {i})"
    known = f"transform(arrays_zip({every(CALL, 1)}, {every(CALL, 2)}, {every(CALL, 3)}), c -> named_struct('name', concat(if(c.`0` <> '', '->', ''), lower(c.`1`)), 'args', c.`2`))"
    known = f"filter({known}, c -> c.name NOT IN ({', '.join(map(_q, CONSTRUCTS))}))"
    built = f"transform(arrays_zip({every(CONSTRUCT, 1)}, {every(CONSTRUCT, 2)}), c -> named_struct('name', lower(c.`0`), 'args', c.`1`))"
    ticks = f"transform({every(BACKTICK, 1)}, c -> named_struct('name', 'backtick', 'args', c))"
    return f"concat({known}, {built}, {ticks})"


def _argument(args: str, at: str, most: int = 3) -> str:
    cases = " ".join(f"WHEN {k} THEN regexp_extract({args}, {_q(f'^(?:{ARGUMENT},){{{k}}}({ARGUMENT})')}, 1)" for k in range(most + 1))
    return f"trim(CASE {at} WHEN -1 THEN {args} {cases} END)"


def calls(text: str = "text") -> Column:
    """array<struct<name, args>> of a line, names in small letters, `->` before those of methods; for constructs args is the whole expression."""
    return F.expr(calls_sql(text))


def argument(args: str, at: str, most: int = 3) -> Column:
    """The argument at a place from 0, up to `most`; at -1 it is the whole text."""
    return F.expr(_argument(args, at, most))


@lru_cache
def sink_rules(rules_dir: str = catalog.OWN) -> dict[str, list[tuple[str, str, int]]]:
    """By name as `calls` gives it: (vuln_type, severity, argument). A name with :: is a method of that name."""
    out: dict[str, list[tuple[str, str, int]]] = {}
    for r in catalog.rows("sinks", rules_dir):
        name = r["name"].lower()
        at = -1 if name in CONSTRUCTS or name == "backtick" else r.get("arg") or 0
        keys = ["->" + name.split("::")[1]] if "::" in name else ["->" + name] if r.get("method") else [name]
        for k in keys:
            if (rule := (r["vuln_type"], r["severity"], at)) not in out.setdefault(k, []):
                out[k].append(rule)
    return out


@lru_cache
def sanitizers(rules_dir: str = catalog.OWN) -> dict[str, tuple[str, ...]]:
    """By name in small letters: the types that it makes a value harmless for."""
    out: dict[str, tuple[str, ...]] = {}
    for r in catalog.rows("sanitizers", rules_dir):
        out[r["name"].lower()] = tuple(sorted({*out.get(r["name"].lower(), ()), *r["protects"]}))
    return out


@lru_cache
def all_types(rules_dir: str = catalog.OWN) -> tuple[str, ...]:
    return tuple(sorted({r["vuln_type"] for r in catalog.rows("sinks", rules_dir)} | {t for ts in sanitizers(rules_dir).values() for t in ts}))


def _map(entries: dict[str, str], name: str) -> str:
    return f"map({', '.join(f'{_q(k)}, {v}' for k, v in entries.items())})[{name}]"


def _sinks(name: str, rules_dir: str) -> str:
    one = lambda rules: "array(" + ", ".join(f"named_struct('vuln_type', {_q(t)}, 'severity', {_q(s)}, 'arg', {a})" for t, s, a in rules) + ")"
    return _map({k: one(rules) for k, rules in sink_rules(rules_dir).items()}, name)


def _types(ts) -> str:
    return "array(" + ", ".join(map(_q, ts)) + ")"


def _cleans(name: str, rules_dir: str) -> str:
    known = _map({k: _types(ts) for k, ts in sanitizers(rules_dir).items()}, f"lower({name})")
    return f"coalesce({known}, if(lower({name}) RLIKE {_q(CUSTOM)}, {_types(all_types(rules_dir))}, NULL), cast(array() AS array<string>))"


def _uncleaned(text: str, vuln_type: str, rules_dir: str) -> str:
    cases = []
    for t in all_types(rules_dir):
        names = sorted(n for n, ts in sanitizers(rules_dir).items() if t in ts)
        pattern = rf"(?i){CAST}" + (rf"|(?<![\w$])(?:{'|'.join(names)})\s*+\((?:{INNER})*+\)" if names else "")
        cases.append(f"WHEN {_q(t)} THEN regexp_replace({text}, {_q(pattern)}, ' ')")
    return f"CASE {vuln_type} {' '.join(cases)} ELSE regexp_replace({text}, {_q(f'(?i){CAST}')}, ' ') END"


def _variables(text: str) -> str:
    return f"array_distinct(regexp_extract_all({text}, {_q(VARIABLE)}, 1))"


def sinks(name: str, rules_dir: str = catalog.OWN) -> Column:
    """array<struct<vuln_type, severity, arg>> of a call's name; null for what is no sink."""
    return F.expr(_sinks(name, rules_dir))


def cleans(name: str, rules_dir: str = catalog.OWN) -> Column:
    """The types that a call of this name makes a value harmless for: all of them if the name says that it cleans and the catalog doesn't know better."""
    return F.expr(_cleans(name, rules_dir))


def uncleaned(text: str, vuln_type: str, rules_dir: str = catalog.OWN) -> Column:
    """An expression without what is cast, or handed to a function that makes it harmless for the type."""
    return F.expr(_uncleaned(text, vuln_type, rules_dir))


def variables(text: str) -> Column:
    return F.expr(_variables(text))


def sink_variables(text: str = "text", rules_dir: str = catalog.OWN) -> Column:
    """array<struct<var, vuln_type, severity>>: the variables of a line that stand, uncleaned, in arguments that do harm."""
    found = f"transform(filter({calls_sql(text)}, c -> {_sinks('c.name', rules_dir)} IS NOT NULL), c -> named_struct('args', c.args, 'sinks', {_sinks('c.name', rules_dir)}))"
    of = f"transform({_variables(_uncleaned(_argument('c.args', 's.arg'), 's.vuln_type', rules_dir))}, v -> named_struct('var', v, 'vuln_type', s.vuln_type, 'severity', s.severity))"
    return F.expr(f"array_distinct(flatten(transform({found}, c -> flatten(transform(c.sinks, s -> {of})))))")


def may_sink(text: str = "text", rules_dir: str = catalog.OWN) -> Column:
    """Whether a line holds a variable and a sink's name at all; false for most lines, and cheap."""
    names = sorted({k.removeprefix("->") for k in sink_rules(rules_dir)} - {"backtick"}, key=lambda n: (-len(n), n))
    pattern = rf"(?i)\b(?:{'|'.join(names)})\b"
    return F.expr(f"contains({text}, '$') AND ({text} RLIKE {_q(pattern)} OR contains({text}, '`'))")
