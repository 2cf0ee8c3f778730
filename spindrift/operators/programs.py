"""The PHP front end on files: (file_id, code) to rows of syntax, control flow, SSA, taint findings and types.

Each file is an interpreter's run of its own, in Arrow batches; nothing but its rows leaves the worker. Parser and
interpreter recurse, so they run in a thread whose stack holds DEPTH calls. A file that they fail on all the same gives
no rows, and one in `failed`; `parameters` raises an error that names it, if it is asked to be strict.
"""

from __future__ import annotations

import sys
import threading
from collections import Counter, defaultdict
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..php import flow, interpret, syntax
from ..sources import catalog


#: Calls that may be open at a time, and bytes of stack for them.
DEPTH, STACK = 400_000, 1 << 30


def _deep(f: Callable, *args):
    """f(*args) in a thread with a large stack; its memory is taken up only as far as it is used."""
    out, old_limit, old_size = [], sys.getrecursionlimit(), threading.stack_size(STACK)
    sys.setrecursionlimit(DEPTH)
    try:
        t = threading.Thread(target=lambda: out.append(f(*args)))
        t.start()
        t.join()
    finally:
        threading.stack_size(old_size)
        sys.setrecursionlimit(old_limit)
    return out[0]


def _made(codes: list[str | None], make: Callable[[syntax.Node], list[tuple]]) -> list[list[tuple] | Exception]:
    """What is made of each code, or what it fails with."""
    out = []
    for code in codes:
        try:
            out.append(make(syntax.parse(code or "")))
        except Exception as e:  # whatever a file makes the front end raise, the others are analysed; see `failed`
            out.append(e)
    return out


def _each(files: DataFrame, columns: str, make: Callable[[syntax.Node], list[tuple]], key: str, strict: bool = False) -> DataFrame:
    src = files.select(F.col(key), F.col("code"))
    kind = src.schema[0].dataType.simpleString()
    names = [key, *(c.split()[0] for c in columns.split(", "))]
    arrow = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64(), "array<string>": pa.list_(pa.string())}
    types = [arrow[c.split()[1]] for c in columns.split(", ")]

    def run(batches):
        for b in batches:
            at, rows = [], []
            for i, made in enumerate(_deep(_made, b.column(1).to_pylist(), make)):
                if not isinstance(made, Exception):
                    at += [i] * len(made)
                    rows += made
                elif strict:
                    raise RuntimeError(f"the front end fails on the file with {key} {b.column(0)[i].as_py()}: {type(made).__name__}: {made}") from made
            cols = list(zip(*rows, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names)

    return src.mapInArrow(run, f"`{key}` {kind}, {columns}")


def nodes(files: DataFrame, key: str = "file_id") -> DataFrame:
    """(node_id, parent_id, kind, value, line) of each file's tree, in preorder; the root's parent is -1."""

    def make(tree):
        out, stack = [], [(tree, -1)]
        while stack:
            n, parent = stack.pop()
            out.append((len(out), parent, n.kind, n.value, n.line))
            stack += [(c, len(out) - 1) for c in reversed(n.children)]
        return out

    return _each(files, "node_id int, parent_id int, kind string, value string, line int", make, key)


def failed(files: DataFrame, key: str = "file_id", rules_dir: str = catalog.OWN) -> DataFrame:
    """(key, error) of files that the front end fails on: those that have no rows in the other tables of this module."""
    rules = interpret.Rules.load(rules_dir)
    src = files.select(F.col(key), F.col("code"))

    def every(tree):
        for _, _, body, _ in flow.functions(tree):
            flow.Graph(body.children).phis()
            interpret.types(body)
        interpret.findings(tree, rules)
        return []

    def run(batches):
        for b in batches:
            said = [f"{type(x).__name__}: {x}" if isinstance(x, Exception) else None for x in _deep(_made, b.column(1).to_pylist(), every)]
            at = [i for i, x in enumerate(said) if x is not None]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array([said[i] for i in at], pa.string())], [key, "error"])

    return src.mapInArrow(run, f"`{key}` {src.schema[0].dataType.simpleString()}, error string")


def function_rows(files: DataFrame, key: str = "file_id") -> DataFrame:
    """(name, idx, param, line): a row for each parameter, and one with idx -1 for each function."""
    return _each(files, "name string, idx int, param string, line int", lambda t: [(n, i, p, line) for n, params, _, line in flow.functions(t) for i, p in [(-1, ""), *enumerate(params)]], key)


def _calls(tree: syntax.Node) -> list[tuple[str, str, int, int, str]]:
    out = []
    for name, _, body, _ in flow.functions(tree):
        inner = {id(x) for n in body.walk() if n.kind == "function" and n is not body for x in n.walk()}
        for n in body.walk():
            if n.kind == "call" and id(n) not in inner:
                out += [(name, n.value, n.line, i, a) for i, a in [(-1, ""), *((i, c.value if c.kind == "var" else "") for i, c in enumerate(n.children))]]
    return out


def calls(files: DataFrame, key: str = "file_id") -> DataFrame:
    """(caller, callee, line, idx, arg): arguments that are plain variables by name, others empty; idx -1 for the call itself."""
    return _each(files, "caller string, callee string, line int, idx int, arg string", _calls, key)


def parameters(files: DataFrame, key: str = "file_id", rules_dir: str = catalog.OWN, strict: bool = False) -> DataFrame:
    """(func, idx, vuln_type, callee, callee_idx): what functions do with their parameters, each file being parsed once. A sink that one reaches (`findings`) has its type, and no callee; a call that one is handed to by its name (`calls`) has no type. If strict, a file that fails is an error, as it would look like one whose parameters reach nothing."""
    rules = interpret.Rules.load(rules_dir)

    def make(tree):
        at = defaultdict(set)
        for name, params, _, _ in flow.functions(tree):
            for i, p in enumerate(params):
                at[name, p].add(i)
        try:
            found = interpret.findings(tree, rules)
        except Exception:  # calls of a file that can't be interpreted count all the same; see `failed`
            if strict:
                raise
            found = []
        out = {(name, i, kind, None, None) for name, _, kind, _, _, source in found if source.startswith("param:") for i in at.get((name, source[6:]), ())}
        out |= {(name, i, None, callee, k) for name, callee, _, k, arg in _calls(tree) if arg for i in at.get((name, arg), ())}
        return list(out)

    return _each(files, "func string, idx int, vuln_type string, callee string, callee_idx int", make, key, strict)


def graphs(files: DataFrame, key: str = "file_id") -> DataFrame:
    """(name, blocks, edges, back_edges, phis) of each function."""

    def make(tree):
        out = []
        for name, _, body, _ in flow.functions(tree):
            g = flow.Graph(body.children)
            out.append((name, len(g.blocks), len(g.edges), g.back_edges(), sum(map(len, g.phis().values()))))
        return out

    return _each(files, "name string, blocks int, edges int, back_edges int, phis int", make, key)


def edges(files: DataFrame, key: str = "file_id") -> DataFrame:
    """(name, src, dst, idom) of each function's blocks; idom is the immediate dominator of dst, -1 where it can't be reached."""

    def make(tree):
        out = []
        for name, _, body, _ in flow.functions(tree):
            g = flow.Graph(body.children)
            idom = g.dominators()
            out += [(name, a, b, idom.get(b, -1)) for a, b in sorted(g.edges)]
        return out

    return _each(files, "name string, src int, dst int, idom int", make, key)


def findings(files: DataFrame, key: str = "file_id", rules_dir: str = catalog.OWN) -> DataFrame:
    """(name, line, vuln_type, sink, confidence, source) by abstract interpretation of each function."""
    rules = interpret.Rules.load(rules_dir)
    return _each(files, "name string, line int, vuln_type string, sink string, confidence double, source string", lambda t: interpret.findings(t, rules), key)


def passed(files: DataFrame, key: str = "file_id", rules_dir: str = catalog.OWN) -> DataFrame:
    """(name, line, callee, idx, source, cleaned): arguments of calls that a source, or a parameter of the function (param:its name), reaches, and the types that it was made harmless for."""
    rules = interpret.Rules.load(rules_dir)
    return _each(files, "name string, line int, callee string, idx int, source string, cleaned array<string>", lambda t: [(*x[:-1], list(x[-1])) for x in interpret.passed(t, rules)], key)


def types(files: DataFrame, key: str = "file_id") -> DataFrame:
    """(name, var, types) of each function's variables; types sorted, joined by |."""
    return _each(files, "name string, var string, types string", lambda t: [(n, v, "|".join(sorted(k))) for n, _, body, _ in flow.functions(t) for v, k in sorted(interpret.types(body).items())], key)


def kinds(files: DataFrame, key: str = "file_id") -> DataFrame:
    """(kind, n) of each file's tree."""
    return _each(files, "kind string, n int", lambda t: sorted(Counter(n.kind for n in t.walk()).items()), key)


def versions(files: DataFrame, key: str = "file_id") -> DataFrame:
    """(name, var, line, version, is_phi) of static single assignment: a variable's counter grows with each definition, in preorder of the dominator tree; phis come first in their block."""

    def make(tree):
        out = []
        for name, _, body, _ in flow.functions(tree):
            g = flow.Graph(body.children)
            children, phis, count = {}, g.phis(), Counter()
            for b, d in sorted(g.dominators().items()):
                children.setdefault(d, []).append(b)
            todo = [0]
            while todo:
                b = todo.pop()
                line = next((s.line for s in g.blocks[b].statements), 0)
                for v in sorted(phis.get(b, ())):
                    out.append((name, v, line, count[v], 1))
                    count[v] += 1
                for s in g.blocks[b].statements:
                    for v in flow.defined(s):
                        out.append((name, v, s.line, count[v], 0))
                        count[v] += 1
                todo += reversed(children.get(b, []))
        return out

    rows = _each(files, "name string, var string, line int, version int, phi int", make, key)
    return rows.select(key, "name", "var", "line", "version", (F.col("phi") == 1).alias("is_phi"))
