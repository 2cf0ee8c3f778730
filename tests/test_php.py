"""The PHP front end: syntax, control flow, dominators, SSA, taint and types."""

import duckdb
import pytest

from spindrift.operators import programs
from spindrift.php import flow, interpret, syntax
from spindrift.plans import more_queries  # noqa: F401
from spindrift.registry import QUERIES, SQL

RULES = interpret.Rules.load()


def graph(code):
    return flow.Graph(syntax.parse("<?php " + code).children)


def found(code):
    return {(line, kind) for _, line, kind, _, _, _ in interpret.findings(syntax.parse("<?php " + code), RULES)}


@pytest.mark.parametrize("code", ["", "<?php if (", "<?php }}}}", "<?php $a = [1,2", "<?php function", "<?php foo(((", "text only", "<?php <<<X\nabc $d\nX;\necho 1;", "<?php match($x) { 1 => 2 };", "<?php @$a?->b::$c[1]++;", "<?php /* open", "<?php 'open", "\x00\xff"])
def test_anything_parses(code):
    tree = syntax.parse(code)
    interpret.findings(tree, RULES)
    interpret.types(tree)


def test_lines_and_precedence():
    tree = syntax.parse("<?php\n$a = 1 + 2 * 3 . 'x';\n\nfoo($b, fn($x) => $x);")
    assign = tree.children[0].children[0]
    assert (assign.kind, assign.line, assign.children[1].value) == ("assign", 2, ".")
    call = tree.children[1].children[0]
    assert (call.kind, call.value, call.line, len(call.children)) == ("call", "foo", 4, 2)


def test_interpolation_and_html():
    tree = syntax.parse("<b>hi</b><?= $x ?>text<?php echo \"a $y\"; echo '$z';")
    assert [n.value for n in tree.walk() if n.kind == "var"] == ["x", "y"]


def test_if_loop_switch_try():
    g = graph("if ($a) { f(); } else { g(); } h();")
    assert len(g.blocks) == 6 and len(g.edges) == 6
    assert graph("while ($a) { f(); }").back_edges() == 1
    assert graph("for ($i = 0; $i < 3; $i++) { if ($i) continue; f(); }").back_edges() >= 1
    assert graph("do { f(); } while ($a);").back_edges() == 1
    g = graph("switch ($a) { case 1: f(); case 2: g(); break; default: h(); } k();")
    assert (4, 5) in g.edges  # falls through
    assert len(graph("try { f(); } catch (E $e) { g(); } finally { h(); }").blocks) >= 6
    assert graph("return 1; f();").order()[-1] == 1


def test_dominators_and_phis():
    g = graph("$x = 1; if ($a) { $x = 2; } echo $x;")
    idom = g.dominators()
    assert idom[2] == 0 and idom[3] == 2 and idom[4] == 2
    assert g.phis() == {4: {"x"}}
    assert "i" in graph("$i = 0; while ($i < 3) { $i++; }").phis()[3]


def test_dominators_by_definition():
    """A block's dominators are those without which it can't be reached."""
    g = graph("while ($a) { if ($b) { f(); break; } elseif ($c) { continue; } else { g(); } } try { h(); } catch (E $e) { return 1; } switch ($d) { case 1: k(); default: l(); }")
    idom = g.dominators()
    after = {a: {y for x, y in g.edges if x == a} for a in range(len(g.blocks))}

    def reach(without):
        seen, work = set(), [0] if without != 0 else []
        while work:
            b = work.pop()
            if b not in seen and b != without:
                seen.add(b)
                work += after[b]
        return seen

    every = reach(None)
    for b in every - {0}:
        chain, x = set(), b
        while x:
            x = idom[x]
            chain.add(x)
        assert chain == {d for d in every - {b} if b not in reach(d)}


def test_taint():
    assert found("$a = $_GET['a']; echo $a;") == {(1, "XSS")}
    assert found("$a = intval($_GET['a']); echo $a;") == set()
    assert found("$a = (int) $_GET['a']; mysql_query(\"x $a\");") == set()
    assert found("$a = $_GET['a'];\nif ($c) { $a = htmlspecialchars($a); }\necho $a;") == {(3, "XSS")}
    assert found("$a = $_GET['a'];\nif ($c) { $a = 1; } else { $a = 2; }\necho $a;") == set()
    assert found("$a = htmlspecialchars($_GET['a']); echo $a; system($a);") == {(1, "COMMAND_INJECTION")}
    assert found("foreach ($_POST as $v) { eval($v); }") == {(1, "CODE_INJECTION")}
    assert found("while ($x) { echo $b; $b = $a; $a = $_GET['a']; }") == {(1, "XSS")}
    assert found("mysqli_query($conn, $_GET['q']);") == {(1, "SQL_INJECTION")}
    assert found("mysqli_query($_GET['c'], 'SELECT 1');") == set()
    assert found("echo $a; $a = $_GET['a'];") == set()
    assert found("function f($p) { $this->db->query($p); }") == {(1, "SQL_INJECTION")}


def test_types():
    t = interpret.types(syntax.parse("<?php $a = 1; $b = 'x' . $a; if ($c) { $a = 1.5; } $d = $a + 1; $e = [1]; $f = (bool) $a; $g = strlen($b);"))
    assert t == {"a": {"INT", "FLOAT"}, "b": {"STRING"}, "d": {"INT", "FLOAT"}, "e": {"ARRAY"}, "f": {"BOOL"}, "g": {"INT"}}


def test_rows(spark):
    files = spark.createDataFrame([(1, "<?php function f($a, $b) { return g($a); } f($_GET['x'], 2);"), (2, None), (3, "")], "file_id long, code string")
    assert {(r.name, r.idx, r.param) for r in programs.function_rows(files).where("file_id = 1").collect()} == {("{main}", -1, ""), ("f", -1, ""), ("f", 0, "a"), ("f", 1, "b")}
    assert {(r.caller, r.callee, r.idx, r.arg) for r in programs.calls(files).where("file_id = 1").collect()} == {("f", "g", -1, ""), ("f", "g", 0, "a"), ("{main}", "f", -1, ""), ("{main}", "f", 0, ""), ("{main}", "f", 1, "")}
    n = programs.nodes(files).where("file_id = 1")
    assert n.where("parent_id = -1").count() == 1 and n.join(n.selectExpr("node_id as parent_id"), "parent_id", "left_semi").count() == n.count() - 1
    assert programs.graphs(files).count() == 4 and programs.findings(files).count() == 0


def test_parameters_of_one_parse(spark):
    """What function_rows, findings and calls say together; a file that can't be interpreted has its calls all the same."""
    many = "function m($p) { " + "".join(f"while ($c{i}) {{ " for i in range(60)) + "g($p); " + "} " * 60 + "}"
    codes = ["<?php function f($a, $b, $c) { mysql_query($b); g($a, 1, $b); g($a, 2, $b); h($x); if ($a) { echo $c; } } function g($p) { f($p[0], $p, $p); }", "function f($a) { $f = function ($q) { k($q); eval($q); }; } f($a);", many, None, ""]
    files = spark.createDataFrame(list(enumerate(codes)), "file_id long, code string")
    params = programs.function_rows(files).where("idx >= 0").selectExpr("file_id", "name AS func", "param", "idx")
    direct = programs.findings(files).where("source LIKE 'param:%'").selectExpr("file_id", "name AS func", "substring(source, 7) AS param", "vuln_type", "CAST(NULL AS STRING) AS callee", "CAST(NULL AS INT) AS callee_idx")
    passed = programs.calls(files).where("idx >= 0 AND arg <> ''").selectExpr("file_id", "caller AS func", "arg AS param", "CAST(NULL AS STRING) AS vuln_type", "callee", "idx AS callee_idx")
    want = direct.unionByName(passed).join(params, ["file_id", "func", "param"]).select("file_id", "func", "idx", "vuln_type", "callee", "callee_idx").distinct()
    rows = [tuple(r) for r in programs.parameters(files).collect()]
    assert len(rows) == len(set(rows)) and set(rows) == {tuple(r) for r in want.collect()}
    assert {(0, "f", 1, "SQL_INJECTION", None, None), (0, "f", 2, "XSS", None, None), (0, "f", 1, None, "g", 2), (1, "{closure}", 0, None, "k", 0), (2, "m", 0, None, "g", 0)} <= set(rows)


def test_parameters_of_what_is_not_interpreted(spark, monkeypatch):
    monkeypatch.setattr(interpret.Rules, "load", staticmethod(lambda *a: None))  # calls can't be judged without rules
    files = spark.createDataFrame([(1, "<?php function f($a) { g($a); }")], "file_id long, code string")
    assert programs.findings(files).collect() == []
    assert [(r.func, r.idx, r.callee, r.callee_idx) for r in programs.parameters(files).collect()] == [("f", 0, "g", 0)]


@pytest.mark.parametrize("fails", ["parse", "findings"])
def test_a_failure_is_no_result_of_summaries(spark, monkeypatch, tmp_path, fails):
    """A file that can't be parsed or interpreted ends g20_project_summaries with an error that names it."""
    spark.createDataFrame([(101, 18)], "event_id long, user_id long").write.parquet(str(tmp_path / "events.parquet"))
    assert [r.func for r in QUERIES["g20_project_summaries"](spark, str(tmp_path)).collect()] == ["f18"]
    loaded = interpret.Rules.load
    if fails == "parse":
        monkeypatch.setattr(programs, "_made", lambda codes, make: [ValueError("no") for _ in codes])
    else:
        monkeypatch.setattr(interpret.Rules, "load", staticmethod(lambda *a: interpret.Rules({**loaded().sinks, "mysql_query": ("SQL_INJECTION",)})))  # a sink's rule of the wrong length
    with pytest.raises(Exception, match="fails on the file with file_id 18: ValueError"):
        QUERIES["g20_project_summaries"](spark, str(tmp_path)).collect()


def test_loops_come_to_rest_without_a_bound():
    """What takes any number of rounds through a loop gets there, and stays clean on its way."""
    copies = " ".join(f"$v{i} = $v{i + 1};" for i in range(150))
    assert found(f"function f($p) {{ while ($c) {{ mysql_query($v0); {copies} $v150 = $p; }} }}") == {(1, "SQL_INJECTION")}
    assert found(f"function f($p) {{ while ($c) {{ echo $v0; system($v0); {copies} $v150 = htmlspecialchars($p); }} }}") == {(1, "COMMAND_INJECTION")}
    assert found("function f($p) { $a = htmlspecialchars('x'); $b = 1; while ($c) { $t = $a; $a = $b; $b = $t; } mysql_query($p); }") == {(1, "SQL_INJECTION")}
    assert found(f"while ($c) {{ mysql_query($w); $t = $a; $a = $b; $b = $t; $w = $v0; if ($d) {{ $a = $v0; }} {copies} $v150 = $_GET['x']; }}") == {(1, "SQL_INJECTION")}


def test_summaries_of_odd_ids(spark, tmp_path):
    """Users and events without an id, with negative ones, and with more digits than a double has."""
    big = 9007199254740993
    rows = [(361, 7), (140, -8), (-180, 40), (141, None), (None, 31), (None, None), (620, 50), (-3, 60), (0, 0), (5, -5), (big * 20 + 19, big - 1), (360, big), (big + 6, 77), ((big + 6) // 20 * 20, 5), (363, 18)]
    spark.createDataFrame(rows, "event_id long, user_id long").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = db.execute(SQL["g20_project_summaries"]).fetchall()
    got = [tuple(r) for r in QUERIES["g20_project_summaries"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {(None, 0, "SQL_INJECTION"), ("f-8", 0, "SQL_INJECTION"), (f"f{big - 1}", 0, "SQL_INJECTION")} <= set(got)
