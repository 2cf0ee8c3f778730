"""Access paths: cells, kills, unknown keys, wrappers, bodies of requests."""

import pytest

from spindrift.operators import calls, paths

FILES = {
    "cell": ("$r['k'] = $_GET['x'];\n$r['l'] = 'safe';\necho $r['l'];\necho $r['k'];\necho $r;", {(4, "XSS", "_GET"), (5, "XSS", "_GET")}),
    "kill": ("$v = $_GET['x'];\n$v = 'a';\necho $v;\n$r['k'] = $_GET['x'];\n$r['k'] = 1;\necho $r['k'];\n$s['k'] = $_GET['x'];\n$s = [];\necho $s['k'];", set()),
    "again": ("$v = 'a';\necho $v;\n$v = $_POST['x'];\necho $v;\n$v = intval($v);\necho $v;\n$v = $_POST['y'];\necho $v;", {(4, "XSS", "_POST"), (8, "XSS", "_POST")}),
    "unknown": ("$r[$i] = $_COOKIE['c'];\necho $r['k'];\n$r['k'] = 'x';\n$q[] = $_GET['x'];\nmysql_query($q);\necho $q[0];", {(2, "XSS", "_COOKIE"), (5, "SQL_INJECTION", "_GET"), (6, "XSS", "_GET")}),
    "whole": ("$r = $_POST;\necho $r['k'];\n$r['k'] = htmlspecialchars($r['k']);\necho $r['k'];\nmysql_query($r['k']);\necho $r['l'];", {(2, "XSS", "_POST"), (5, "SQL_INJECTION", "_POST"), (6, "XSS", "_POST")}),
    "wrap": ("function param($n) {\nreturn $_REQUEST[$n];\n}\nfunction safe_param($n) {\nreturn intval($_REQUEST[$n]);\n}\n$a = param('a');\n$b = safe_param('b');\nsystem($a);\nsystem($b);", {(9, "COMMAND_INJECTION", "_REQUEST_WRAP")}),
    "body": ("$d = json_decode(file_get_contents('php://input'), true);\n$x = $d['name'];\necho \"Hi $x\";\necho (int) $d['n'];", {(3, "XSS", "_INPUT")}),
    "nested": ("$x = trim(htmlspecialchars($_GET['x']));\necho $x;\n$y = htmlspecialchars($_GET['y']) . $_GET['y'];\necho $y;\n$z .= $_GET['z'];\n$z .= 'end';\necho $z;", {(4, "XSS", "_GET"), (7, "XSS", "_GET")}),
    "inline": ("echo $_GET['a'];\necho htmlspecialchars($_GET['a']);\nmysql_query(htmlspecialchars($_GET['a']));", {(1, "XSS", "_GET"), (3, "SQL_INJECTION", "_GET")}),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(f, k, t) for f, (code, _) in FILES.items() for k, t in enumerate(code.split("\n"), 1)]
    got = paths.findings(paths.uses(spark.createDataFrame(rows, "file_id string, line_no int, text string"))).collect()
    return {f: {(r.line_no, r.vuln_type, r.origin) for r in got if r.file == f} for f in FILES}


@pytest.mark.parametrize("name", list(FILES))
def test_findings(found, name):
    assert found[name] == FILES[name][1]


def test_nothing(spark):
    assert paths.findings(paths.uses(spark.createDataFrame([], "file_id string, line_no int, text string"))).collect() == []


def test_intervals(spark):
    code = "$v = htmlspecialchars($_GET['x']);\n$r['k'] = $v;\n$r['l'] = 1;\n$v = $_GET['y'];\n$r['k'] = intval($v);\n$r = $u;"
    u = paths.uses(spark.createDataFrame([(1, k, t) for k, t in enumerate(code.split("\n"), 1)], "file_id int, line_no int, text string"))
    every, end = set(calls.all_types()), 2**31 - 1
    got = {(r.var, r.key, r.from_line, r.to_line): set(r.types) for r in paths.intervals(u).collect()}
    assert got == {
        ("v", "", 2, 4): {"XSS"}, ("r", "k", 3, 5): {"XSS"}, ("r", "l", 4, 6): every, ("v", "", 5, end): set(), ("r", "k", 6, 6): set(calls.sanitizers()["intval"]), ("r", "", 7, end): set(),
    }


def test_presink(spark):
    code = "$v = htmlspecialchars($_GET['x']);\necho $v;\nmysql_query($v);\n$v = $_GET['y'];\necho $v;\necho htmlspecialchars($v);\necho $never;\n$r['a'] = 'b';\necho $r['a'];"
    u = paths.uses(spark.createDataFrame([(1, k, t) for k, t in enumerate(code.split("\n"), 1)], "file_id int, line_no int, text string"))
    got = {(r.line_no, r.vuln_type, r.var, r.key): (r.assigned_at, r.is_clean) for r in paths.presink(u).collect()}
    assert got == {(2, "XSS", "v", ""): (1, True), (3, "SQL_INJECTION", "v", ""): (1, False), (5, "XSS", "v", ""): (4, False), (6, "XSS", "v", ""): (4, True), (7, "XSS", "never", ""): (0, False), (9, "XSS", "r", "a"): (8, True)}


def test_large_files(spark, monkeypatch):
    """Files that are too large for a task go by rounds, to the same end."""
    monkeypatch.setattr(paths.graphs, "LOCAL", 6)
    rows = [(f, k, t) for f, (code, _) in FILES.items() for k, t in enumerate(code.split("\n"), 1)]
    got = paths.findings(paths.uses(spark.createDataFrame(rows, "file_id string, line_no int, text string"))).collect()
    assert {(r.file, r.line_no, r.vuln_type, r.origin) for r in got} == {(f, *x) for f, (_, want) in FILES.items() for x in want}


def test_few_rounds(spark, monkeypatch):
    """A long way through a file's lines takes no round for each of them."""
    written, own = [], paths.cut
    monkeypatch.setattr(paths, "cut", lambda df: written.append(1) or own(df))
    code = "$v0 = $_GET['x'];\n" + "".join(f"$v{i + 1} = $v{i};\n" for i in range(20)) + "echo $v20;"
    u = paths.uses(spark.createDataFrame([("f", k, t) for k, t in enumerate(code.split("\n"), 1)], "file_id string, line_no int, text string"))
    assert [r.line_no for r in paths.findings(u).collect()] == [22]
    assert len(written) < 15
