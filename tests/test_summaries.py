"""Taint through calls: by small programs whose findings are known."""

import pytest

from spindrift.operators import summaries

FILES = {
    "escaped": "function find($id) {\n$q = \"a\" . $id;\nmysql_query($q);\n}\nfind(htmlspecialchars($_GET['id']));\nfind(intval($_GET['id']));\n",
    "source": "function src() {\nreturn $_POST['x'];\n}\n$v = src();\necho $v;\n",
    "identity": "function id($x) {\nreturn $x;\n}\necho id($_GET['x']);\n$y = id('constant');\necho $y;\n",
    "cleaned": "function clean($x) {\n$y = htmlspecialchars($x);\nreturn $y;\n}\necho clean($_GET['x']);\nmysql_query(clean($_GET['x']));\n",
    "chain": "function a($x) {\nb($x, 1);\n}\nfunction b($x, $n) {\nc(2, $x);\n}\nfunction c($n, $x) {\nsystem($x);\n}\na($_COOKIE['c']);\nb(1, $_COOKIE['c']);\n",
    "both": "function pick($x, $y) {\nif ($x) {\nreturn htmlspecialchars($x);\n}\nreturn $y;\n}\necho pick($_GET['a'], 'b');\necho pick('b', $_GET['a']);\n",
    "loop": "function even($x) {\nreturn odd($x);\n}\nfunction odd($x) {\nif ($x) {\nreturn $x;\n}\nreturn even($x);\n}\necho even($_GET['n']);\n",
    "calls": "$t = elsewhere($_GET['t']);\necho (int) $t;\necho $t;\n",
    "defines": "function elsewhere($x) {\nreturn trim($x);\n}\n",
    "two": "function same($x) {\nreturn $x;\n}\n$p = same($_GET['p']);\n$q = same('q');\necho $q;\n",
}
WANT = {
    ("escaped:", 5, "SQL_INJECTION", "_GET", "escaped:find"), ("source:", 5, "XSS", "_POST", None), ("identity:", 4, "XSS", "_GET", None), ("cleaned:", 6, "SQL_INJECTION", "_GET", None), ("chain:", 10, "COMMAND_INJECTION", "_COOKIE", "chain:a"),
    ("both:", 8, "XSS", "_GET", None), ("loop:", 10, "XSS", "_GET", None), ("calls:", 3, "XSS", "_GET", None),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(f, k, t) for f, code in FILES.items() for k, t in enumerate(code.split("\n"), 1)]
    return summaries.program(spark.createDataFrame(rows, "file_id string, line_no int, text string"))


def test_findings(found):
    assert {tuple(r) for r in summaries.findings(found).collect()} == WANT


def test_parameters(found):
    known = summaries.facts(found)
    got = {tuple(r) for r in summaries.parameters_to_sinks(found, known).collect()}
    assert got == {("escaped:find", 0, "SQL_INJECTION"), ("chain:a", 0, "COMMAND_INJECTION"), ("chain:b", 0, "COMMAND_INJECTION"), ("chain:c", 1, "COMMAND_INJECTION")}


def test_nothing(spark):
    empty = spark.createDataFrame([], "file_id string, line_no int, text string")
    assert summaries.findings(summaries.program(empty)).collect() == []


def test_large_files(spark, found, monkeypatch):
    """Files that are too large for a task, beside some that aren't, exchange what they know all the same."""
    monkeypatch.setattr(summaries.graphs, "LOCAL", 7)
    assert {tuple(r) for r in summaries.findings(found).collect()} == WANT


def test_few_rounds(spark, monkeypatch):
    """Tables are written for calls from file to file, not for each move."""
    written, own = [], summaries.cut
    monkeypatch.setattr(summaries, "cut", lambda df: written.append(1) or own(df))
    code = "$v0 = $_GET['x'];\n" + "".join(f"$v{i + 1} = $v{i};\n" for i in range(30)) + "echo $v30;"
    p = summaries.program(spark.createDataFrame([("f", k, t) for k, t in enumerate(code.split("\n"), 1)], "file_id string, line_no int, text string"))
    assert [r.line_no for r in summaries.findings(p).collect()] == [32]
    assert len(written) < 40
