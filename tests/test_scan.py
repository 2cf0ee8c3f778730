"""The scanner on snippets of our own: what must be found, and what must not."""

import pytest
from pyspark.sql import functions as F

from spindrift.operators import paths, taint
from spindrift.plans import scan as plan
from spindrift.plans.scan import scan

PHP = "<?php\n"
CASES = {
    "sqli": ("$id = $_GET['id'];\n$r = mysql_query(\"SELECT * FROM t WHERE id=\" . $id);", "SQL_INJECTION"),
    "sqli_method": ("$n = $_POST['n'];\n$db->query(\"SELECT * FROM u WHERE n='$n'\");", "SQL_INJECTION"),
    "xss": ("echo \"Hello \" . $_GET['name'];", "XSS"),
    "xss_far": ("$v = $_REQUEST['v'];\n" + "$a = 1;\n" * 30 + "echo $v;", "XSS"),
    "cmdi": ("$f = $_GET['f'];\nsystem(\"ls \" . $f);", "COMMAND_INJECTION"),
    "eval": ("eval($_POST['code']);", "CODE_INJECTION"),
    "include": ("$p = $_GET['page'];\ninclude $p . '.php';", "FILE_INCLUSION"),
    "unserialize": ("$d = $_COOKIE['d'];\n$o = unserialize($d);", "DESERIALIZATION"),
    "chain": ("$a = $_GET['a'];\n$b = $a;\n$c = \"x\" . $b;\nunlink($c);", "PATH_TRAVERSAL"),
    "header": ("$u = $_GET['u'];\nheader(\"Location: \" . $u);", "HEADER_INJECTION"),
    "random": ("$token = mt_rand();", "INSECURE_RANDOM"),
    "creds": ("$password = 'hunter22';", "HARDCODED_CREDS"),
    "race": ("if (file_exists($f)) { unlink($f); }", "RACE_CONDITION"),
    "upload": ("move_uploaded_file($_FILES['f']['tmp_name'], $to);", "UNSAFE_UPLOAD"),
}
SAFE = {
    "cast": ("$id = (int)$_GET['id'];\nmysql_query(\"SELECT * FROM t WHERE id=\" . $id);", "SQL_INJECTION"),
    "prepared": ("$s = $db->prepare('SELECT * FROM t WHERE id=?');\n$s->bindValue(1, $_GET['id']);\n$s->execute();", "SQL_INJECTION"),
    "escaped": ("echo htmlspecialchars($_GET['name']);", "XSS"),
    "shell": ("$f = escapeshellarg($_GET['f']);\nsystem(\"ls \" . $f);", "COMMAND_INJECTION"),
    "comment": ("// echo $_GET['name'];\n/*\neval($_POST['c']);\n*/", "CODE_INJECTION"),
    "static_include": ("include __DIR__ . '/x.php';", "FILE_INCLUSION"),
    "constant": ("echo 'hello';", "XSS"),
    "before": ("echo $v;\n$v = $_GET['v'];", "XSS"),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(k, f"/app/{k}.php", PHP + code) for k, (code, _) in (CASES | {f"safe_{k}": v for k, v in SAFE.items()}).items()]
    out = scan(spark.createDataFrame(rows, "file_id string, path string, code string"))
    return {(r.file_id, r.vuln_type): r for r in out.collect()}


@pytest.mark.parametrize("name", CASES)
def test_found(found, name):
    assert (name, CASES[name][1]) in found


@pytest.mark.parametrize("name", SAFE)
def test_not_found(found, name):
    assert (f"safe_{name}", SAFE[name][1]) not in found


def test_findings_are_whole(found):
    for r in found.values():
        assert 0.5 <= r.confidence <= 1 and r.severity in ("LOW", "MEDIUM", "HIGH", "CRITICAL") and r.line_no >= 1 and r.code


def test_admin_and_obfuscated_files(spark):
    code = "$id = $_GET['id'];\nif (check_permission($x)) {}\nmysql_query(\"SELECT 1 FROM t WHERE id=\" . $id);"
    packed = "<?php $_F=__FILE__;" + "x" * 6000 + "eval($_POST['c']);"
    rows = [("plain", "/app/a.php", code), ("admin", "/app/admin/a.php", code), ("packed", "/app/p.php", packed)]
    out = scan(spark.createDataFrame(rows, "file_id string, path string, code string")).groupBy("file_id").agg(F.max("confidence").alias("c")).collect()
    c = {r.file_id: r.c for r in out}
    assert c["admin"] < c["plain"] and "packed" not in c


def test_empty(spark):
    assert scan(spark.createDataFrame([], "file_id string, path string, code string")).collect() == []


def test_nothing_is_broadcast(spark, monkeypatch):
    """Tables that grow with the corpus aren't sent to the driver, however small their files are."""
    plans = []

    def kept(df, cut=taint.cut):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(taint, "cut", kept)
    monkeypatch.setattr(paths, "cut", kept)
    monkeypatch.setattr(plan, "cut", kept)
    rows = [(k, f"/app/{k}.php", PHP + CASES["chain"][0]) for k in range(20)]
    out = scan(spark.createDataFrame(rows, "file_id long, path string, code string"))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert {(r.file_id, r.vuln_type) for r in out.collect()} >= {(k, "PATH_TRAVERSAL") for k in range(20)}
    assert not [p for p in plans if "Broadcast" in p]
    assert sum("SortMergeJoin" in p for p in plans) > 3
