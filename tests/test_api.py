"""What programs and shells call."""

import json

from spindrift import api
from spindrift.functions import lines as L


def test_code_and_files(spark, tmp_path):
    code = "<?php\n$id = $_GET['id'];\nmysql_query(\"SELECT 1 FROM t WHERE id=\" . $id);"
    (tmp_path / "a.php").write_text(code)
    (tmp_path / "vendor").mkdir()
    (tmp_path / "vendor" / "b.php").write_text(code)
    got = api.scan_code(spark, code)
    assert (3, "SQL_INJECTION") in {(r["line_no"], r["vuln_type"]) for r in got}
    assert [r["line_no"] for r in api.scan_file(spark, str(tmp_path / "a.php"))] == [r["line_no"] for r in got]
    assert api.scan_file(spark, str(tmp_path / "none.php")) == []
    found = api.scan_directory(spark, str(tmp_path), "quick")
    assert {r.file_id.rsplit("/", 1)[-1] for r in found.collect()} == {"a.php"}


def test_shell(spark, tmp_path, capsys):
    (tmp_path / "a.php").write_text("<?php eval($_POST['c']);")
    assert api.main([str(tmp_path), "--mode", "quick", "--format", "json"]) == 2
    assert json.loads(capsys.readouterr().out.splitlines()[0])["vuln_type"] == "CODE_INJECTION"


def test_facts_and_analyses(spark):
    files = spark.createDataFrame([(1, "<?php\n$a = (int) $b;\nif (in_array($b, $c)) { }\nswitch ($d) { }")], "file_id long, code string")
    got = {r["var"]: (r.casts, r.checks) for r in api.file_facts(files).collect()}
    assert got == {"$b": (["int"], ["in_array"]), "$d": ([], ["switch"])}
    assert api.ANALYSES["casts"](L.explode_lines(files)).count() == 1
