"""The scan of a whole project, its modes, and what is kept beside it."""

import json

import pytest

from spindrift.operators import learning, reports
from spindrift.plans import full
from spindrift.sources import corpus

FILES = {
    "/app/lib.php": "<?php\nfunction find($db, $id) {\n$q = 'SELECT ' . $id;\nreturn run($q);\n}\nfunction run($sql) {\nreturn mysql_query($sql);\n}\nfunction calm($x) {\nreturn strlen($x);\n}",
    "/app/page.php": "<?php\n$id = $_GET['id'];\n$n = intval($_GET['n']);\nfind($db, $id);\nfind($db, $n);\ncalm($id);\nfind($db, 'x');",
    "/app/set.php": "<?php\nglobal $theme;\n$GLOBALS['theme'] = $_POST['theme'];",
    "/app/show.php": "<?php\ninclude 'set.php';\nglobal $theme;\necho $theme;",
    "/app/other.php": "<?php\nglobal $theme;\necho $theme;",
}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([(i, p, c) for i, (p, c) in enumerate(FILES.items())], "file_id long, path string, code string")


def test_calls_that_hand_sources_on(files):
    got = {(r.file_id, r.line, r.vuln_type, r.callee) for r in full.interprocedural(files).collect()}
    assert got == {(1, 4, "SQL_INJECTION", "find")}


def test_modes(files):
    quick, standard, deep = ({(r.file_id, r.line_no, r.vuln_type): r for r in full.scan_full(files, m).collect()} for m in full.MODES)
    assert set(quick) <= set(standard) <= set(deep)
    assert standard[1, 4, "SQL_INJECTION"].stage == "call" and (1, 4, "SQL_INJECTION") not in quick
    assert not any(k[:2] in ((1, 5), (1, 6), (1, 7)) and r.stage == "call" for k, r in deep.items())
    assert deep[3, 4, "XSS"].stage == "files" and deep[3, 4, "XSS"].source == "global:theme@/app/set.php"
    assert (3, 4, "XSS") not in standard and (4, 3, "XSS") not in deep
    assert all(r.severity in ("HIGH", "CRITICAL", "MEDIUM", "LOW") and 0 < r.confidence <= 1 and r.code for r in deep.values())
    with pytest.raises(ValueError):
        full.scan_full(files, "slow")


def test_prior_scans(spark, tmp_path):
    doc = {"target": "t", "findings": [{"type": "XSS", "severity": "HIGH", "line": 3, "code": "echo $a;", "file": "a.php", "confidence": "85%"}, {"type": "SSRF", "confidence": "?"}]}
    (tmp_path / "a.json").write_text(json.dumps(doc, indent=1))
    got = {r.type: r for r in corpus.prior_findings(spark, str(tmp_path), 1).collect()}
    assert (got["XSS"].confidence, got["XSS"].line, got["XSS"].label, got["SSRF"].confidence) == (0.85, 3, 1, None)


def test_models_are_kept(spark, tmp_path):
    rows = spark.createDataFrame([(i, float(i % 7), float(i * 13 % 5), float(i % 7 > 3), "XSS" if i % 2 else "SQL_INJECTION") for i in range(400)], "id long, a double, b double, label double, vuln_type string")
    model = learning.boosted(rows, ["a", "b"], trees=3)
    assert learning.importances(model, ["a", "b"])[0][0] == "a"
    learning.save(model, str(tmp_path / "m"))
    score = lambda m: [r.ml_score for r in learning.scored(m, rows).orderBy("id").collect()]
    assert score(learning.load(str(tmp_path / "m"))) == score(model)
    assert set(learning.per_type(rows, {"markup": ["XSS"], "none": ["SSRF"]}, ["a", "b"])) == {"markup"}
    assert min(learning.cross_validated(rows, ["a", "b"], folds=2)) > 0.9


def test_report_head(spark):
    rows = spark.createDataFrame([("HIGH",), ("LOW",)], "severity string")
    from pyspark.sql import functions as F

    r = reports.dated(rows, "/app", F.timestamp_seconds(F.lit(0))).first()
    assert (r.scan_date, r.target, r.total, r.high, r.low) == ("1970-01-01T00:00:00Z", "/app", 2, 1, 1)
