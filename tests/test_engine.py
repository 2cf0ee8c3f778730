"""Readers, catalog, streaming and models."""

import json

from pyspark.sql import functions as F

from spindrift.functions import lines as L
from spindrift.operators import context, filters, graphs, learning, programs, ranking, reports, stages
from spindrift.plans.finding_queries import repeated
from spindrift.plans.program_queries import _labelled
from spindrift.sources import catalog, corpus
from spindrift.streaming import incremental

SF = "/root/testdata/sf0.01"


def test_source_files(spark, tmp_path):
    (tmp_path / "a" / "vendor").mkdir(parents=True)
    (tmp_path / "a" / "x.php").write_bytes(b"<?php echo '\xff\xc3\xa9';")
    (tmp_path / "a" / "vendor" / "y.php").write_text("<?php")
    (tmp_path / "a" / "z.txt").write_text("no")
    files = corpus.source_files(spark, str(tmp_path))
    assert files.count() == 2
    left = corpus.without_vendor(files, ["vendor"]).collect()
    assert len(left) == 1 and left[0].code == "<?php echo 'é';"


def test_composer(spark):
    spec = {"autoload": {"psr-4": {"App\\": "src/", "Lib\\": ["lib/", "old/"]}}, "autoload-dev": {"psr-4": {"App\\": "dev/", "Tests\\": "tests/"}}}
    got = {r.prefix: r.dir for r in corpus.psr4(spark, json.dumps(spec)).collect()}
    assert got == {"App\\": "src/", "Lib\\": "lib/", "Tests\\": "tests/"}
    files = spark.createDataFrame([(1, json.dumps(spec)), (2, "{}"), (3, "no"), (4, None), (5, json.dumps({"autoload-dev": spec["autoload-dev"]}))], "file_id int, code string")
    every = {(r.file_id, r.prefix): r.dir for r in corpus.psr4_of(files).collect()}
    assert every == {**{(1, k): v for k, v in got.items()}, (5, "App\\"): "dev/", (5, "Tests\\"): "tests/"}


def test_catalog(spark):
    sinks = catalog.catalog(spark, "sinks")
    assert sinks.count() == len(catalog.rows("sinks")) > 150 and sinks.where("name IS NULL OR vuln_type IS NULL OR severity IS NULL OR cwe IS NULL OR arg IS NULL").count() == 0
    assert catalog.sinks_of(spark, "XSS").where("name = 'echo'").count() == 1
    assert catalog.is_sink(spark, "Mysqli_Query") and not catalog.is_sink(spark, "strlen")
    assert (catalog.severity_of("XSS"), catalog.severity_of("NONE"), catalog.cwe_of("SSRF")) == ("HIGH", None, "CWE-918")
    assert catalog.sources(spark).count() < catalog.sources(spark, live=False).count()
    assert {r.rule_set: r.n for r in catalog.stats(spark).collect()}["sinks"] == sinks.count()
    assert catalog.fp_rules_for(spark, "XSS").count() >= catalog.fp_rules_for(spark, "NO_SUCH").count() > 0
    assert catalog.patterns_of(spark, "XSS").count() > 0 and catalog.frameworks(spark).count() == len(catalog.rows("frameworks"))
    assert catalog.sanitizers_for(spark, "XSS").where("name = 'htmlspecialchars'").count() == 1


def test_reports(spark, tmp_path):
    found = repeated(spark, SF)
    page = reports.html_report(found, "a <b>", 2)
    assert "a &lt;b&gt;" in page and page.count("<tr>") <= 8
    reports.sarif(found, str(tmp_path / "sarif"))
    assert spark.read.text(str(tmp_path / "sarif" / "results")).count() == found.count()
    assert json.loads(spark.read.text(str(tmp_path / "sarif" / "results")).first()[0])["ruleId"]


def test_stream_rescans_changed_files(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    scan = lambda f: f.where(F.contains("code", F.lit("eval"))).select("file_id", F.lit("CODE_INJECTION").alias("vuln_type"))
    put = lambda rows: spark.createDataFrame(rows, "file_id long, path string, code string").write.mode("append").parquet(src)
    put([(1, "a", "eval"), (2, "b", "eval"), (3, "c", "x")])
    incremental.scan_stream(incremental.file_stream(spark, src), scan, out, check).awaitTermination()
    assert {r.file_id for r in incremental.latest(spark, out).collect()} == {1, 2}
    put([(1, "a", "fixed"), (3, "c", "eval")])
    incremental.scan_stream(incremental.file_stream(spark, src), scan, out, check).awaitTermination()
    assert {r.file_id for r in incremental.latest(spark, out).collect()} == {2, 3}


def test_models_beat_the_majority(spark):
    rows = _labelled(spark, SF).cache()
    train, test = rows.where("id % 4 > 0"), rows.where("id % 4 = 0")
    columns = ["size", "insults", "marks"]
    boosted = learning.scored(learning.boosted(train, columns, trees=5), test)
    assert learning.f2(boosted, 0.5) > 0.5
    vectors = test.select("id").withColumn("code", F.concat(F.lit("$a = f($b); x"), (F.col("id") % 3).cast("string")))
    from pyspark.ml import Pipeline

    assert Pipeline(stages=learning.text_features(size=50)).fit(vectors).transform(vectors).select("tfidf").count() == test.count()


def test_dead_lines(spark):
    code = ["f();", "if (false) {", "a();", "if ($x) {", "b();", "}", "}", "c();", "function g() {", "return 1;", "d();", "}", "e();", "if ($y) { return 2; }", "h();", "exit;", "k();"]
    lines = spark.createDataFrame([(1, i + 1, i, t) for i, t in enumerate(code)], "file_id long, line_no int, seq long, text string")
    got = {(r.line_no, r.reason) for r in context.dead_lines(lines).collect()}
    assert got == {(3, "constant"), (4, "constant"), (5, "constant"), (6, "constant"), (11, "after_exit"), (17, "after_exit")}


def test_filters_fail_open(spark):
    f = spark.createDataFrame([(i,) for i in range(5)], "seq long")

    def broken(rows):
        raise ConnectionError

    assert {r.is_real for r in filters.verified(f, broken).collect()} == {None}


def test_dead_lines_keep_the_outer_block(spark):
    code = ["if (false) {", "if ($x) { return; }", "if ($y) {", "return;", "}", "a();", "} else {", "b();", "return 1;", "c();", "}", "d();", "if (0) { e(); }", "f();", "while (1) {", "die;", "g();", "{", "h();", "}", "}", "i();"]
    lines = spark.createDataFrame([(1, i + 1, i, t) for i, t in enumerate(code)], "file_id long, line_no int, seq long, text string")
    got = {(r.line_no, r.reason) for r in context.dead_lines(lines).collect()}
    assert got == {(k, "constant") for k in range(2, 7)} | {(10, "after_exit")} | {(k, "after_exit") for k in (17, 18, 19, 20)}


def reached(pairs):
    """By depth-first search from each node."""
    near, out = {}, set()
    for a, b in pairs:
        near.setdefault(a, []).append(b)
    for a in near:
        todo = list(near[a])
        while todo:
            x = todo.pop()
            if (a, x) not in out:
                out.add((a, x))
                todo += near.get(x, [])
    return out


def test_long_chains_and_cycles(spark):
    """Fixed points end where nothing is new, not after a number of rounds."""
    chain = [(i, i + 1) for i in range(300)]
    frame = lambda pairs: spark.createDataFrame(pairs, "src long, dst long")
    got = {(r.src, r.dst): r.depth for r in graphs.reach(frame(chain)).collect()}
    assert got == {(a, b): b - a for a in range(300) for b in range(a + 1, 301)}
    import random

    random.seed(3)
    order = random.sample(range(1000), 60)
    pairs = list(zip(order, order[1:] + order[:1], strict=True))  # one cycle
    pairs += [(2000 + i, 2001 + i) for i in range(12)] + [(2012, order[0]), (order[5], 3000), (3000, 3001), (3001, 3000), (7, 7)]  # a chain into it, a small cycle out of it
    pairs += [(random.randrange(4000, 4060), random.randrange(4000, 4060)) for _ in range(80)]
    far = reached(pairs)
    nodes = {x for p in pairs for x in p}
    want = {n: min([n] + [b for a, b in far if a == n and (b, n) in far]) for n in nodes}
    assert {r.node: r.scc for r in graphs.strong_components(frame(pairs)).collect()} == want
    assert {(r.src, r.dst) for r in graphs.reach(frame(pairs)).collect()} == far
    assert graphs.reach(frame([])).collect() == graphs.strong_components(frame([])).collect() == []


def test_calls_of_any_depth(spark):
    n = 25
    direct = spark.createDataFrame([(f"f{n}", 0, "XSS")], "func string, idx int, vuln_type string")
    passes = spark.createDataFrame([(f"f{i}", 0, f"f{i + 1}", 0) for i in range(n)] + [("g", 1, "f0", 1)], "func string, idx int, callee string, callee_idx int")
    assert {r.func for r in graphs.params_to_sinks(direct, passes).collect()} == {f"f{i}" for i in range(n + 1)}
    e = spark.createDataFrame([(i, i + 1) for i in range(12)], "src long, dst long")
    assert max(graphs.shortest_paths(e, e.where("src = 0")).collect(), key=lambda r: r.depth).path == list(range(13))


def test_points_to_with_fields(spark):
    """a = new; b = a; b.f = c; c = new; d = a.f; e = d; through two names of one object."""
    s = lambda rows, schema: spark.createDataFrame(rows, schema)
    got = graphs.points_to(s([("a", "o1"), ("c", "o2"), ("x", "o3")], "var string, loc string"), s([("b", "a"), ("e", "d")], "lhs string, rhs string"), s([("b", "f", "c"), ("x", "f", "a")], "base string, field string, rhs string"), s([("d", "a", "f"), ("y", "x", "f")], "lhs string, base string, field string"))
    assert {(r.var, r.loc) for r in got.collect()} == {("a", "o1"), ("b", "o1"), ("c", "o2"), ("x", "o3"), ("o1.f", "o2"), ("o3.f", "o1"), ("d", "o2"), ("e", "o2"), ("y", "o1")}


def test_extents_and_matches(spark):
    import random

    random.seed(4)
    for _ in range(3):
        code = [random.choice(["function f() {", "function g();", "function h() { x; }", "{", "}", "} }", "if (x) { y; }", "z", "}{", "function k()"]) for _ in range(60)]
        depth, before = [], [0]
        total = 0
        for t in code:
            total += t.count("{") - t.count("}")
            depth.append(max(0, total))
            before.append(depth[-1])
        want = {}
        for i, t in enumerate(code):
            if t.startswith("function"):
                want[i + 1] = next((j + 1 for j in range(i, len(code)) if "}" in code[j] and depth[j] <= before[i]), None)
        lines = spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(code)], "file_id long, line_no int, text string")
        assert {r.start_line: r.end_line for r in L.function_extents(lines).collect()} == want
    text = "\n".join("th" * random.randint(0, 9) + "x" for _ in range(4000))  # some 18 000 matches
    got = {r.ord: r.line_no for r in L.match_lines(spark.createDataFrame([(1, text)], "file_id long, code string"), "th").collect()}
    want, at = {}, 0
    while (at := text.find("th", at)) >= 0:
        want[len(want) + 1] = text.count("\n", 0, at) + 1
        at += 2
    assert got == want and len(got) > 10_000


def test_ranked_is_a_global_order(spark):
    rows = [(i, ["HIGH", "LOW", "CRITICAL", "MEDIUM"][i * 7 % 4 if i % 3 else 0], i * 37 % 100 / 100) for i in range(500)]
    got = ranking.ranked(spark.createDataFrame(rows, "seq long, severity string, confidence double")).collect()
    rank = {"CRITICAL": 3, "HIGH": 2, "MEDIUM": 1, "LOW": 0}
    assert {r.seq: r.pos for r in got} == {s: k + 1 for k, (s, _, _) in enumerate(sorted(rows, key=lambda r: (-rank[r[1]], -r[2], r[0])))}


def test_deep_files_and_failures(spark, monkeypatch):
    codes = ["<?php $x = " + "(" * 2000 + "$_GET['a']" + ")" * 2000 + "; echo $x;", "<?php $y = " + "[" * 1500 + "]" * 1500 + ";", "<?php echo $_GET['b'];", None]
    files = spark.createDataFrame(list(enumerate(codes)), "file_id long, code string")
    assert {r.file_id for r in programs.nodes(files).collect()} == {0, 1, 2, 3}
    assert programs.failed(files).collect() == []

    def broken(tree):
        raise ValueError("no")

    monkeypatch.setattr(programs.interpret, "findings", lambda tree, rules: (_ for _ in ()).throw(ValueError("no")))
    assert programs._made(["<?php f();"], broken)[0].args == ("no",)


def test_intermediate_tables_go(spark):
    from pathlib import Path

    from spindrift.sources import tables

    own = Path(tables._own(spark))
    kept = tables.written(spark.range(5).toDF("a"), "kept")
    gone = tables.written(spark.range(5).toDF("a"), "gone")
    tables.dropped(gone)
    assert kept.count() == 5 and not list(own.glob("gone-*"))
    tables.clean(spark)
    assert not own.exists()


def test_versions_over_branches(spark):
    code = "<?php\n$a = 1;\nif ($c) {\n$a = 2;\n} else {\n$a = 3;\n}\necho $a;\n$a = 4;"
    got = programs.versions(spark.createDataFrame([(1, code)], "file_id long, code string")).where("var = 'a'").collect()
    assert sorted(r.version for r in got) == list(range(5)) and [r.is_phi for r in got].count(True) == 1
    by_line = {r.line: r.version for r in got if not r.is_phi}
    assert by_line[2] == 0 and by_line[9] == max(by_line.values())


def test_staged_without_stages(spark):
    f = spark.createDataFrame([(1, 1, None, False, True, False, False, "k", "x")], "file_id long, line_no int, text string, in_comment boolean, tainted boolean, sanitized boolean, checked boolean, source_key string, near string")
    assert [(r.is_fp, r.reason) for r in stages.zero_fp(f).collect()] == [(False, None)]
