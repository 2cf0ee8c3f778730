"""Corpora: source files from disk, and adapters that read tables as if they were files.

A file is (path, code); its lines are (path or file_id, line_no from 1, seq, text).
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Path segments that hold other people's code, and what tools leave.
VENDOR = [
    "vendor", "node_modules", "composer", "bower_components", "htmlpurifier", "phpseclib", "phpmailer", "guzzle", "guzzlehttp", "aws", "aws-sdk", "symfony", "laravel", "illuminate", "monolog", "psr", "doctrine", "twig", "swiftmailer",
    "phpunit", "mockery", "fzaninotto", "fakerphp", "league", "nesbot", "carbon", "ramsey", "nikic", "paragonie", "defuse", "firebase", "google", ".git", ".svn", "__pycache__", "cache", "tmp",
]


def source_files(spark: SparkSession, path: str, pattern: str = "*.php") -> DataFrame:
    """(path, code, sha256) of all files under path whose names fit; bytes that aren't UTF-8 are dropped, as are replacement characters."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    code = F.make_valid_utf8(F.col("content").cast("string"))
    return raw.select("path", F.replace(code, F.lit("�"), F.lit("")).alias("code"), F.sha2("content", 256).alias("sha256"))


def without_vendor(files: DataFrame, names: list[str] = VENDOR, path_col: str = "path") -> DataFrame:
    """Files with no path segment among names, in any letter case."""
    segments = F.transform(F.split(F.replace(F.col(path_col), F.lit("\\"), F.lit("/")), "/"), F.lower)
    return files.where(~F.arrays_overlap(segments, F.array(*map(F.lit, names))))


def first_files(files: DataFrame, n: int, path_col: str = "path") -> DataFrame:
    """At most n files, in order of path."""
    return files.orderBy(path_col).limit(n)


def prior_findings(spark: SparkSession, path: str, label: int | None = None) -> DataFrame:
    """Findings of earlier scans, a JSON document each: (target, file, line, type, severity, confidence, code, label). A percentage becomes a share."""
    schema = "target string, findings array<struct<type: string, severity: string, line: int, code: string, file: string, confidence: string>>"
    one = spark.read.schema(schema).option("multiLine", True).json(path).select("target", F.explode("findings").alias("f"))
    share = F.try_to_number(F.regexp_replace("f.confidence", "%", ""), F.lit("999")).cast("double") / 100
    return one.select("target", "f.file", "f.line", "f.type", "f.severity", share.alias("confidence"), "f.code", F.lit(label).cast("int").alias("label"))


def labelled(files: DataFrame, path_col: str = "path") -> DataFrame:
    """label by directory or name: 0 for what is known to be safe, 1 for what is known to be vulnerable, null for mixed."""
    p = F.lower(F.col(path_col))
    label = F.when(p.rlike("(^|/)safe(_|/|$)"), 0).when(p.rlike("(^|/)(unsafe|webshells?|vuln)(_|/|$)"), 1)
    return files.withColumn("label", label.cast("int"))


def namespace_head(files: DataFrame, chars: int = 64_000) -> DataFrame:
    """Only the beginning of each file, where its namespace stands."""
    return files.withColumn("code", F.substring("code", 1, chars))


def psr4(spark: SparkSession, composer_json: str) -> DataFrame:
    """(prefix, dir) of a composer file's autoload; prefixes of autoload-dev only where autoload has none."""
    spec = json.loads(composer_json)
    rows = [(k, v[0] if isinstance(v, list) else v, dev) for dev, key in ((0, "autoload"), (1, "autoload-dev")) for k, v in spec.get(key, {}).get("psr-4", {}).items()]
    table = spark.createDataFrame(rows, "prefix string, dir string, dev int")
    main = table.where("dev = 0")
    return main.unionByName(table.where("dev = 1").join(main, "prefix", "left_anti")).select("prefix", "dir")


def psr4_of(files: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, prefix, dir) of composer files (key, code), as `psr4` has them for one; what isn't JSON has none."""
    part = "struct<`psr-4`: map<string, string>>"
    spec = files.select(key, F.from_json("code", f"autoload {part}, `autoload-dev` {part}").alias("s"))
    dir_ = F.when(F.startswith("dir", F.lit("[")), F.get_json_object("dir", "$[0]")).otherwise(F.col("dir"))
    of = lambda name: spec.select(key, F.explode(F.col("s")[name]["psr-4"]).alias("prefix", "dir")).withColumn("dir", dir_)
    main = of("autoload")
    return main.unionByName(of("autoload-dev").join(main.select(key, "prefix"), [key, "prefix"], "left_anti"))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as statements of one file for each user: sources, copies, sanitised copies and sinks, in order of time."""
    e = read(spark, sf_dir, "events")
    n, m = ((F.col("event_id") + k) % 5 for k in (0, 1))
    var, other = (F.concat(F.lit("$v"), x.cast("string")) for x in (n, m))
    text = (
        F.when(F.col("event_type") == "view", F.concat(var, F.lit(" = $_GET[k];")))
        .when(F.col("event_type") == "click", F.concat(var, F.lit(" = "), other, F.lit(";")))
        .when(F.col("event_type") == "signup", F.concat(var, F.lit(" = intval("), other, F.lit(");")))
        .when(F.col("event_type") == "purchase", F.concat(F.lit('mysql_query("SELECT 1 WHERE a=" . '), var, F.lit(");")))
        .otherwise(F.concat(F.lit("echo "), var, F.lit(";")))
    )
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("file_id"), F.row_number().over(w).alias("line_no"), F.col("event_id").alias("seq"), text.alias("text"))


LINES = """lines AS (SELECT user_id AS file_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS line_no, event_id AS seq,
    CASE event_type WHEN 'view' THEN '$v' || (event_id % 5) || ' = $_GET[k];' WHEN 'click' THEN '$v' || (event_id % 5) || ' = $v' || ((event_id + 1) % 5) || ';'
         WHEN 'signup' THEN '$v' || (event_id % 5) || ' = intval($v' || ((event_id + 1) % 5) || ');' WHEN 'purchase' THEN 'mysql_query("SELECT 1 WHERE a=" . $v' || (event_id % 5) || ');'
         ELSE 'echo $v' || (event_id % 5) || ';' END AS text FROM events)"""


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.concat(F.lit("/src/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".php")).alias("path"), F.col("text").alias("code"))


FILES = "files AS (SELECT doc_id AS file_id, '/src/' || source || '/' || lang || '/' || doc_id || '.php' AS path, text AS code FROM documents)"
