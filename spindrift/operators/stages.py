"""The steps that a finding passes before it counts: which files and lines are looked at, and what rules a finding out.

Each is an expression, or a plan over lines or findings; a chain gives the first reason that holds, and its stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lines as L
from . import joins, matching

#: What packers leave in a file: their loader's name, or a file that reads itself.
PACKED = r"(?i)ioncube|sourceguardian|zend_loader|sg_load\(|\$_[FX]\s*=\s*__FILE__"
INPUT = r"\$_(?:GET|POST|REQUEST|COOKIE|FILES|SERVER)\b"
FILE_CALL = r"\b(?:fopen|fwrite|file_put_contents|include|require)(?:_once)?\b"
#: Directories that sites keep for their staff, by the names that common frameworks and panels give them.
ADMIN_PATH = r"(?i)(?:^|[/\\])(?:wp-admin|admin\w*|backend|backoffice|cpanel|dashboard|control[-_]?panel|manager?|moderat(?:or|ion)|staff|intranet)[/\\]"
#: Calls and comparisons by which code asks for an administrator.
ADMIN_CODE = r"(?i)\b(?:is|has|check|require|ensure|assert)_?(?:admin\w*|super_?user|permissions?|capability)\s*\(|\bcurrent_user_can\s*\(|\$_SESSION\[['\"](?:is_)?admin\w*['\"]\]"
ADMIN_LINES = 50
DOC = r"^\s*(?:\*|/\*\*|@(?:param|return|var|throws|example)\b)"
MARKUP = r"^\s*(?:<(?!\?)[a-zA-Z!/]|\{\{|\{%)"
#: A call or an include whose only argument is a literal.
LITERAL = r"""(?i)\b(?:include|require)(?:_once)?\b\s*\(?\s*(?:__DIR__\s*\.\s*)?['"][^'"$]*['"]\s*\)?\s*;|\b\w+\s*\(\s*['"][^'"$]*['"]\s*(?:,\s*['"][^'"$]*['"]\s*)*\)"""
#: What a row of a database, or a session, is read by.
STORED = r"(?i)\b\w*fetch\w*\s*\(|->fetch\w*\s*\(|\$_SESSION\b|\b(?:get_option|get_user_meta|get_post_meta)\s*\("
SANITIZER_NAME = r"(?:(?:sanitize|sanitise|clean|escape|filter|validate|safe|strip|purify)\w*|\w*_(?:clean|cleaned|escape|escaped|filter|filtered|sanitize|sanitized|safe))"
DEFINED = rf"(?i)\bfunction\s+({SANITIZER_NAME})\s*\("
#: Words in the names of files that attackers go for first.
CRITICAL_NAME = r"(?i)(?:login|auth|upload|payment|checkout|admin|config|install|ajax|api|password|session)"
CRITICAL_OTHERS, CRITICAL_CHARS, CRITICAL_FILES = 100, 10_000, 50


def packed(code: Column) -> Column:
    """Few lines, much text and a packer's mark: nothing in it can be read."""
    return (F.size(F.split(code, "\n", -1)) < 20) & (F.length(code) > 5000) & code.rlike(PACKED)


def without_input(code: Column) -> Column:
    """Neither a request's values nor a decoded string that a file call takes: windows of several lines can be skipped."""
    return ~code.rlike(INPUT) & ~(F.contains(code, F.lit("base64_decode")) & code.rlike(FILE_CALL))


def admin_files(files: DataFrame) -> DataFrame:
    """files (path, code) with admin_path, admin_code (in the first lines) and admin_only, both."""
    head = F.array_join(F.slice(F.split("code", "\n", -1), 1, ADMIN_LINES), "\n")
    out = files.withColumns({"admin_path": F.col("path").rlike(ADMIN_PATH), "admin_code": head.rlike(ADMIN_CODE)})
    return out.withColumn("admin_only", F.col("admin_path") & F.col("admin_code"))


def match_starts(files: DataFrame, pattern: str, code_col: str = "code") -> DataFrame:
    """files with a row for each match: ord and start (from 1, in characters). What lies between matches is measured, and summed up."""
    code, found = F.col(code_col), F.regexp_extract_all(F.col(code_col), F.lit(f"({pattern})"), 1)
    parts = F.arrays_zip(F.slice(F.split(code, pattern, -1), F.lit(1), F.size(found)).alias("before"), found.alias("match"))
    rows = files.withColumns({"_row": F.monotonically_increasing_id()}).select("*", F.posexplode(parts).alias("pos", "part"))
    w = Window.partitionBy("_row").orderBy("pos")
    upto = F.sum(F.length("part.before") + F.length("part.match")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn("start", (upto - F.length("part.match") + 1).cast("int")).withColumn("ord", F.col("pos") + 1)
    return out.select(*files.columns, "ord", "start")


def around(start: Column, before: int, after: int, code: Column) -> Column:
    """The characters of code from so many before a place up to so many after it."""
    first = F.greatest(F.lit(1), start - before)
    return F.substring(code, first, start + after - first)


def ruled_out(code: Column, start: Column, pattern: str, before: int = 300, after: int = 100) -> Column:
    """Whether a rule's own false-positive pattern matches around a hit."""
    return around(start, before, after, code).rlike(pattern)


def has_safe_word(code: Column, start: Column, words: list[str], before: int = 100, after: int = 50) -> Column:
    """Whether one of the words, in any letter case, stands around a hit."""
    near = F.lower(around(start, before, after, code))
    return F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(near, w))


def prefilter(text: Column, in_comment: Column) -> Column:
    """The first of: comment, documentation, markup, literal arguments alone; or null."""
    return matching.first_reason([("comment", in_comment), ("documentation", text.rlike(DOC)), ("markup", text.rlike(MARKUP)), ("hardcoded", text.rlike(LITERAL) & ~text.rlike(r"\$\w"))])


def staged(stages: list[tuple[str, Column]]) -> Column:
    """(is_fp, reason, stage) by the first stage that has a reason."""
    none = F.lit(None).cast("string")
    out = F.struct(F.lit(False).alias("is_fp"), none.alias("reason"), none.alias("stage"))
    for name, reason in reversed(stages):
        out = F.when(reason.isNotNull(), F.struct(F.lit(True).alias("is_fp"), reason.alias("reason"), F.lit(name).alias("stage"))).otherwise(out)
    return out


def zero_fp(findings: DataFrame, key: str = "file_id") -> DataFrame:
    """findings with is_fp, reason and stage. In order: its line's context, no taint behind it, a check of its variable before it, a sanitiser of its source's key near it.

    findings has in_comment, text, tainted and sanitized (by taint.backward), checked (by whitelists, casts or custom
    functions), source_key and near (the lines before it as one text). One without text can't be judged, and stays.
    """
    context = prefilter(F.col("text"), F.col("in_comment"))
    behind = matching.first_reason([("no_taint", ~F.col("tainted")), ("sanitized", F.col("sanitized"))])
    checked = matching.first_reason([("checked", F.col("checked"))])
    pattern = r"(?i)\b(?:intval|htmlspecialchars|htmlentities|escapeshellarg|mysqli?_real_escape_string|basename|filter_var)\s*\([^)]*"
    keyed = F.regexp_like("near", F.concat(F.lit(pattern), escaped(F.col("source_key"))))
    near = matching.first_reason([("sanitizer_near_key", F.col("source_key").isNotNull() & F.coalesce(keyed, F.lit(False)))])
    said = F.when(F.col("text").isNotNull(), staged([("context", context), ("taint", behind), ("advanced", checked), ("near", near)])).otherwise(staged([]))
    return findings.withColumn("_said", said).select(*findings.columns, "_said.is_fp", "_said.reason", "_said.stage")


def escaped(text: Column) -> Column:
    """text with a backslash before each mark that regular expressions give a meaning."""
    return F.regexp_replace(text, r"([\\.^$|?*+()\[\]{}\-])", r"\\$1")


def literal_parameters(params: DataFrame, calls: DataFrame) -> DataFrame:
    """params (func, idx) with called, all_literal and is_fp: a parameter is safe if no call gives it anything but literals, or none is made.

    calls (caller, callee, idx, literal): the arguments of all calls; those that a function makes of itself don't count.
    """
    c = calls.where("caller <> callee").select(F.col("callee").alias("func"), "idx", "literal")
    sums = c.groupBy("func", "idx").agg(F.bool_and("literal").alias("all_literal"))
    out = params.join(sums, ["func", "idx"], "left")
    return out.select("func", "idx", F.col("all_literal").isNotNull().alias("called"), F.coalesce("all_literal", F.lit(True)).alias("is_fp"))


def assigned_before(hits: DataFrame, assigned: DataFrame, key: str = "file_id", lines: int = 100) -> DataFrame:
    """hits (key, line_no, var, ...) with never_assigned, from_input, from_store and internal: where their variable's assignments in the lines before come from.

    Assignments stand in the buckets of lines that they can be near to, so the join is by equality. from_store: a row of
    a database or a session; internal: assigned, from stores or plain code alone.
    """
    h = hits.withColumn("_b", F.floor(F.col("line_no") / lines))
    b = F.floor(F.col("line_no") / lines)
    a = assigned.select(F.col(key).alias("_k"), F.col("lhs").alias("_v"), F.col("line_no").alias("_l"), F.explode(F.array(b, b + 1)).alias("_ob"), F.col("source").isNotNull().alias("_in"), F.col("rhs").rlike(STORED).alias("_st"))
    hit = (h[key] == a["_k"]) & (h["var"] == a["_v"]) & (h["_b"] == a["_ob"]) & (a["_l"] < h["line_no"]) & (a["_l"] > h["line_no"] - lines)
    sums = h.join(a, hit, "left").groupBy(*hits.columns).agg(F.count("_l").alias("_n"), F.coalesce(F.bool_or("_in"), F.lit(False)).alias("from_input"), F.coalesce(F.bool_or("_st"), F.lit(False)).alias("from_store"))
    return sums.select(*hits.columns, (F.col("_n") == 0).alias("never_assigned"), "from_input", "from_store", ((F.col("_n") > 0) & ~F.col("from_input")).alias("internal"))


def critical_files(files: DataFrame, name: str = CRITICAL_NAME, others: int = CRITICAL_OTHERS, chars: int = CRITICAL_CHARS) -> DataFrame:
    """files (path, code) by name, and of the first so many others by path those that are long; `named` says which."""
    f = files.withColumn("named", F.col("path").rlike(name))
    head = f.where("NOT named").orderBy("path").limit(others).where(F.length("code") > chars)
    return f.where("named").unionByName(head)


def first_critical(files: DataFrame, n: int = CRITICAL_FILES) -> DataFrame:
    """The first n critical files, those by name before others, in order of path."""
    return critical_files(files).orderBy(F.desc("named"), "path").limit(n)


def sanitizer_definitions(code: Column) -> Column:
    """Names of functions that code defines and that are called like sanitisers, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(code, F.lit(DEFINED), 1)))


def wrapped(text: Column, names: Column) -> Column:
    """Whether a line calls one of the functions on a variable or a request's value."""
    return F.exists(names, lambda n: F.regexp_like(text, F.concat(F.lit(r"(?i)\b"), escaped(n), F.lit(r"\s*\(\s*\$"))))


def context_heads(files: DataFrame, name: str, n: int = 5, chars: int = 3000, paths: int = 100) -> DataFrame:
    """What a verifier is told of a project: of the first `paths` files by path the first n with the name, each cut to its beginning."""
    first = files.orderBy("path").limit(paths)
    return first.where(F.col("path").rlike(name)).orderBy("path").limit(n).withColumn("head", F.substring("code", 1, chars))


def project_stats(lines: DataFrame, key: str = "file_id") -> DataFrame:
    """(files, includes, files_with_globals, namespaces) of a project's lines."""
    t = F.col("text")
    shared = t.rlike(r"^\s*global\s+\$") | t.rlike(r"\$GLOBALS\[")
    return lines.agg(
        F.count_distinct(key).alias("files"), F.count_if(t.rlike(r"^\s*(?:include|require)(?:_once)?\b")).alias("includes"), F.count_distinct(F.when(shared, F.col(key))).alias("files_with_globals"), F.count_if(t.rlike(r"^\s*namespace\s")).alias("namespaces")
    )


def include_chains(refs: DataFrame, files: DataFrame) -> DataFrame:
    """refs (src, ref) with dst: the first file, by path, whose path ends with the reference. One equi-join by the last segment, then the whole suffix is compared."""
    last = lambda c: F.element_at(F.split(c, "/"), -1)
    clean = F.regexp_replace("ref", r"^(?:\.{0,2}/)+", "")
    r = refs.withColumn("_clean", clean).withColumn("_last", last(F.col("_clean")))
    f = files.select(F.col("path").alias("_path"), last(F.col("path")).alias("_last"))
    fits = (F.col("_path") == F.col("_clean")) | F.endswith(F.col("_path"), F.concat(F.lit("/"), F.col("_clean")))
    found = r.join(f, "_last").where(fits).groupBy("src", "ref").agg(F.min("_path").alias("dst"))
    return refs.join(found, ["src", "ref"], "left")


def verified_lines(lines: DataFrame, hits: DataFrame, key: str = "file_id") -> DataFrame:
    """hits (key, line_no) that are neither in a comment nor dead."""
    from . import context

    said = lines.select(key, "line_no", L.in_comment(key).alias("_c"))
    alive = hits.join(said.where("NOT _c").drop("_c"), [key, "line_no"], "left_semi")
    return alive.join(context.dead_lines(lines, key).select(key, "line_no"), [key, "line_no"], "left_anti")


def already_found(flows: DataFrame, found: DataFrame, key: str = "file_id", within: int = 2) -> DataFrame:
    """flows with no finding at most so many lines away: what a second analysis adds to a first."""
    return joins.near(flows, found.select(key, F.col("line_no").alias("_at")), key, "line_no", "_at", within, "left_anti")
