"""What files say about themselves: includes, namespaces, globals, dead code, whitelists, casts, frameworks' rules, auth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lines as L
from ..functions import text as T
from . import graphs, joins

INCLUDE = r"""(?i)\b(include|include_once|require|require_once)\b\s*\(?\s*(?:__DIR__\s*\.\s*|dirname\(__FILE__\)\s*\.\s*)?['"]([^'"$]+)['"]"""
AUTH = r"(?i)if\s*\([^)]*(?:logged|auth|admin|session)|->is(?:Admin|Authenticated|LoggedIn)\(|current_user_can\s*\(|Auth::\w+\s*\("
#: (kind, pattern with the variable as its first group), in order of strength. Kinds are the specification's terms; the patterns are our own.
WHITELISTS = [
    ("in_array", r"(?i)\bin_array\s*\(\s*(\$\w+)"),
    ("switch", r"(?i)\bswitch\s*\(\s*(\$\w+)"),
    ("strict_compare", r"(\$\w+)\s*===\s*['\"\d]"),
    ("isset_key", r"(?i)\bisset\s*\(\s*\$\w+\[(\$\w+)\]"),
    ("array_key_exists", r"(?i)\barray_key_exists\s*\(\s*(\$\w+)"),
    ("ctype", r"(?i)\bctype_(?:alpha|alnum|digit|xdigit)\s*\(\s*(\$\w+)"),
    ("anchored_match", r"(?i)\bpreg_match\s*\(\s*['\"]/\^\[[^\]]*\][^'\"]*\$/[a-z]*['\"]\s*,\s*(\$\w+)"),
    ("filter_var", r"(?i)\bfilter_var\s*\(\s*(\$\w+)"),
    ("is_numeric", r"(?i)\bis_numeric\s*\(\s*(\$\w+)"),
]
CASTS = {"int": r"\(\s*int(?:eger)?\s*\)\s*(\$\w+)", "float": r"\(\s*(?:float|double)\s*\)\s*(\$\w+)", "bool": r"\(\s*bool(?:ean)?\s*\)\s*(\$\w+)"}
ORM = {"builder": r"->(?:where|orWhere|whereIn|find|findBy|findOneBy)\s*\(", "prepared": r"->(?:prepare|bindParam|bindValue|execute)\s*\(", "active_record": r"\b[A-Z]\w*::(?:where|find|all|create)\s*\("}
#: What validation rules make a field safe for.
VALIDATION = {"integer": ["SQL_INJECTION", "XSS", "COMMAND_INJECTION"], "numeric": ["SQL_INJECTION", "XSS", "COMMAND_INJECTION"], "boolean": ["SQL_INJECTION", "XSS"], "email": ["SQL_INJECTION"], "url": ["SSRF"], "in": ["SQL_INJECTION", "XSS", "FILE_INCLUSION"], "alpha_num": ["SQL_INJECTION", "XSS", "COMMAND_INJECTION"], "uuid": ["SQL_INJECTION", "XSS"], "date": ["SQL_INJECTION", "XSS"]}


def includes(lines: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, line_no, kind, ref): literal references of includes."""
    return lines.where(F.col("text").rlike(INCLUDE)).select(key, "line_no", F.lower(F.regexp_extract("text", INCLUDE, 1)).alias("kind"), F.regexp_extract("text", INCLUDE, 2).alias("ref"))


def include_edges(refs: DataFrame, files: DataFrame) -> DataFrame:
    """refs (path, ref) with src, dst and whether it was found: beside the file that refers, then from the root."""
    beside = T.normal_path(F.concat(F.regexp_replace("path", "[^/]*$", ""), F.lit("/"), "ref"))
    root = T.normal_path(F.concat(F.lit("/"), "ref"))
    got = joins.candidates(refs.withColumns({"beside": beside, "root": root}), files, F.col("beside"), F.col("root"))
    return got.select(F.col("path").alias("src"), F.coalesce("resolved", "beside").alias("dst"), F.col("resolved").isNotNull().alias("is_resolved"))


def globals_(lines: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, line_no, name, tainted): `global $x` and `$GLOBALS['x'] = ...`."""
    declared = F.when(F.col("text").rlike(r"^\s*global\s"), F.regexp_extract_all("text", F.lit(r"\$(\w+)"), 1)).otherwise(F.array().cast("array<string>"))
    stored = F.regexp_extract_all("text", F.lit(r"""\$GLOBALS\[['"]?(\w+)['"]?\]\s*="""), 1)
    return lines.select(key, "line_no", F.explode(F.concat(declared, stored)).alias("name"), F.col("text").rlike(r"\$_(?:GET|POST|REQUEST|COOKIE)").alias("tainted"))


def _distances(includes: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, at, back, hops, broken) of all that files of starts (start) reach over includes (src, dst, is_resolved), forwards, and (back) against them: the least number of includes, and whether each way of that length has one that isn't resolved.

    Only what starts reach is ever made: within weak components many at a time in a task, for large ones by rounds, one for each include of the longest way, for both directions."""
    out, far, from_ = graphs.ways(includes.select("src", "dst", (~F.col("is_resolved")).alias("bad")), starts)
    return out if far is None else out.unionByName(_distances_by_rounds(far.withColumn("is_resolved", ~F.col("bad")), from_))


def _distances_by_rounds(includes: DataFrame, starts: DataFrame) -> DataFrame:
    e = includes.select("src", "dst", F.lit(False).alias("back"), (~F.col("is_resolved")).alias("bad"))
    e = graphs.cut(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(True).alias("back"), "bad")).groupBy("src", "dst", "back").agg(F.min("bad").alias("bad")))
    fresh = graphs.cut(starts.select("start", F.col("start").alias("at"), F.explode(F.array(F.lit(False), F.lit(True))).alias("back"), F.lit(0).alias("hops"), F.lit(False).alias("broken")))
    known, hops = graphs._Known(fresh), 0
    while not fresh.isEmpty():
        hops += 1
        on = fresh.join(e.withColumnRenamed("src", "at"), ["at", "back"]).groupBy("start", F.col("dst").alias("at"), "back").agg(F.min(F.col("broken") | F.col("bad")).alias("broken"))
        fresh = graphs.cut(on.join(known.rows, ["start", "at", "back"], "left_anti").select("start", "at", "back", F.lit(hops).alias("hops"), "broken"))
        known.add(fresh)
    return known.rows.where("hops > 0")


def cross_file_flows(includes: DataFrame, tainted: DataFrame, sinks: DataFrame) -> DataFrame:
    """(source_file, sink_file, name, hops, confidence): globals that one file taints and a sink of another takes, where the files see each other.

    includes (src, dst, and is_resolved, true if it is left out); tainted (file, name, direct), direct if the source is a
    parameter of the request; sinks (file, name). The way is the shortest over includes, or against them if there is none.
    Short ways are surer; one with an include that isn't resolved is less sure. Only files whose globals some sink takes
    are followed.
    """
    if "is_resolved" not in includes.columns:
        includes = includes.withColumn("is_resolved", F.lit(True))
    s = graphs.cut(sinks.select(F.col("file").alias("at"), "name").distinct())
    g = tainted.groupBy(F.col("file").alias("start"), "name").agg(F.max("direct").alias("direct"))
    g = graphs.cut(g.join(s.select("name").distinct(), "name", "left_semi"))
    ways = _distances(includes, g.select("start").distinct()).where("start <> at")
    way = ways.groupBy("start", "at").agg(F.min(F.struct("back", "hops", "broken")).alias("w"))
    c = F.lit(0.7) + F.when(F.col("direct"), F.lit(0.15)).otherwise(F.lit(0.1))
    c = c + F.when(F.col("w.hops") <= 1, F.lit(0.1)).when(F.col("w.hops") <= 3, F.lit(0.05)).otherwise(F.lit(0.0)) - F.when(F.col("w.broken"), F.lit(0.2)).otherwise(F.lit(0.0))
    out = way.join(g, "start").join(s, ["at", "name"])
    return out.select(F.col("start").alias("source_file"), F.col("at").alias("sink_file"), "name", "w.hops", F.greatest(F.lit(0.1), F.least(F.lit(1.0), c)).alias("confidence"))


def namespaces(files: DataFrame) -> DataFrame:
    """(path, namespace, class, fqcn) of the first class of each file."""
    ns = F.regexp_extract("code", r"(?m)^\s*namespace\s+([\w\\]+)\s*;", 1)
    name = F.regexp_extract("code", r"(?m)^\s*(?:abstract\s+|final\s+)?(?:class|interface|trait)\s+(\w+)", 1)
    return files.select("path", ns.alias("namespace"), name.alias("class"), F.when(ns == "", name).otherwise(F.concat(ns, F.lit("\\"), name)).alias("fqcn")).where("class <> ''")


def use_aliases(files: DataFrame) -> DataFrame:
    """(path, alias, fqcn) of `use` statements; without `as`, the last segment is the alias."""
    use = F.regexp_extract_all("code", F.lit(r"(?m)^\s*use\s+([\w\\]+(?:\s+as\s+\w+)?)\s*;"), 1)
    one = files.select("path", F.explode(use).alias("u"))
    fqcn = F.regexp_extract("u", r"^([\w\\]+)", 1)
    named = F.regexp_extract("u", r"\bas\s+(\w+)$", 1)
    return one.select("path", F.when(named != "", named).otherwise(F.substring_index(fqcn, "\\", -1)).alias("alias"), fqcn.alias("fqcn"))


def dead_lines(lines: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, line_no, reason): inside `if (false)` or `if (0)`, or after return, die or exit up to the end of the same block.

    A mark on a line kills the lines from the next one to the last that is deeper than its level: a constant condition's
    level is that before its line, an exit's is one less than that after it. The line that closes the block, as by a brace
    that it begins with (`} else {`), is alive. So
    marks are intervals, of which an outer one that is still open covers all that stands within; of the marks that cover a
    line, the outermost, which is the earliest, names the reason. Blank lines aren't reported.
    """
    t = F.trim(F.col("text"))
    w = L.ordered(key)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    d = lines.withColumns({"t": t, "depth": F.sum(L.counted(t, "{") - L.counted(t, "}")).over(upto)})
    d = d.withColumn("before", F.coalesce(F.lag("depth").over(w), F.lit(0)))
    closed = F.length(F.regexp_replace(F.regexp_extract("t", r"^[}\s]*", 0), r"\s", ""))
    d = d.withColumn("low", F.least("depth", F.col("before") - closed))
    constant = F.col("t").rlike(r"(?i)^if\s*\(\s*(?:false|0)\s*\)\s*\{") & (F.col("depth") > F.col("before"))
    exits = F.col("t").rlike(r"(?i)^(?:return|die|exit)\b[^;]*;\s*$")
    level = F.when(constant, F.col("before")).when(exits, F.col("depth") - 1)
    # the lines at which a level ends: those that fall to it or below; at most one row for each brace that they close
    ends = d.where("low < before").select(key, "line_no", F.explode(F.sequence(F.col("low"), F.col("before") - 1)).alias("level"), F.lit(True).alias("ends"), F.lit(None).cast("string").alias("reason"))
    marks = d.where(level.isNotNull()).select(key, "line_no", level.alias("level"), F.lit(False).alias("ends"), F.when(constant, "constant").otherwise("after_exit").alias("reason"))
    back = Window.partitionBy(key, "level").orderBy(F.desc("line_no"), "ends").rowsBetween(Window.unboundedPreceding, -1)
    spans = ends.unionByName(marks).withColumn("end", F.last(F.when(F.col("ends"), F.col("line_no")), ignorenulls=True).over(back)).where("NOT ends")
    # of marks so far, the one that ends last; one that doesn't end covers all that follows
    far = F.coalesce(F.col("end"), F.lit(2**31 - 1))
    m = d.join(spans.select(key, "line_no", F.struct(far.alias("end"), (-F.col("line_no")).alias("first"), "reason").alias("m")).groupBy(key, "line_no").agg(F.max("m").alias("m")), [key, "line_no"], "left")
    m = m.withColumn("cover", F.max("m").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    return m.where((F.col("line_no") < F.col("cover.end")) & (F.col("t") != "")).select(key, "line_no", F.col("cover.reason").alias("reason"))


def whitelisted(lines: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, var, line_no, kind): each variable's first check of each kind."""
    found = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(k).alias("kind"), F.regexp_extract("text", p, 1).alias("var")) for i, (k, p) in enumerate(WHITELISTS)])
    one = lines.select(key, "line_no", F.explode(F.filter(found, lambda x: x["var"] != "")).alias("f"))
    return one.groupBy(key, F.col("f.var").alias("var"), F.col("f.kind").alias("kind")).agg(F.min("line_no").alias("line_no"))


def casts(lines: DataFrame, key: str = "file_id") -> DataFrame:
    found = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract("text", p, 1).alias("var")) for k, p in CASTS.items()])
    return lines.select(key, "line_no", F.explode(F.filter(found, lambda x: x["var"] != "")).alias("f")).select(key, "line_no", "f.kind", "f.var")


def orm_use(lines: DataFrame, key: str = "file_id") -> DataFrame:
    kinds = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), k) for k, p in ORM.items()]))
    return lines.select(key, "line_no", F.explode(kinds).alias("kind"))


def auth_gaps(roles: DataFrame) -> DataFrame:
    """Files with the role ajax, or with admin or file_ops, that lack the role auth. roles: (file_id, role)."""
    has = lambda *r: roles.where(F.col("role").isin(*r)).select("file_id").distinct()
    return has("ajax").unionByName(has("admin", "file_ops").join(has("auth"), "file_id", "left_anti")).distinct()


def file_guarded(hits: DataFrame, lines: DataFrame, key: str = "file_id") -> DataFrame:
    """hits (key, line_no, var) with a file_exists or is_file on their variable in the 20 lines up to them."""
    g = lines.select(F.col(key).alias("k"), F.col("line_no").alias("l"), F.explode(F.regexp_extract_all("text", F.lit(r"\b(?:file_exists|is_file)\s*\(\s*\$(\w+)"), 1)).alias("v"))
    hit = (F.col("k") == F.col(key)) & (F.col("v") == F.col("var")) & F.col("l").between(F.col("line_no") - 19, F.col("line_no"))
    return hits.join(g, hit, "left_semi")


def validated_fields(files: DataFrame) -> DataFrame:
    """(path, field, rule, safe_for): validation rules as `'field' => 'required|integer'`."""
    pair = r"""['"](\w+)['"]\s*=>\s*['"]([\w|:,.]+)['"]"""
    body = F.array_join(F.regexp_extract_all("code", F.lit(r"(?s)->validate\s*\(\s*\[(.*?)\]"), 1), "\n")
    one = files.select("path", F.explode(F.arrays_zip(F.regexp_extract_all(body, F.lit(pair), 1).alias("field"), F.regexp_extract_all(body, F.lit(pair), 2).alias("rules"))).alias("p"))
    ruled = one.select("path", F.col("p.field").alias("field"), F.explode(F.split("p.rules", r"\|")).alias("rule"))
    table = F.create_map(*[F.lit(x) for k, v in VALIDATION.items() for x in (k, F.array(*map(F.lit, v)))])
    return ruled.select("path", "field", F.substring_index("rule", ":", 1).alias("rule")).withColumn("safe_for", table[F.col("rule")]).where("safe_for IS NOT NULL")


def blade_escaping(text: Column) -> Column:
    """How a template line prints: raw wins over escaped."""
    return F.when(text.rlike(r"\{!!.*?!!\}"), "raw").when(text.rlike(r"\{\{.*?\}\}"), "escaped")


def middleware(files: DataFrame) -> DataFrame:
    """(path, name): middleware that a file's routes name."""
    names = F.flatten(F.transform(F.regexp_extract_all("code", F.lit(r"->middleware\s*\(\s*\[?([^\])]*)"), 1), lambda x: F.regexp_extract_all(x, F.lit(r"['\"]([\w:]+)['\"]"), 1)))
    return files.select("path", F.explode(F.array_distinct(names)).alias("name"))


def multiplicative(no_source: Column, sanitizers: Column, framework: Column, orm: Column, auth: Column) -> Column:
    """The line scanner's confidence, by factors."""
    d = lambda x: F.lit(float(x))
    c = d(1.0) * F.when(no_source, d(0.5)).otherwise(d(1)) * F.when(sanitizers > 0, d(0.3)).otherwise(d(1)) * F.when(sanitizers > 1, d(0.5)).otherwise(d(1))
    return c * F.when(framework & orm, d(0.4)).when(framework, d(0.7)).otherwise(d(1)) * F.when(auth, d(0.8)).otherwise(d(1))


def narrowed(condition: Column, negated: Column) -> Column:
    """The types that a condition leaves a variable: of is_int($x), isset($x), $x instanceof C, $x === null."""
    is_ = F.regexp_extract(condition, r"\bis_(int|float|bool|string|array|null|numeric|callable)\s*\(", 1)
    own = F.when(is_ == "numeric", F.array(F.lit("INT"), F.lit("FLOAT"))).when(is_ != "", F.array(F.upper(is_))).when(condition.rlike(r"\binstanceof\b"), F.array(F.lit("OBJECT"))).when(condition.rlike(r"===\s*null\b"), F.array(F.lit("NULL")))
    not_null = F.array(*map(F.lit, ["ARRAY", "BOOL", "CALLABLE", "FLOAT", "INT", "OBJECT", "RESOURCE", "STRING"]))
    every = F.array(*map(F.lit, ["ARRAY", "BOOL", "CALLABLE", "FLOAT", "INT", "NULL", "OBJECT", "RESOURCE", "STRING"]))
    own = F.when(condition.rlike(r"\bisset\s*\("), not_null).otherwise(own)
    flip = negated != condition.rlike(r"^\s*!")
    return F.when(own.isNull(), every).when(flip, F.array_sort(F.array_except(every, own))).otherwise(F.array_sort(own))


def alias_constraints(lines: DataFrame, key: str = "file_id") -> dict[str, DataFrame]:
    """What lines (key, line_no, text) say of variables of a file, by name as `graphs.points_to` takes it: allocs, moves, stores and loads.

    New objects and arrays are locations of their own, `file:line`. A reference goes both ways. A cell with a literal key is a field, any other is the field `*`.
    """
    name = r"\$(\w+)"
    field = r"(?:->(\w+)|\[\s*['\"]?(\w*)['\"]?\s*\])"
    var = lambda c: F.concat(F.col(key).cast("string"), F.lit(":"), c)
    part = lambda p, i: F.regexp_extract("text", p, i)

    def field_of(p: str, i: int) -> Column:
        return F.when(part(p, i) != "", part(p, i)).when(part(p, i + 1) != "", part(p, i + 1)).otherwise("*")

    start, end = r"^\s*", r"\s*;"
    made = rf"{start}{name}\s*=\s*&?\s*(?:new\b|array\s*\(|\[)"
    moved = rf"{start}{name}\s*=\s*(&?)\s*{name}{end}"
    stored = rf"{start}{name}{field}\s*=\s*&?\s*{name}{end}"
    loaded = rf"{start}{name}\s*=\s*&?\s*{name}{field}{end}"
    lines = graphs.cut(lines.select(key, "line_no", "text").where(F.col("text").rlike("|".join((made, moved, stored, loaded)))))  # read by all four
    is_ = lambda p: lines.where(F.col("text").rlike(p))
    place = F.concat(F.col(key).cast("string"), F.lit(":"), F.col("line_no").cast("string"))
    one = is_(moved).select(var(part(moved, 1)).alias("lhs"), var(part(moved, 3)).alias("rhs"), (part(moved, 2) == "&").alias("both"))
    return {
        "allocs": is_(made).select(var(part(made, 1)).alias("var"), place.alias("loc")).distinct(),
        "moves": one.select("lhs", "rhs").unionByName(one.where("both").select(F.col("rhs").alias("lhs"), F.col("lhs").alias("rhs"))).distinct(),
        "stores": is_(stored).select(var(part(stored, 1)).alias("base"), field_of(stored, 2).alias("field"), var(part(stored, 4)).alias("rhs")).distinct(),
        "loads": is_(loaded).select(var(part(loaded, 1)).alias("lhs"), var(part(loaded, 2)).alias("base"), field_of(loaded, 3).alias("field")).distinct(),
    }
