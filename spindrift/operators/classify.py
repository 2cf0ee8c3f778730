"""Features of findings and the heuristic classifier: signed weights over them, as one expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import catalog
from . import calls

#: Weights of features, the base score of a type, that of others, and the threshold.
WEIGHTS = {
    "source_risk": 0.25, "sink_danger": 0.20, "rule_confidence": 0.15, "sanitizer_type_match": -0.55, "prepared_stmt_nearby": -0.30, "type_cast_nearby": -0.25, "validation_nearby": -0.15, "sanitizer_present": -0.10, "in_comment": -0.50,
    "auth_check_nearby": -0.05, "orm_detected": -0.25, "has_direct_source": 0.10, "uses_string_concat": 0.05, "uses_interpolation": 0.05, "var_reassigned": -0.08, "is_ajax_handler": 0.05, "base64_decode_on_input": 0.15, "ssa_branch_sanitized": -0.15,
    "string_context_safe": -0.25, "string_tainted_ratio": 0.15, "type_narrowed_safe": -0.35, "alias_count": 0.05, "interproc_flow_to_sink": 0.10, "interproc_sanitized": -0.25, "framework_validated": -0.30,
}
BASE = {
    "CODE_INJECTION": 0.60, "RCE": 0.60, "COMMAND_INJECTION": 0.55, "SQL_INJECTION": 0.45, "DESERIALIZATION": 0.60, "FILE_INCLUSION": 0.55, "FILE_WRITE": 0.55, "FILE_READ": 0.50, "XSS": 0.40, "PATH_TRAVERSAL": 0.45, "SSRF": 0.45,
    "OPEN_REDIRECT": 0.40, "TYPE_JUGGLING": 0.45, "WEAK_CRYPTO": 0.55, "HARDCODED_CREDS": 0.50, "INFO_DISCLOSURE": 0.35, "AUTH_BYPASS": 0.55, "IDOR": 0.40, "XXE": 0.55, "LDAP_INJECTION": 0.50, "HEADER_INJECTION": 0.50, "MASS_ASSIGNMENT": 0.55,
    "INSECURE_RANDOM": 0.50, "RACE_CONDITION": 0.40, "LOG_INJECTION": 0.40, "REGEX_INJECTION": 0.45, "CSRF": 0.35, "UNSAFE_UPLOAD": 0.50, "TEMPLATE_INJECTION": 0.55,
}
DEFAULT_BASE, THRESHOLD = 0.45, 0.45
#: The most that a count can be as a feature.
CAPS = {
    "sanitizer_distance": 100, "alias_count": 10, "ast_depth_to_sink": 20, "cfg_block_count": 100, "cyclomatic_complexity": 50, "branch_count_between": 20, "loop_nesting_depth": 5, "function_param_count": 15, "lines_from_func_start": 500,
    "effective_taint_type_count": 16, "taint_source_count": 10, "string_fragment_count": 20, "call_depth": 10, "param_reaches_sink_count": 10, "scc_size": 10, "call_graph_in_degree": 20, "data_flow_sanitizer_count": 10, "middleware_count": 10,
    "file_function_count": 100, "enclosing_func_line_count": 1000, "nesting_depth": 15, "distance_from_entry": 500,
}
CRITICAL_TYPES = ["CODE_INJECTION", "COMMAND_INJECTION", "RCE", "DESERIALIZATION", "FILE_INCLUSION", "FILE_WRITE", "UNSAFE_UPLOAD"]

#: Words that choose, that repeat, and that add a way through the code.
CHOICES, LOOPS, WAYS = ["if", "elseif", "switch"], ["for", "foreach", "while", "do"], ["if", "elseif", "case", "while", "for", "foreach"]
#: Functions that a name calls to find out who is asking, that decode, that look rows up, and how requests of scripts are marked.
ASKS = ["is_logged_in", "is_user_logged_in", "current_user_can", "check_auth", "require_login"]
DECODES, LOOKS_UP = ["base64_decode"], ["->where", "->wherein", "->orwhere", "->find", "->findoneby"]
SCRIPTED = ["wp_ajax_", "xmlhttprequest", "http_x_requested_with"]


def _named(rules: str, groups: list[str], rules_dir: str, methods: bool = False) -> list[str]:
    """The names, as calls have them, of a rule set's groups."""
    names = {r["name"].lower() for r in catalog.rows(rules, rules_dir) if r["group"] in groups}
    return sorted(names | ({f"->{n}" for n in names} if methods else set()))


def counts(code: Column) -> dict[str, Column]:
    """Branches, loops and the complexity that they make, of a piece of code, by its words; complexity is capped."""
    words = F.transform(F.regexp_extract_all(code, F.lit(r"(?<![\w$>])[A-Za-z_]\w*"), 0), F.lower)
    of = lambda names: F.size(F.filter(words, lambda w: w.isin(names)))
    branches, loops = of([*CHOICES, "case"]), of([n for n in LOOPS if n != "do"])
    return {"branches": branches, "loops": loops, "complexity": F.least(branches + loops + 1, F.lit(CAPS["cyclomatic_complexity"]))}


def capped(name: str, value: Column) -> Column:
    return F.least(value, F.lit(CAPS[name])) if name in CAPS else value


def features(line: str, context: str, rules_dir: str = catalog.OWN) -> dict[str, Column]:
    """What can be read off the hit line and the lines around it (columns, by name): 0/1 features, and counts with their caps.

    Read off words, calls and literals, as `calls` finds them; a name within a variable or a member is no word.
    """
    quoted = lambda names: ", ".join(f"'{n}'" for n in names)
    words = f"transform(regexp_extract_all({context}, '(?<![\\\\w$>])[A-Za-z_]\\\\w*', 0), w -> lower(w))"
    called = lambda text: f"transform({calls.calls_sql(text)}, c -> c.name)"
    any_of = lambda names, among: f"arrays_overlap({among}, array({quoted(names)}))"
    count_of = lambda names: f"size(filter({words}, w -> w IN ({quoted(names)})))"
    request = sorted({r["name"].removeprefix("$") for r in catalog.rows("sources", rules_dir) if r.get("live") and r["name"].startswith("$_")})
    taken = lambda text: f"filter(regexp_extract_all({text}, '[$](_[A-Z]+)', 1), v -> v IN ({quoted(request)}))"
    checks = [*(n for n in _named("sanitizers", ["tests_of_numbers", "tests_of_letters"], rules_dir) if n.startswith("ctype_")), "in_array", "filter_var", "preg_match"]
    strings = f"regexp_extract_all({line}, '(\"[^\"]*\"|\\'[^\\']*\\')', 1)"
    flags = {
        "has_direct_source": f"size({taken(line)}) > 0",
        "uses_string_concat": f"{line} RLIKE '[.]\\\\s*[$]'",
        "uses_interpolation": f"exists({strings}, s -> startswith(s, '\"') AND s RLIKE '[$][A-Za-z_]')",
        "type_cast_nearby": f"{line} RLIKE '(?i)[(]\\\\s*(?:int|integer|float|double|bool|boolean)\\\\s*[)]'",
        "prepared_stmt_nearby": any_of(_named("sanitizers", ["database_binding"], rules_dir, True), called(line)),
        "validation_nearby": any_of(checks, called(context)),
        "base64_decode_on_input": any_of(DECODES, called(context)),
        "is_ajax_handler": " OR ".join(f"contains(lower({context}), '{m}')" for m in SCRIPTED),
        "in_try_catch": f"array_contains({words}, 'try')",
        "has_error_handler": f"arrays_overlap({words}, array('catch', 'set_error_handler', 'set_exception_handler'))",
        "is_in_closure": any_of(["function", "fn"], called(context)),  # that have no name, as what is called function or fn shows
        "whitelist_check_present": f"{any_of(["in_array", "array_key_exists"], called(context))} OR array_contains({words}, 'switch')",
        "orm_detected": any_of(LOOKS_UP, called(context)),
        "auth_check_nearby": any_of([*ASKS, *(f"->{n}" for n in ASKS)], called(context)),
        "dead_code_detected": f"exists({calls.calls_sql(context)}, c -> c.name = 'if' AND lower(trim(c.args)) IN ('false', '0'))",
    }
    numbers = {
        "branch_count_between": count_of(CHOICES),
        "loop_nesting_depth": count_of(LOOPS),
        "cyclomatic_complexity": f"{count_of(WAYS)} + 1",
        "string_fragment_count": f"size(regexp_extract_all({line}, '[.]\\\\s*[$\"\\']', 0)) + 1",
        "taint_source_count": f"size({taken(context)})",
        "nesting_depth": f"length({context}) - length(replace({context}, '{{', ''))",
    }
    out = {name: F.expr(f"coalesce({e}, false)").cast("double") for name, e in flags.items()}
    out |= {name: capped(name, F.expr(e)).cast("double") for name, e in numbers.items()}
    out["string_literal_ratio"] = F.expr(f"CASE WHEN length({line}) > 0 THEN length(array_join({strings}, '')) / length({line}) ELSE 0D END")
    return out


def heuristic(features: DataFrame, vuln_type: str = "vuln_type") -> DataFrame:
    """features has columns named as WEIGHTS (those that it lacks are 0), and vuln_type: score, is_tp, certainty and reasons.

    Some weights hold for some types alone; a sanitiser of the wrong type counts only if none of the right type is there.
    """
    base = F.coalesce(F.create_map(*[F.lit(x) for kv in BASE.items() for x in kv])[F.col(vuln_type)], F.lit(DEFAULT_BASE))
    only = {"prepared_stmt_nearby": ["SQL_INJECTION", "LDAP_INJECTION"], "orm_detected": ["SQL_INJECTION"]}
    score, reasons = base, []
    for name, weight in WEIGHTS.items():
        if name not in features.columns:
            continue
        value = F.col(name).cast("double")
        if name in only:
            value = F.when(F.col(vuln_type).isin(only[name]), value).otherwise(0.0)
        if name == "sanitizer_present" and "sanitizer_type_match" in features.columns:
            value = F.when(F.col("sanitizer_type_match") > 0, 0.0).otherwise(value)
        score = score + value * F.lit(weight)
        reasons.append(F.when(value > 0, name))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    out = features.withColumn("score", score).withColumn("reasons", F.array_join(F.array_compact(F.array(*reasons)), ","))
    certainty = F.least(F.lit(1.0), F.abs(F.col("score") - THRESHOLD) * 2)
    return out.withColumn("is_tp", F.col("score") > THRESHOLD).withColumn("certainty", certainty)


def kept(scored: DataFrame, line: str = "code") -> DataFrame:
    """Without findings that the classifier takes for false positives; critical types stay unless the line holds a file sanitiser."""
    critical = F.col("vuln_type").isin(CRITICAL_TYPES) & ~F.col(line).rlike(r"(?i)\b(?:basename|realpath|escapeshellarg)\s*\(")
    return scored.where(F.col("is_tp") | critical)


def annotated(scored: DataFrame, safe: float = 0.30, suspicious: float = 0.55) -> DataFrame:
    """Scored findings that are kept, with ml_score, ml_class, ml_certainty, ml_reasons, ml_severity and ml_kept, as reports take them."""
    band = F.when(F.col("score") < safe, "SAFE").when(F.col("score") <= suspicious, "SUSPICIOUS").otherwise("VULNERABLE")
    downgraded = F.when(band == "SUSPICIOUS", F.when(F.col("severity") == "CRITICAL", "HIGH").when(F.col("severity") == "HIGH", "MEDIUM").otherwise(F.col("severity"))).otherwise(F.col("severity"))
    return kept(scored).withColumns({"ml_score": F.col("score"), "ml_class": band, "ml_certainty": F.col("certainty"), "ml_reasons": F.col("reasons"), "ml_severity": downgraded, "ml_kept": F.lit(True)})
