"""Confidence, severity and risk, as expressions over doubles in a fixed order of operations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
SEVERITIES = ["LOW", "MEDIUM", "HIGH", "CRITICAL"]
SOURCE_INDEPENDENT = ["WEAK_CRYPTO", "HARDCODED_CREDS", "INFO_DISCLOSURE", "INSECURE_RANDOM", "RACE_CONDITION", "LOG_INJECTION"]
BUILTIN_SANITIZERS = ["intval", "htmlspecialchars", "htmlentities", "escapeshellarg", "escapeshellcmd", "addslashes", "strip_tags", "filter_var", "prepared", "bindparam", "bindvalue", "quote", "(int)", "(float)"]
THREE_TRUSTED = ["intval", "htmlspecialchars", "escapeshellarg"]
LEVELS = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning", "LOW": "note"}
CWE = {"SQL_INJECTION": "CWE-89", "XSS": "CWE-79", "COMMAND_INJECTION": "CWE-78", "CODE_INJECTION": "CWE-94", "FILE_INCLUSION": "CWE-98", "SSRF": "CWE-918", "XXE": "CWE-611", "DESERIALIZATION": "CWE-502", "PATH_TRAVERSAL": "CWE-22"}


#: Types of program findings that are critical when they're sure.
CRITICAL_WHEN_SURE = ["SQL_INJECTION", "COMMAND_INJECTION", "CODE_INJECTION", "FILE_INCLUSION", "DESERIALIZATION"]


def _d(x: float) -> Column:
    return F.lit(float(x))


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity).cast("int")


def confidence(sources: Column, sanitizers: Column, tainted: Column, sanitized: Column, hops: Column, framework: Column, in_auth: Column, admin_path: Column, vuln_type: Column) -> Column:
    """sources, sanitizers: arrays of names; the others as they are called. In [0, 1]."""
    weak = F.exists(sources, lambda s: s == "WEAK_INPUT")
    strong = (F.size(sources) > 0) & ~weak
    own = F.array(*map(F.lit, BUILTIN_SANITIZERS))
    c = _d(0.85) + F.when(strong, _d(0.15)).when(weak, _d(0.05)).when(vuln_type.isin(SOURCE_INDEPENDENT), _d(-0.05)).otherwise(_d(-0.4))
    c = c - F.when(F.exists(sanitizers, lambda s: F.array_contains(own, F.lower(s))), _d(0.35)).otherwise(_d(0))
    c = c - F.when(F.exists(sanitizers, lambda s: ~F.array_contains(own, F.lower(s))), _d(0.2)).otherwise(_d(0))
    c = c + F.when(sanitized, _d(-0.4)).when(tainted, _d(0.1)).otherwise(_d(0))
    c = c + F.when(~sanitized & tainted & (hops <= 2), _d(0.05)).otherwise(_d(0))
    for flag, less in ((framework, 0.2), (in_auth, 0.15), (admin_path, 0.15)):
        c = c - F.when(flag, _d(less)).otherwise(_d(0))
    c = c + F.when((F.size(sources) > 0) & tainted & ~sanitized, _d(0.1)).otherwise(_d(0))
    return F.greatest(_d(0), F.least(_d(1), c))


def admin_scaled(c: Column, admin_only: Column, vuln_type: Column) -> Column:
    by = F.when(vuln_type.isin("CODE_INJECTION", "RCE"), _d(0.7)).when(vuln_type == "UNSAFE_UPLOAD", _d(0.75)).otherwise(_d(0.8))
    return F.when(admin_only, F.greatest(_d(0.5), c * by)).otherwise(c)


def severity(c: Column, base: Column) -> Column:
    return F.when(c < _d(0.75), "MEDIUM").when(c < _d(0.9), "HIGH").otherwise(F.when(base == "CRITICAL", "CRITICAL").otherwise("HIGH"))


def downgraded(c: Column, base: Column) -> Column:
    """Bins at .4, .6 and .8."""
    return F.when(c < _d(0.4), "LOW").when(c < _d(0.6), "MEDIUM").when(c < _d(0.8), F.when(base == "CRITICAL", "HIGH").otherwise(base)).otherwise(base)


def least_confidence(sanitizers: Column, admin_only: Column) -> Column:
    """What a finding needs to stay: less where it is admin-only or sanitised by other than the three trusted functions."""
    other = F.exists(sanitizers, lambda s: ~s.isin(THREE_TRUSTED))
    return F.when(admin_only | other, _d(0.4)).otherwise(_d(0.6))


def blended(percent: Column, probability: Column) -> Column:
    """A percentage moved by a classifier's probability, between 5 and 100."""
    return F.least(F.lit(100), F.greatest(F.lit(5), F.floor(percent + (probability - _d(0.5)) * _d(60)))).cast("int")


def risk(critical: Column, high: Column, medium: Column, low: Column) -> Column:
    return F.least(F.lit(100).cast("long"), 25 * critical + 10 * high + 3 * medium + low)


def risk_level(score: Column) -> Column:
    return F.when(score >= 75, "CRITICAL").when(score >= 50, "HIGH").when(score >= 25, "MEDIUM").otherwise("LOW")


def program_severity(vuln_type: Column, confidence: Column) -> Column:
    """Severity of what the front end finds: critical for some types from a confidence of .8, else high."""
    return F.when(vuln_type.isin(CRITICAL_WHEN_SURE) & (confidence >= 0.8), "CRITICAL").otherwise("HIGH")


def additive(direct: Column, in_function: Column, validated: Column, in_try: Column, partial: Column) -> Column:
    """The two-pass line analysis' confidence: more for a source on the line, less for each thing that may guard it; partial counts sanitisers that leave something."""
    c = _d(0.7) + F.when(direct, _d(0.2)).otherwise(_d(0))
    for flag, less in ((in_function, 0.05), (validated, 0.15), (in_try, 0.05)):
        c = c - F.when(flag, _d(less)).otherwise(_d(0))
    return F.least(_d(1), F.greatest(_d(0.1), c - partial * _d(0.1)))
