"""Pattern scans over source text: templates, risky calls, secrets; and the list of all findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gitstrata.functions import exprs as E

# The patterns that scans look for, with their severities and caps.
SECRETS = (
    ("aws-access-key", "critical", r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b"),
    ("github-token", "critical", r"\bgh[oprsu]_[A-Za-z0-9]{36}\b"),
    ("stripe-secret", "critical", r"\bsk_(?:live|test)_[A-Za-z0-9]{24,}\b"),
    ("llm-api-key", "critical", r"\bsk-(?:proj-|ant-)?[A-Za-z0-9_-]{32,}\b"),
    ("google-api-key", "high", r"\bAIza[0-9A-Za-z_-]{35}\b"),
    ("slack-token", "high", r"\bxox[abprs]-(?:\d+-){2,}[A-Za-z0-9]{24,}\b"),
    ("pem-private-key", "critical", r"-----BEGIN (?:RSA |OPENSSH |EC |DSA |ENCRYPTED |PGP )?PRIVATE KEY-----"),
    ("jwt-token", "medium", r"\beyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\b"),
)
JS = ("js", "ts", "jsx", "tsx", "mjs", "cjs", "mts", "cts")
RISKY = (
    ("js-eval", JS, r"(?<![.\w$])eval\s*\("), ("js-new-function", JS, r"\bnew\s+Function\s*\("),
    ("py-eval", ("py",), r"(?<![.\w$])eval\s*\("), ("py-exec", ("py",), r"(?<![.\w$])exec\s*\("),
)
RISKY_SKIP_RE = r"\.test\.|\.spec\.|\.min\.js|\.min\.css|(^|/)(test|tests|__tests__|dist|build|\.next|node_modules|vendor)/"
TEMPLATE_EXTS = ("html", "htm", "jinja", "jinja2", "j2")
TEMPLATES = (
    ("py-template-safe-columns", r"\{\{[^}]*\brender_table\s*\([^}]*\bsafe_columns\s*=\s*\[\s*[^\]\s][^}]*\}\}"),
    ("py-template-safe-filter", r"\{\{\s*[^|}]*?\s*\|\s*safe\b[^}]*?\}\}"),
    ("py-template-autoescape-off", r"(?i)\{%\s*autoescape\s+(?:off|false)\s*%\}"),
)
TRUSTED_VALUE_RE = r"^(csrf_token|.*\.(help_text|label|label_tag|as_p|as_table|as_ul|errors))$"


def lines_of(files: DataFrame) -> DataFrame:
    """path, ext, line (from 1), content of each line."""
    return files.select("path", "ext", F.posexplode(F.split(F.coalesce("content", F.lit("")), "\n")).alias("_i", "content")).select("path", "ext", (F.col("_i") + 1).alias("line"), "content")


def secrets(lines: DataFrame, patterns=SECRETS, threshold: float = 0.5) -> DataFrame:
    """path, line, pattern, severity, preview, confidence of every match that is likely enough to be real."""
    found = F.flatten(F.array(*(_matches(i, s, p) for i, s, p in patterns)))
    any_ = E.any_of(F.col("content").rlike(p) for _, _, p in patterns)
    rows = lines.filter(any_).select("path", "line", F.explode(found).alias("x")).select("path", "line", "x.*")
    rows = rows.withColumn("confidence", F.round(E.secret_confidence(F.col("match"), F.col("path")), 6)).filter(F.col("confidence") >= threshold)
    return rows.select("path", "line", "pattern", "severity", E.redacted(F.col("match")).alias("preview"), "confidence")


def _matches(name: str, severity: str, pattern: str) -> Column:
    return F.transform(F.regexp_extract_all("content", F.lit(f"({pattern})"), F.lit(1)), lambda m: F.struct(F.lit(name).alias("pattern"), F.lit(severity).alias("severity"), m.alias("match")))


def in_string_literal(before: Column) -> Column:
    """Whether a line's beginning leaves a quote open, escapes and other quotes inside it left aside."""
    closed = F.regexp_replace(before, r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`", "")
    return closed.rlike("[\"'`]")


def risky_patterns(files: DataFrame, per_file: int = 20, total: int = 200) -> DataFrame:
    """path, line, pattern of calls that run text as code, outside comments and string literals.

    A line counts each of its matches; files that look minified and test or built files are skipped."""
    first = F.slice(F.split(F.coalesce("content", F.lit("")), "\n"), 1, 10)
    long_line = F.exists(first, lambda x: F.char_length(x) > 500)
    files = files.filter(~F.lower("path").rlike(RISKY_SKIP_RE) & ~long_line)
    hits = F.flatten(F.array(*(F.when(F.col("ext").isin(*exts), _starts(i, p)).otherwise(F.array().cast("array<struct<pattern:string,before:string>>")) for i, exts, p in RISKY)))
    rows = lines_of(files).filter(F.col("content").rlike(r"eval\s*\(|exec\s*\(|new\s+Function\s*\(")).select("path", "line", F.explode(hits).alias("x")).select("path", "line", "x.*")
    rows = rows.filter(~F.col("before").rlike(r"//|^#|\s#") & ~in_string_literal(F.col("before"))).withColumn("col", F.char_length("before"))
    order = W.partitionBy("path").orderBy("line", "col", "pattern")
    return rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= per_file).orderBy("path", "_n").limit(total).select("path", "line", "pattern")


def _starts(name: str, pattern: str) -> Column:
    """What stands before each match on the line."""
    parts = F.split("content", pattern)
    found = F.regexp_extract_all("content", F.lit(f"({pattern})"), F.lit(1))
    upto = lambda k: F.concat(F.array_join(F.transform(F.slice(parts, 1, k), lambda x, i: F.concat(x, F.get(found, i))), ""), F.get(parts, k))
    return F.transform(found, lambda m, k: F.struct(F.lit(name).alias("pattern"), F.when(k == 0, F.get(parts, F.lit(0))).otherwise(upto(k)).alias("before")))


def template_xss(files: DataFrame, per_file: int = 50) -> DataFrame:
    """path, line, rule of places in templates where escaping is off, framework-made values left out."""
    files = files.filter(F.col("ext").isin(*TEMPLATE_EXTS))
    found = F.flatten(F.array(*(_rule(r, p) for r, p in TEMPLATES)))
    rows = lines_of(files).select("path", "line", F.explode(found).alias("x")).select("path", "line", "x.*")
    piped = F.trim(F.regexp_extract("match", r"^\{\{\s*([^|}]*?)\s*\|", 1))
    rows = rows.filter((F.col("rule") != "py-template-safe-filter") | ~piped.rlike(TRUSTED_VALUE_RE))
    order = W.partitionBy("path").orderBy("rank", "line", "match")
    return rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= per_file).select("path", "line", "rule")


def _rule(rule: str, pattern: str) -> Column:
    rank = [r for r, _ in TEMPLATES].index(rule)
    return F.transform(F.regexp_extract_all("content", F.lit(f"({pattern})"), F.lit(1)), lambda m: F.struct(F.lit(rule).alias("rule"), F.lit(rank).alias("rank"), m.alias("match")))


#: The order in which findings of equal weight are listed.
SOURCES = ("incident", "sink", "secret", "pattern")


def unified_findings(incidents: DataFrame, sinks: DataFrame, secret_rows: DataFrame, patterns: DataFrame) -> DataFrame:
    """source, path, line, rule, severity, tier of all findings; tier 2 is reachable and tainted, 1 reachable."""
    part = lambda t, src, path, line, rule, sev, tier: t.select(F.lit(src).alias("source"), path.alias("path"), line.cast("int").alias("line"), rule.alias("rule"), sev.alias("severity"), tier.cast("int").alias("tier"))
    reach = F.col("reachability") == "reachable"
    none = F.lit(None).cast("string")
    out = (
        part(incidents, "incident", none, F.lit(None), F.col("incident"), F.lit("high"), F.lit(0))
        .unionByName(part(sinks, "sink", F.col("file"), F.col("line"), F.col("rule"), F.col("severity"), F.when(reach & F.col("tainted"), 2).when(reach, 1).otherwise(0)))
        .unionByName(part(secret_rows, "secret", F.col("path"), F.col("line"), F.col("pattern"), F.when(F.col("severity") == "critical", "high").otherwise(F.col("severity")), F.lit(0)))
        .unionByName(part(patterns, "pattern", F.col("path"), F.col("line"), F.col("pattern"), F.lit("medium"), F.lit(0)))
    )
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    source = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source"))
    return out.withColumn("order_key", F.concat(F.lit(9) - F.col("tier"), rank.cast("string"), source.cast("string")))
