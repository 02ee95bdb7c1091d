"""Sinks in Python code: which calls and assignments, among the facts of the syntax tree, are dangerous."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Names that the rules look for.
SUBPROCESS = ("run", "call", "check_call", "check_output", "Popen")
SQL_METHODS = ("execute", "executemany", "executescript", "raw")
PICKLES = ("pickle", "cPickle", "dill", "marshal")
CLIENTS, CLIENT_METHODS = ("requests", "httpx", "urllib", "urllib.request"), ("get", "post", "put", "patch", "delete", "head", "options", "request", "urlopen")
REDIRECTS, REDIRECT_RECEIVERS = ("redirect", "HttpResponseRedirect", "HttpResponsePermanentRedirect", "RedirectResponse"), ("http", "responses")
OWN_URL = r"\brequest\.(path|path_info|get_full_path|build_absolute_uri)"
SECRET_NAME = r"(?i)(secret|password|passwd|pwd|api_?key|access_?token|auth_?token|private_?key|signing_?key)"
NAMES_A_THING = r"(?i)_(header|field|label|prefix|suffix|param|claim)$"
NOT_SECRET = ("reset", "changed", "updated", "unchanged", "none", "null", "true", "false", "redacted", "hidden", "masked", "removed", "added", "set", "unset")
# Slots of credentials and of values that mustn't be guessed, hashes that are broken, what can be foreseen, draws from the plain generator.
CREDENTIAL_SLOT = r"(?i)pass(word|wd)?|pwd|token|otp|nonce"
BROKEN_HASHES = ("md5", "sha1")
FORESEEABLE = r"\b(random\.\w+|datetime\.(?:utc)?now|time\.time)\s*\("
UNGUESSABLE = (
    r"(?i)^(?:[a-z0-9]+_)?(?:token|otp|nonce|secret|passcode|password|passwd|pwd|verifier|salt|key)$",
    r"(?i)^(?:code|(?:reset|invite|invitation|verify|verification|confirm|confirmation|activation|auth|access|recovery|mfa|two_?factor|one_?time|otp|login|signup|share|unlock|pair|pairing|security|secret|temp|temporary|new|referral|redeem|voucher)_code)$",
)
PLAIN_DRAW = r"\brandom\.(choice|choices|sample|randint|randrange|random|getrandbits|randbytes|uniform)\s*\("


def _call_rules() -> list[tuple[Column, str, str, str]]:
    """(condition, rule, severity, taint): taint "any" carries an origin along, "needed" counts only with one, "source" only with a source, "none" asks for none."""
    recv, callee, form = F.col("receiver"), F.col("target"), F.col("form")
    bare = ~F.coalesce("has_receiver", F.lit(False))
    last = F.element_at(F.split(F.coalesce(recv, F.lit("")), r"\."), -1)
    word = lambda w: F.array_contains("items", w)
    loader = F.exists("items", lambda x: x.startswith("Loader=") & x.contains("Safe"))
    made = form == "assembled"
    return [
        (bare & (callee == "eval"), "py-eval", "high", "any"), (bare & (callee == "exec"), "py-exec", "high", "any"),
        ((recv == "os") & callee.isin("system", "popen"), "py-os-command", "high", "any"),
        ((recv == "subprocess") & callee.isin(*SUBPROCESS) & word("shell=True"), "py-subprocess-shell", "high", "any"),
        (recv.isin(*PICKLES) & callee.isin("load", "loads"), "py-pickle-load", "high", "any"),
        ((recv == "yaml") & callee.isin("load", "load_all") & ~loader, "py-yaml-unsafe-load", "high", "any"),
        (~bare & callee.isin(*SQL_METHODS) & made, "py-sql-assembled", "high", "any"),
        ((callee == "XMLParser") & (word("load_dtd=True") | word("no_network=False")), "py-xxe", "high", "none"),
        (callee.isin(*REDIRECTS) & (bare | last.isin(*REDIRECT_RECEIVERS)) & ~F.coalesce("origin", F.lit("")).rlike(OWN_URL), "py-open-redirect", "medium", "source"),
        (bare & (callee == "render_template_string") & form.isin("assembled", "name"), "py-ssti", "high", "any"),
        (bare & callee.isin("mark_safe", "Markup") & made, "py-mark-safe", "medium", "any"),
        ((recv == "jwt") & callee.isin("encode", "decode") & (F.char_length(F.trim("literal")) >= 3), "py-hardcoded-secret", "high", "none"),
        ((recv == "jwt") & (callee == "decode") & (word("verify=False") | F.exists("items", lambda x: x.startswith("options=") & x.rlike(r"verify_signature[\"']?\s*:\s*False"))), "py-jwt-unverified", "high", "none"),
        ((callee == "run") & word("debug=True"), "py-debug-server", "medium", "none"),
        (bare & (callee == "open"), "py-path-traversal", "high", "needed"),
        (word("autoescape=False"), "py-autoescape-disabled", "medium", "none"),
        (recv.isNotNull() & word("verify=False"), "py-tls-verify-disabled", "medium", "none"),
        ((recv.isin(*CLIENTS) & callee.isin(*CLIENT_METHODS)) | (bare & (callee == "urlopen")), "py-ssrf", "high", "needed"),
    ]


def _assign_rules() -> list[tuple[Column, str, str, str]]:
    name, value = F.col("target"), F.trim("literal")
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    echoes = (F.char_length(plain(value)) >= 4) & F.contains(plain(name), plain(value)) & (F.char_length(plain(value)) * 10 >= F.char_length(plain(name)) * 6)
    secret = name.rlike(SECRET_NAME) & (F.char_length(value) >= 3) & ~name.rlike(NAMES_A_THING) & ~F.lower(value).isin(*NOT_SECRET) & ~echoes
    return [
        (name.rlike("(?i)^(debug|debug_propagate_exceptions)$") & (F.col("form") == "True"), "py-debug-enabled", "medium", "none"),
        (name.rlike("(?i)^allowed_hosts$") & F.col("form").rlike(r"^\[.*['\"]\*['\"].*\]$"), "py-wildcard-allowed-hosts", "medium", "none"),
        (secret, "py-hardcoded-secret", "high", "none"), *_made_values(name, F.col("form")),
    ]


def _made_values(name: Column, form: Column) -> list[tuple[Column, str, str, str]]:
    """Credentials made by a broken hash of a password or of something that can be foreseen, and secrets joined from plain random draws.
    form: the value as source text, spelt in one way."""
    digest = rf"^(?:\w+\.)*(?:{'|'.join(BROKEN_HASHES)})\((.*)\)\.(?:hex)?digest\(\)$"
    arg = F.regexp_extract(form, digest, 1)
    password = arg.rlike(r"^(?:[\w.]*\.)?\w*(?i:pass(?:word|wd)?|pwd)\w*(?:\.encode\([^()]*\))?(?:,|$)")
    drawn = form.rlike(PLAIN_DRAW) & ~form.rlike(r"\brandom\.SystemRandom\s*\(") & form.contains(".join(")
    return [
        (name.rlike(CREDENTIAL_SLOT) & form.rlike(digest) & (password | arg.rlike(FORESEEABLE)), "py-broken-hash-credential", "high", "none"),
        (name.rlike(f"{UNGUESSABLE[0]}|{UNGUESSABLE[1]}") & drawn, "py-weak-prng-secret", "high", "none"),
    ]


def _compare_rules() -> list[tuple[Column, str, str, str]]:
    return [(F.col("target").rlike(SECRET_NAME) & (F.char_length(F.trim("literal")) >= 3), "py-credential-compared-to-literal", "high", "none")]


def _found(rows: DataFrame, rules: list[tuple[Column, str, str, str]]) -> DataFrame:
    hit = F.lit(None).cast("struct<rule:string,severity:string,taint:string>")
    for cond, rule, severity, taint in reversed(rules):
        hit = F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(taint).alias("taint"))).otherwise(hit)
    return rows.withColumn("_hit", hit).filter("_hit is not null")


def python_sinks(parsed: DataFrame) -> DataFrame:
    """file, rule, severity, line, in_fn, in_container, requires_taint, tainted_by_param, taint_source of the calls and
    assignments that a rule names, the first rule that holds; all of them, however many a file has."""
    calls = _found(parsed.filter("kind = 'call'"), _call_rules())
    assigns = _found(parsed.filter("kind = 'assign'"), _assign_rules())
    both = calls.unionByName(assigns).unionByName(_found(parsed.filter("kind = 'compare'"), _compare_rules()))
    kind, known = F.col("_hit.taint"), F.col("origin_kind")
    both = both.filter((kind == "any") | (kind == "none") | ((kind == "needed") & known.isNotNull()) | ((kind == "source") & (known == "source")))
    carried = lambda k: F.when((kind != "none") & (known == k), F.col("origin"))
    return both.select(
        "file", "_hit.rule", "_hit.severity", (F.col("row") + 1).alias("line"), F.col("name").alias("in_fn"), F.col("container").alias("in_container"), kind.isin("needed", "source").alias("requires_taint"),
        carried("param").alias("tainted_by_param"), carried("source").alias("taint_source"),
    )
