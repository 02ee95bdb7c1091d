"""Health signals, and the verdicts that are read from them.

A signal is a row (id, bucket, severity, a, b): bucket working, needs-work or question; a and b are the
numbers it rests on. Each detector gives at most one row. Thresholds are part of the semantics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gitstrata.functions import exprs as E

SCHEMA = "id string, bucket string, severity string, a double, b double"


def one_of(row: DataFrame, a: Column, b: Column, *rules: tuple[Column, str, str, Column | str | None]) -> DataFrame:
    """row: one row of numbers. The first rule (condition, id, bucket, severity) that holds makes the signal."""
    made = F.lit(None)
    for cond, name, bucket, severity in reversed(rules):
        sev = severity if isinstance(severity, Column) else F.lit(severity)
        made = F.when(cond, F.struct(F.lit(name).alias("id"), F.lit(bucket).alias("bucket"), sev.cast("string").alias("severity"))).otherwise(made)
    out = row.select(made.alias("s"), a.cast("double").alias("a"), b.cast("double").alias("b")).filter("s is not null")
    return out.select("s.*", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


def high_if(cond: Column) -> Column:
    return F.when(cond, "high").otherwise("medium")


W_, N_, Q_ = "working", "needs-work", "question"


def pr_throughput(prs: DataFrame) -> DataFrame:
    people = prs.filter(~E.is_bot(F.col("author_login")))
    row = people.agg(F.count_if(F.col("merged")).alias("m"), F.count_if(F.col("state") == "open").alias("o"))
    m, o = F.col("m"), F.col("o")
    enough = m + o >= 5
    return one_of(row, m, o, (enough & (m >= o) & (m >= 5), "healthy-pr-throughput", W_, None), (enough & (o > m * 1.5), "pr-backlog", N_, high_if(o > m * 3)))


def pr_cycle(prs: DataFrame) -> DataFrame:
    days = (F.unix_timestamp("merged_at") - F.unix_timestamp("created_at")) / 86400
    people = prs.filter(F.col("merged") & F.col("merged_at").isNotNull() & ~E.is_bot(F.col("author_login")))
    row = people.agg(F.median(days).alias("d"), F.count("*").alias("n"))
    d, n = F.col("d"), F.col("n")
    return one_of(row, d, n, ((n >= 5) & (d <= 3), "fast-pr-cycle", W_, None), ((n >= 5) & (d >= 14), "slow-pr-cycle", N_, high_if(d > 30)))


def ownership(spots: DataFrame, path_people: DataFrame, solo: Column | None = None) -> list[DataFrame]:
    """spots: path, churn. path_people: path, identity of people."""
    folder = E.folder_of(F.col("path"))
    churn = spots.groupBy(folder.alias("folder")).agg(F.sum("churn").alias("churn"))
    people = path_people.join(spots.select("path"), "path", "left_semi").groupBy(folder.alias("folder")).agg(F.count_distinct("identity").alias("people"))
    active = churn.join(people, "folder", "left").withColumn("all", F.lit(1))
    on = (F.col("churn") >= 5) & (F.col("folder") != "/")
    row = active.agg(F.count("*").alias("folders"), F.count_if(on & (F.col("people") == 1)).alias("one"), F.count_if(on & (F.col("people") >= 3)).alias("many"))
    enough = F.col("folders") >= 2
    return [
        one_of(row, F.col("one"), F.col("folders"), (enough & (F.col("one") >= 1) & ~(solo if solo is not None else F.lit(False)), "bus-factor-risk", N_, high_if(F.col("one") >= 3))),
        one_of(row, F.col("many"), F.col("folders"), (enough & (F.col("many") >= 3), "broad-ownership", W_, None)),
    ]


def coupling(pairs: DataFrame) -> DataFrame:
    """pairs: a, b, commits of co-change."""
    fa, fb = E.folder_of(F.col("a")), E.folder_of(F.col("b"))
    row = pairs.filter((F.col("commits") >= 3) & (fa != fb) & (fa != "/") & (fb != "/") & ~E.is_source_output_pair(fa, fb)).agg(F.count("*").alias("n"))
    return one_of(row, F.col("n"), F.lit(0), (F.col("n") >= 3, "cross-boundary-coupling", N_, high_if(F.col("n") >= 10)))


def metadata_share(spots: DataFrame, top: int = 15) -> DataFrame:
    """spots: path, score."""
    best = spots.orderBy(F.desc("score"), "path").limit(top)
    row = best.agg(F.count("*").alias("n"), F.count_if(E.is_metadata_file(F.col("path"))).alias("m"))
    share = F.col("m") / F.greatest(F.col("n"), F.lit(1))
    enough = F.col("n") >= 10
    return one_of(row, F.col("m"), F.col("n"), (enough & (share >= 0.6), "metadata-dominance", Q_, None), (enough & (share <= 0.2), "real-code-activity", W_, None))


def found_tests(hot: DataFrame, paths: DataFrame, edges: DataFrame) -> DataFrame:
    """path of the ``hot`` files (a few, column path) that have a test: one beside them under a usual name, one that imports
    them, or one whose name holds theirs. paths: path of all known files; edges: src, dst."""
    p, base = F.col("path"), E.basename(F.col("path"))
    stem = F.regexp_replace(base, r"\.[^.]+$", "")
    ext, folder = F.substring(base, F.char_length(stem) + 1, F.char_length(base)), F.substring(p, F.lit(1), F.char_length(p) - F.char_length(base))
    beside = F.array(
        F.concat(folder, stem, F.lit(".test"), ext), F.concat(folder, stem, F.lit(".spec"), ext), *(F.concat(folder, F.lit(f"{d}/"), base) for d in ("__tests__", "tests", "test")),
        F.when(ext == ".go", F.concat(folder, stem, F.lit("_test.go"))), F.when(ext == ".py", F.concat(folder, F.lit("test_"), stem, F.lit(".py"))),
    )
    names = hot.select("path", F.lower(stem).alias("_n"), F.explode(beside).alias("_b"))
    near = names.join(paths.select(F.col("path").alias("_b")), "_b", "left_semi").select("path")
    tests = paths.filter(E.is_signal_test_file(F.col("path"))).select(F.lower(E.basename(F.col("path"))).alias("_t")).distinct()
    # the hot files are a few rows
    told = F.broadcast(names.select("path", "_n").distinct().filter((F.char_length("_n") >= 4) & ~F.col("_n").isin("index", "utils")))
    named = tests.join(told, F.contains("_t", "_n")).select("path")
    used = edges.filter(E.is_signal_test_file(F.col("src"))).select(F.col("dst").alias("path")).join(F.broadcast(hot.select("path")), "path", "left_semi")
    return near.unionByName(named).unionByName(used).distinct()


def code_tests(spots: DataFrame, paths: DataFrame, edges: DataFrame, top: int = 25, whole: bool = True) -> list[DataFrame]:
    """spots: path, score. Whether the hottest code files have tests; the warning needs few tests in all, and the ``whole`` repository."""
    hot = spots.orderBy(F.desc("score"), "path").limit(top).filter(E.is_code_file(F.col("path"))).select("path")
    known = paths.select("path").unionByName(spots.select("path")).distinct()
    row = hot.join(found_tests(hot, known, edges).withColumn("_t", F.lit(True)), "path", "left").agg(F.count("*").alias("n"), F.count_if(F.col("_t").isNull()).alias("bare"))
    test = E.is_signal_test_file(F.col("path"))
    all_ = known.agg(F.count_if(test).alias("tests"), F.count_if(~test & E.is_code_file(F.col("path"))).alias("code"))
    row = row.crossJoin(all_)  # two tables of one row
    n, pct = F.col("n"), E.percent(F.col("bare"), F.col("n"))
    thin = (F.col("tests") < 30) & ((F.col("code") == 0) | (F.col("tests") < 0.25 * F.col("code"))) & F.lit(whole)
    good = E.percent(n - F.col("bare"), n)
    return [
        one_of(row, pct, n, ((n >= 5) & thin & (pct >= 50), "untested-hotspots", N_, high_if(pct > 80))),
        one_of(row, good, n, ((n >= 5) & (good >= 60), "good-test-presence", W_, None)),
    ]


def hygiene(facts: DataFrame) -> DataFrame:
    """facts, one row: has_license, has_readme (null where unknown)."""
    lacks = (~F.coalesce("has_license", F.lit(False))).cast("int") + (~F.coalesce("has_readme", F.lit(True))).cast("int")
    return one_of(facts, lacks, F.lit(0), (lacks > 0, "missing-hygiene", Q_, None))


def recency(commits: DataFrame, as_of: Column) -> DataFrame:
    row = commits.agg(F.max("ts").alias("t")).select(((F.unix_timestamp(as_of) - F.unix_timestamp("t")) / 86400).alias("d"))
    d = F.col("d")
    return one_of(row, d, F.lit(0), ((d >= 0) & (d < 7), "very-active", W_, None), (d > 90, "stale", N_, high_if(d > 365)))


def people(shares: DataFrame) -> list[DataFrame]:
    """shares: identity, commits, pct of people."""
    top = shares.orderBy(F.desc("commits"), "identity").limit(5).agg(F.sort_array(F.collect_list(F.struct("commits", "pct")), asc=False).alias("t"))
    row = shares.agg(F.count("*").alias("n"), F.coalesce(F.sum("commits"), F.lit(0)).alias("c")).crossJoin(top)
    pct = lambda k: F.aggregate(F.slice("t", 1, k), F.lit(0).cast("long"), lambda acc, x: acc + x.pct)
    solo = (F.col("c") >= 5) & (pct(1) >= 84)
    return [
        one_of(row, pct(1), F.col("n"), (solo, "solo-project", Q_, None)),
        one_of(row, pct(3), F.col("n"), (~solo & (F.col("n") >= 3) & (pct(3) >= 70), "concentrated-ownership", Q_, None)),
        one_of(row, F.col("n"), pct(5), (F.col("n") >= 20, "many-contributors", W_, None)),
    ]


def cadence(weeks: DataFrame, as_of: Column) -> DataFrame:
    """weeks: week, commits. Active weeks among the last min(52, span) of them."""
    row = weeks.agg(F.min("week").alias("first"))
    span = F.least(F.lit(52), F.floor(F.datediff(as_of, F.col("first")) / 7) + 1)
    both = weeks.crossJoin(row.select(span.alias("span"))).filter((F.datediff(as_of, F.col("week")) >= 0) & (F.floor(F.datediff(as_of, F.col("week")) / 7) < F.col("span")))
    out = both.agg(F.count("*").alias("n"), F.max("span").alias("span"))
    return one_of(out, F.col("n"), F.col("span"), ((F.col("span") >= 6) & (F.col("n") / F.col("span") >= 0.6), "consistent-cadence", W_, None))


def dependencies(rows: DataFrame, vulnerable: DataFrame, outdated: DataFrame, deprecated: DataFrame) -> list[DataFrame]:
    ship = lambda t: t.filter("scope <> 'dev'")
    row = (
        ship(rows).agg(F.count("*").alias("deps")).crossJoin(ship(vulnerable).agg(F.count("*").alias("v")))
        .crossJoin(ship(outdated).agg(F.count("*").alias("o6"), F.count_if(F.col("months") >= 12).alias("o12"))).crossJoin(ship(deprecated).agg(F.count("*").alias("d")))
    )
    deps, v, o6, o12, d = (F.col(c) for c in ("deps", "v", "o6", "o12", "d"))
    return [
        one_of(row, v, deps, (v > 0, "vulnerable-deps", N_, "high")),
        one_of(row, o12, deps, (o12 >= 3, "outdated-deps", N_, high_if(o12 > 10))),
        one_of(row, d, deps, (d > 0, "deprecated-deps", N_, "medium")),
        one_of(row, o6, deps, ((deps >= 5) & (v == 0) & (d == 0) & (o12 == 0) & (o6 <= 0.2 * deps), "fresh-deps", W_, None)),
    ]


def suites(weak: DataFrame) -> DataFrame:
    """weak: cases, smoke, density of each test file."""
    row = weak.agg(F.coalesce(F.sum("cases"), F.lit(0)).alias("n"), F.coalesce(F.sum("smoke"), F.lit(0)).alias("s"), F.coalesce(F.sum(F.col("density") * F.col("cases")), F.lit(0.0)).alias("a"))
    smoke, density = F.col("s") / F.greatest(F.col("n"), F.lit(1)), F.col("a") / F.greatest(F.col("n"), F.lit(1))
    enough = F.col("n") >= 15
    return one_of(row, F.col("s"), F.col("n"), (enough & (smoke >= 0.2), "weak-suite", N_, high_if(smoke >= 0.4)), (enough & (smoke <= 0.1) & (density >= 1.5), "assertion-dense-tests", W_, None))


def duplicates(groups: DataFrame) -> DataFrame:
    row = groups.agg(F.count("*").alias("n"), F.coalesce(F.max("max_complexity"), F.lit(0)).alias("c"))
    n, c = F.col("n"), F.col("c")
    sev = F.when((n >= 20) | (c >= 20), "high").when((n >= 10) | (c >= 10), "medium").otherwise("low")
    return one_of(row, n, c, (n >= 2, "duplicate-implementations", N_, sev))


def concentration(row: DataFrame) -> DataFrame:
    """row: functions, pct, concentrated."""
    return one_of(row, F.col("pct"), F.col("functions"), (F.col("concentrated"), "complexity-concentration", Q_, None))


def unit_coverage(coverage: DataFrame) -> DataFrame:
    row = coverage.agg(F.coalesce(F.sum("functions"), F.lit(0)).alias("n"), F.coalesce(F.sum("tested"), F.lit(0)).alias("t"))
    pct = E.percent(F.col("t"), F.col("n"))
    return one_of(row, pct, F.col("n"), ((F.col("n") >= 25) & (pct >= 30), "unit-tested-core", W_, None), ((F.col("n") >= 25) & (pct < 30), "limited-direct-coverage", Q_, None))


def workflows(findings: DataFrame) -> DataFrame:
    has = lambda f, s: F.max((F.col("finding") == f) & (F.col("severity") == s))
    row = findings.agg(F.count("*").alias("n"), has("unpinned-actions", "high").alias("e"), F.max(F.col("finding") == "broad-permissions").alias("b"), F.max(F.col("severity") != "low").alias("any"))
    return one_of(row, F.col("n"), F.lit(0), (F.col("e"), "ci-supply-chain-exposed", N_, "high"), (F.col("b"), "ci-permissions-broad", N_, "medium"), (~F.coalesce("any", F.lit(False)), "ci-hardened", W_, None))


def incidents(matches: DataFrame) -> DataFrame:
    return one_of(matches.agg(F.count("*").alias("n")), F.col("n"), F.lit(0), (F.col("n") > 0, "known-incident-match", N_, "high"))


def risky(patterns: DataFrame) -> DataFrame:
    return one_of(patterns.agg(F.count("*").alias("n")), F.col("n"), F.lit(0), (F.col("n") > 0, "risky-eval-patterns", Q_, None))


def deep_chain(layers: DataFrame) -> DataFrame:
    """layers: layer of each file."""
    row = layers.agg(F.max("layer").alias("n"))
    n = F.col("n")
    return one_of(row, n, F.lit(0), (n >= 9, "deep-dependency-chains", N_, high_if(n >= 12)), (n >= 6, "deep-dependency-chains", Q_, None))


def together(*parts: DataFrame | list[DataFrame]) -> DataFrame:
    flat = [d for p in parts for d in (p if isinstance(p, list) else [p])]
    out = flat[0]
    for d in flat[1:]:
        out = out.unionByName(d)
    return out


# Which signals each department and each dimension reads.
DEPARTMENTS = {
    "health": ("very-active", "stale", "consistent-cadence", "real-code-activity", "solo-project", "bus-factor-risk", "broad-ownership", "many-contributors", "missing-hygiene", "metadata-dominance", "good-test-presence"),
    "security": ("known-incident-match", "vulnerable-deps", "risky-eval-patterns"),
    "forensics": ("untested-hotspots", "cross-boundary-coupling", "deep-dependency-chains", "duplicate-implementations", "complexity-concentration", "unit-tested-core", "limited-direct-coverage", "weak-suite", "assertion-dense-tests"),
    "supply": ("outdated-deps", "deprecated-deps", "fresh-deps", "healthy-pr-throughput", "pr-backlog", "fast-pr-cycle", "slow-pr-cycle"),
}
DIMENSIONS = {
    "activity": ("very-active", "stale", "consistent-cadence", "real-code-activity"),
    "team": ("solo-project", "bus-factor-risk", "broad-ownership", "many-contributors", "concentrated-ownership"),
    "code": (
        "untested-hotspots", "cross-boundary-coupling", "good-test-presence", "deep-dependency-chains", "risky-eval-patterns", "duplicate-implementations", "complexity-concentration",
        "unit-tested-core", "limited-direct-coverage", "weak-suite", "assertion-dense-tests",
    ),
    "pr-flow": ("healthy-pr-throughput", "pr-backlog", "fast-pr-cycle", "slow-pr-cycle"),
    "deps": ("vulnerable-deps", "outdated-deps", "deprecated-deps", "fresh-deps", "known-incident-match"),
    "hygiene": ("missing-hygiene", "metadata-dominance", "ci-supply-chain-exposed", "ci-permissions-broad", "ci-hardened"),
}
# Recommendations by signal as (category, effort, base weight).
RECOMMENDATIONS = {
    "known-incident-match": ("security", "quick", 28), "vulnerable-deps": ("security", "moderate", 25), "risky-eval-patterns": ("security", "moderate", 18),
    "deprecated-deps": ("dependencies", "moderate", 15), "untested-hotspots": ("tests", "substantial", 15), "outdated-deps": ("dependencies", "moderate", 14),
    "bus-factor-risk": ("process", "substantial", 12), "cross-boundary-coupling": ("architecture", "substantial", 10), "pr-backlog": ("process", "moderate", 10),
    "slow-pr-cycle": ("process", "moderate", 10), "deep-dependency-chains": ("architecture", "substantial", 9), "stale": ("activity", "quick", 8),
    "solo-project": ("process", "moderate", 6), "missing-hygiene": ("docs", "quick", 5), "metadata-dominance": ("activity", "quick", 4),
}


def _table(spark: SparkSession, groups: dict, name: str) -> DataFrame:
    return spark.createDataFrame([(g, s) for g, ids in groups.items() for s in ids], f"{name} string, id string")


def rulings(signals: DataFrame, secrets: DataFrame | None = None) -> DataFrame:
    """department, vote, signals, flagged. secrets: severity; critical or high ones fail security, others make it conditional."""
    table = _table(signals.sparkSession, DEPARTMENTS, "department")  # a fixed table
    need = F.col("bucket") == N_
    out = F.broadcast(table).join(signals, "id", "left").groupBy("department").agg(F.count("bucket").alias("signals"), F.count_if(need).alias("flagged"), F.count_if(need & (F.col("severity") == "high")).alias("_high"))
    if secrets is None:
        out = out.withColumn("_s", F.lit(0)).withColumn("_m", F.lit(0))
    else:
        found = secrets.agg(F.count_if(F.col("severity").isin("critical", "high")).alias("_s"), F.count("*").alias("_m"))
        out = out.crossJoin(F.broadcast(found))  # one row
    security = F.col("department") == "security"
    vote = F.when((F.col("_high") > 0) | (security & (F.col("_s") > 0)), "fail").when((F.col("flagged") > 0) | (security & (F.col("_m") > 0)), "conditional").otherwise("pass")
    return out.select("department", vote.alias("vote"), "signals", "flagged")


def verdict(ruled: DataFrame, signals: DataFrame) -> DataFrame:
    """One row: outcome, raw_score, score, grade, critical."""
    points = F.when(F.col("vote") == "pass", 25).when(F.col("vote") == "conditional", 15).otherwise(5)
    row = ruled.agg(F.sum(points).alias("raw_score"), F.count_if(F.col("vote") == "fail").alias("_f"), F.count_if(F.col("vote") == "pass").alias("_p"), F.count("*").alias("_n"))
    row = row.withColumn("outcome", F.when(F.col("_f") > 0, "returned").when(F.col("_p") == F.col("_n"), "cleared").otherwise("conditional"))
    cap = F.when(F.col("outcome") == "cleared", 100).when(F.col("outcome") == "conditional", 89).otherwise(59)
    row = row.withColumn("score", F.least(F.col("raw_score"), cap)).withColumn("grade", E.grade(F.col("score")))
    critical = signals.agg(F.count_if((F.col("bucket") == N_) & (F.col("severity") == "high")).alias("critical"))
    return row.crossJoin(critical).select("outcome", "raw_score", "score", "grade", "critical")


def health_summary(signals: DataFrame) -> DataFrame:
    """dimension, status, signals."""
    table = _table(signals.sparkSession, DIMENSIONS, "dimension")
    n = lambda c: F.count_if(c)
    need = F.col("bucket") == N_
    out = F.broadcast(table).join(signals, "id", "left").groupBy("dimension").agg(
        F.count("bucket").alias("signals"), n(need & (F.col("severity") == "high")).alias("h"), n(need).alias("w"), n(F.col("bucket") == Q_).alias("q"),
        n((F.col("bucket") == Q_) & (F.col("id") == "solo-project")).alias("s"), n(F.col("bucket") == W_).alias("ok"),
    )
    solo = (F.col("s") > 0) & (F.col("q") == F.col("s"))
    status = (
        F.when(F.col("h") > 0, "critical").when(F.col("w") > 0, "warning").when(solo, "solo").when(F.col("q") > 0, "warning").when(F.col("ok") > 0, "healthy")
        .when(F.col("dimension") == "hygiene", "healthy").otherwise("unknown")
    )
    return out.select("dimension", status.alias("status"), "signals")


def status_rank(status: Column) -> Column:
    return F.when(status.isin("healthy", "solo"), 0).when(status == "unknown", 1).when(status == "warning", 2).otherwise(3)


def health_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    both = before.select("dimension", F.col("status").alias("before")).join(after.select("dimension", F.col("status").alias("after")), "dimension")
    a, b = status_rank(F.col("before")), status_rank(F.col("after"))
    return both.withColumn("change", F.when(b < a, "improved").when(b > a, "regressed").otherwise("unchanged"))


def verdict_delta(before: DataFrame, after: DataFrame, rulings_before: DataFrame, rulings_after: DataFrame) -> DataFrame:
    """One row: score_delta, critical_delta, grade_changed, departments_changed, direction."""
    moved = rulings_before.select("department", F.col("vote").alias("v")).join(rulings_after, "department").agg(F.count_if(F.col("v") != F.col("vote")).alias("departments_changed"))
    cols = ("score", "critical", "grade")
    one = before.select(*(F.col(c).alias(f"b_{c}") for c in cols)).crossJoin(after.select(*cols)).crossJoin(moved)
    one = one.select((F.col("score") - F.col("b_score")).alias("score_delta"), (F.col("critical") - F.col("b_critical")).alias("critical_delta"), (F.col("grade") != F.col("b_grade")).alias("grade_changed"), "departments_changed")
    s, c = F.col("score_delta"), F.col("critical_delta")
    way = F.when(s > 0, "improved").when(s < 0, "regressed").when(c > 0, "regressed").when(c < 0, "improved").when(F.col("departments_changed") > 0, "mixed").otherwise("unchanged")
    return one.withColumn("direction", way)


def recommendations(signals: DataFrame, limit: int = 5) -> DataFrame:
    """id, category, effort, priority of signals that need work or raise a question."""
    spark = signals.sparkSession
    table = spark.createDataFrame([(k, *v) for k, v in RECOMMENDATIONS.items()], "id string, category string, effort string, base int")
    weight = F.when(F.col("severity") == "high", 100).when(F.col("severity") == "medium", 60).when(F.col("severity") == "low", 30).otherwise(20)
    out = signals.filter(F.col("bucket").isin(N_, Q_)).join(F.broadcast(table), "id").select("id", "category", "effort", (weight + F.col("base")).alias("priority"))
    return out.orderBy(F.desc("priority"), "id").limit(limit)


def adoption(judged: DataFrame, signals: DataFrame, secrets: DataFrame) -> DataFrame:
    """One row: read (ADOPT, GUARDED, AVOID): by outcome, capped by vulnerable dependencies, secrets, and team and age risks."""
    has = lambda *ids: F.count_if(F.col("id").isin(*ids) & (F.col("bucket") == N_))
    s = signals.agg(has("vulnerable-deps", "known-incident-match").alias("bad"), has("bus-factor-risk", "stale", "deprecated-deps").alias("careful"))
    one = judged.select("outcome", "score").crossJoin(s).crossJoin(secrets.agg(F.count_if(F.col("severity").isin("critical", "high")).alias("leaked")))
    read = F.when((F.col("bad") > 0) | (F.col("leaked") > 0), "AVOID").when((F.col("outcome") == "returned") | (F.col("careful") > 0) | (F.col("outcome") == "conditional"), "GUARDED").otherwise("ADOPT")
    return one.withColumn("read", read)


def headline(facts: DataFrame) -> DataFrame:
    """facts, one row: secrets, analyzed, functions, dup_complexity, test_files, untested, top_untested, prod_functions,
    coverage, churn, stale_days. Adds finding and severity: the first that holds."""
    c = F.col
    tests = c("test_files") > 0
    rules = (
        (c("secrets") > 0, "secret-leak", "critical"), (~c("analyzed"), "no-data", "info"), (c("dup_complexity") >= 50, "critical-duplicates", "critical"),
        (tests & (c("untested") >= 5) & (c("top_untested") >= 3), "many-untested-hotspots", "warning"), (tests & (c("prod_functions") >= 20) & (c("coverage") < 30), "low-coverage", "warning"),
        (c("churn") >= 50, "high-churn-hotspot", "warning"), (c("stale_days") > 90, "stale-repo", "info"), (c("functions") == 0, "no-code-parsed", "info"),
    )
    kind, severity = F.lit("generic-healthy"), F.lit("info")
    for holds, name, level in reversed(rules):
        kind, severity = F.when(holds, name).otherwise(kind), F.when(holds, level).otherwise(severity)
    return facts.withColumn("finding", kind).withColumn("severity", severity)
