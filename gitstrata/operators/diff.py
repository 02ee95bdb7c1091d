"""Comparisons of two states of a repository: functions, files, rankings, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gitstrata import shared
from gitstrata.functions import exprs as E
from gitstrata.operators import quality

KEY = ["file", "name", "container"]


def _same_key(a: str, b: str) -> Column:
    return (F.col(f"{a}.file") == F.col(f"{b}.file")) & (F.col(f"{a}.name") == F.col(f"{b}.name")) & F.col(f"{a}.container").eqNullSafe(F.col(f"{b}.container"))


def _last(functions: DataFrame) -> DataFrame:
    """One row for each key, the last in its file."""
    rest = F.struct("start_row", "complexity", "body_hash")
    return functions.groupBy(*KEY).agg(F.max(rest).alias("_x")).select(*KEY, "_x.*")


def function_diff(base: DataFrame, head: DataFrame, unchanged: bool = False) -> DataFrame:
    """file, name, container, status, complexity_before, complexity_after, delta, body_changed, row.

    body_changed is null where a hash is missing on either side; that alone is no modification."""
    b, h = _last(base).alias("b"), _last(head).alias("h")
    joined = b.join(h, _same_key("b", "h"), "full_outer")
    body = F.col("b.body_hash") != F.col("h.body_hash")
    status = (
        F.when(F.col("h.file").isNull(), "removed").when(F.col("b.file").isNull(), "added")
        .when((F.col("b.complexity") != F.col("h.complexity")) | F.coalesce(body, F.lit(False)), "modified").otherwise("unchanged")
    )
    both = F.col("b.file").isNotNull() & F.col("h.file").isNotNull()
    out = joined.select(
        *(F.when(F.col("b.file").isNotNull(), F.col(f"b.{k}")).otherwise(F.col(f"h.{k}")).alias(k) for k in KEY), status.alias("status"),
        F.col("b.complexity").alias("complexity_before"), F.col("h.complexity").alias("complexity_after"), F.when(both, F.col("h.complexity") - F.col("b.complexity")).alias("delta"),
        F.when(both, body).alias("body_changed"), F.coalesce("h.start_row", "b.start_row").alias("row"),
    )
    return out if unchanged else out.filter("status <> 'unchanged'")


def diff_summary(changes: DataFrame) -> DataFrame:
    """One row: files_changed, added, removed, modified, net_delta (of modified functions only)."""
    c = changes.filter("status <> 'unchanged'")
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return c.agg(F.count_distinct("file").alias("files_changed"), n("added"), n("removed"), n("modified"), F.coalesce(F.sum(F.when(F.col("status") == "modified", F.col("delta"))), F.lit(0)).alias("net_delta"))


def verification_rules(changes: DataFrame, limit: int | None = 3) -> DataFrame:
    """rule, severity, subject, impact: what a reviewer should check first."""
    key = E.module_key(F.col("file"))
    changes = changes.filter("status <> 'unchanged'").withColumn("_m", key).withColumn("_t", E.is_rule_test_file(F.col("file")))
    tested = changes.filter("_t").select("_m").distinct().withColumn("_has", F.lit(True))
    prod = changes.filter("not _t").join(tested, "_m", "left")
    subject = F.concat_ws(":", "file", F.concat_ws(".", "container", "name"))

    def rule(rows: DataFrame, name: str, severity: str, subject: Column, impact: Column) -> DataFrame:
        return rows.select(F.lit(name).alias("rule"), F.lit(severity).alias("severity"), subject.cast("string").alias("subject"), impact.cast("long").alias("impact"))

    s = diff_summary(changes)
    removals = prod.filter("status = 'removed' and container is not null").groupBy("container").agg(F.count("*").alias("n")).filter("n >= 3")
    out = (
        rule(prod.filter("status = 'modified' and delta >= 4 and _has is null"), "complexity-increase-without-test", "critical", subject, F.col("delta"))
        .unionByName(rule(prod.filter("status = 'added' and complexity_after >= 4 and _has is null"), "new-complex-function-untested", "warning", subject, F.col("complexity_after")))
        .unionByName(rule(prod.filter("status = 'removed' and complexity_before >= 2"), "removed-function-with-impact", "warning", subject, F.col("complexity_before")))
        .unionByName(rule(removals, "multiple-removals-from-container", "warning", F.col("container"), F.col("n")))
        .unionByName(rule(s.filter("net_delta > 10"), "high-net-complexity-delta", "info", F.lit("change"), F.col("net_delta")))
        .unionByName(rule(s.filter("files_changed > 10"), "large-pr-overview", "info", F.lit("change"), F.col("files_changed")))
    )
    rank = F.when(F.col("severity") == "critical", 3).when(F.col("severity") == "warning", 2).otherwise(1)
    return out.orderBy(rank.desc(), F.desc("impact"), "rule", "subject").limit(limit) if limit else out


def file_shift(base: DataFrame, head: DataFrame) -> DataFrame:
    """file, before, after, delta of the summed complexity, a missing side being 0; unchanged files left out."""
    side = lambda t, name: t.groupBy("file").agg(F.sum("complexity").alias(name))
    out = side(base, "before").join(side(head, "after"), "file", "full_outer").fillna(0, ["before", "after"])
    return out.withColumn("delta", F.col("after") - F.col("before")).filter("delta <> 0")


def worst_shifts(base: DataFrame, head: DataFrame, each: int = 5) -> DataFrame:
    """The files that got worse and better by most, ``each`` of either."""
    rows = file_shift(base, head).withColumn("kind", F.when(F.col("delta") > 0, "worse").otherwise("better"))
    order = W.partitionBy("kind").orderBy(F.desc(F.abs("delta")), "file")
    worse = rows.filter("delta > 0").orderBy(F.desc("delta"), "file").limit(each)
    better = rows.filter("delta < 0").orderBy("delta", "file").limit(each)
    return worse.unionByName(better).withColumn("place", F.row_number().over(order))


def structural_diff(base: DataFrame, head: DataFrame) -> DataFrame:
    """kind (function-added, function-removed, duplicate-added, duplicate-dissolved) and how many."""
    changes = function_diff(base, head)
    dup = lambda t: quality.duplicate_groups(t, None).select("body_hash")
    b, h = dup(base), dup(head)
    count = lambda t, kind: t.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return (
        count(changes.filter("status = 'added'"), "function-added").unionByName(count(changes.filter("status = 'removed'"), "function-removed"))
        .unionByName(count(h.join(b, "body_hash", "left_anti"), "duplicate-added")).unionByName(count(b.join(h, "body_hash", "left_anti"), "duplicate-dissolved"))
    )


def structural_lists(base: DataFrame, head: DataFrame, each: int = 10) -> DataFrame:
    """kind (added, removed), place, file, name, container, complexity: the functions that came and went, the most complex first."""
    rows = function_diff(base, head).filter(F.col("status").isin("added", "removed")).select(F.col("status").alias("kind"), "file", "name", "container", F.coalesce("complexity_after", "complexity_before").alias("complexity"))
    place = F.row_number().over(W.partitionBy("kind").orderBy(F.desc("complexity"), "name", "file", "container"))
    return rows.withColumn("place", place).filter(F.col("place") <= each)


def coverage_delta(base: DataFrame, base_calls: DataFrame, head: DataFrame, head_calls: DataFrame) -> DataFrame:
    """One row, from_pct, to_pct, delta: tested production functions as a share; none if either side has no test file."""

    def side(functions: DataFrame, calls: DataFrame, name: str) -> DataFrame:
        tests = functions.select("file").unionByName(calls.select(F.col("from_file").alias("file"))).agg(F.max(E.is_test_file(F.col("file"))).alias("_some"))
        cov = quality.test_coverage(functions, calls).agg(E.percent(F.coalesce(F.sum("tested"), F.lit(0)), F.coalesce(F.sum("functions"), F.lit(0))).alias(name))
        return tests.crossJoin(cov).filter("_some").drop("_some")  # of one row each

    both = side(base, base_calls, "from_pct").crossJoin(side(head, head_calls, "to_pct"))  # of one row each
    return both.withColumn("delta", F.col("to_pct") - F.col("from_pct"))


def file_signatures(functions: DataFrame) -> DataFrame:
    """file and a hash of its complexity and its functions' signatures in order."""
    sig = F.concat_ws("|", "name", F.coalesce("container", F.lit("")), F.col("complexity").cast("string"), F.coalesce("body_hash", F.lit("")))
    return functions.groupBy("file").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(sig)), "\n"), 256).alias("signature"))


def changed_files(base: DataFrame, head: DataFrame) -> DataFrame:
    """file, kind (added, modified, removed)."""
    b, h = file_signatures(base).withColumnRenamed("signature", "_b"), file_signatures(head).withColumnRenamed("signature", "_h")
    kind = F.when(F.col("_b").isNull(), "added").when(F.col("_h").isNull(), "removed").when(F.col("_b") != F.col("_h"), "modified")
    return b.join(h, "file", "full_outer").select("file", kind.alias("kind")).filter("kind is not null")


def change_blast(base: DataFrame, head: DataFrame, base_safety: DataFrame, head_safety: DataFrame) -> DataFrame:
    """The changed files with their tier and dependents: from the head, of removed files from the base."""
    c = changed_files(base, head)
    cols = ["file", "tier", "dependents", "untested_dependents"]
    old = c.filter("kind = 'removed'").join(base_safety.select(*cols), "file", "left")
    new = c.filter("kind <> 'removed'").join(head_safety.select(*cols), "file", "left")
    out = old.unionByName(new).withColumn("is_test", E.is_test_file(F.col("file")))
    return out.fillna("safe", ["tier"]).fillna(0, ["dependents", "untested_dependents"])


def change_verdict(blast: DataFrame, edges: DataFrame, tests: DataFrame) -> DataFrame:
    """One row: walls, load_bearing, reached (distinct dependents of the changed production files), tests, updated, verdict."""
    prod = blast.filter("not is_test")
    reached = edges.filter("src <> dst").distinct().join(prod.select(F.col("file").alias("dst")), "dst").agg(F.count_distinct("src").alias("reached"))
    guards = tests.join(prod.select("file"), "file").select(F.col("test").alias("file")).distinct()
    changed = blast.select("file", F.lit(True).alias("_c"))
    t = guards.join(changed, "file", "left").agg(F.count("*").alias("tests"), F.count_if(F.col("_c")).alias("updated"))
    w = prod.agg(F.count_if(F.col("tier").isin("load-bearing", "handle-with-care")).alias("walls"), F.count_if(F.col("tier") == "load-bearing").alias("load_bearing"))
    verdict = F.when((F.col("load_bearing") > 0) & (F.col("updated") == 0), "high-risk").when((F.col("walls") > 0) | (F.col("reached") >= 10), "review").otherwise("clear")
    one = w.crossJoin(reached).crossJoin(t)  # three tables of one row
    gate = F.when(F.col("verdict") == "clear", "success").when(F.col("verdict") == "review", "neutral").otherwise("failure")
    return one.withColumn("verdict", verdict).withColumn("gate", gate)


def rank_changes(before: DataFrame, after: DataFrame, top: int = 20, limit: int = 5) -> DataFrame:
    """path, from_rank, to_rank of hotspots among the first ``top`` on both sides whose place moved by most."""
    place = lambda t, name: t.orderBy(F.desc("score"), "path").limit(top).select("path", F.row_number().over(W.orderBy(F.desc("score"), "path")).alias(name))  # noqa: E731  at most ``top`` rows
    moved = place(before, "from_rank").join(place(after, "to_rank"), "path").filter("from_rank <> to_rank")
    return moved.orderBy(F.desc(F.abs(F.col("from_rank") - F.col("to_rank"))), "path").limit(limit)


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """commits before and after: one row with new_commits, new_contributors and the login with most new commits."""
    new = after.join(before.select("sha"), "sha", "left_anti")
    people = after.select("identity").distinct().join(before.select("identity").distinct(), "identity", "left_anti")
    by = new.filter("author_login is not null").groupBy("author_login").agg(F.count("*").alias("n"))
    top = by.agg(F.min_by("author_login", F.struct(-F.col("n"), "author_login")).alias("top_committer"), F.max("n").alias("top_commits"))
    return new.agg(F.count("*").alias("new_commits")).crossJoin(people.agg(F.count("*").alias("new_contributors"))).crossJoin(top)


def headline(new_contributors: Column, entering: Column, complexity_delta: Column, new_commits: Column, stars: Column) -> Column:
    """The first of these that holds: contributors, a hotspot entering the top 3, complexity by 20, commits, stars."""
    return (
        F.when(new_contributors > 0, "contributors").when(entering.isNotNull(), "hotspot").when(F.abs(complexity_delta) >= 20, "complexity")
        .when(new_commits > 0, "commits").when(stars != 0, "stars").otherwise("quiet")
    )


#: Metric, least change that counts, and whether growth is bad.
DRIFT = (("avg_complexity", 1.0, True), ("duplication_pct", 1.0, True), ("coverage_pct", 2.0, False), ("connectivity", 0.5, True), ("functions", 0.1, True))


def drift_trends(first: DataFrame, last: DataFrame) -> DataFrame:
    """metric, delta, direction (worse, better, steady) between two rows of drift metrics; worse first."""
    metrics = [m for m, _, _ in DRIFT]
    wide = first.select(*(F.col(m).cast("double").alias(f"a_{m}") for m in metrics)).crossJoin(last.select(*(F.col(m).cast("double").alias(f"b_{m}") for m in metrics)))
    rows = F.array(*(F.struct(F.lit(m).alias("metric"), F.round(F.col(f"b_{m}") - F.col(f"a_{m}"), 6).alias("delta"), F.lit(t).alias("t"), F.lit(bad).alias("bad")) for m, t, bad in DRIFT))
    out = wide.select(F.explode(rows).alias("x")).select("x.*")
    way = F.when(F.abs("delta") < F.col("t"), "steady").when((F.col("delta") > 0) == F.col("bad"), "worse").otherwise("better")
    return out.select("metric", "delta", way.alias("direction"))


def risk_drift(before: DataFrame, after: DataFrame, limit: int = 5) -> DataFrame:
    """file, from, to, delta: fan-in of 8 or more that grew by a quarter and 4 at least."""
    out = after.join(before.withColumnRenamed("fan_in", "before"), "file", "left").withColumn("before", F.coalesce("before", F.lit(0)))
    out = out.withColumn("delta", F.col("fan_in") - F.col("before")).filter((F.col("fan_in") >= 8) & (F.col("delta") >= F.greatest(F.lit(4), F.ceil(0.25 * F.col("before")))))
    return out.select("file", "before", F.col("fan_in").alias("after"), "delta").orderBy(F.desc("delta"), F.desc("after"), "file").limit(limit)


def merge_confidence(changes: DataFrame, calls: DataFrame, functions: DataFrame, pool: int = 60) -> DataFrame:
    """The changed production functions that carry most risk: callers (within 3 hops), direct, untested, risk, read.

    The ``pool`` with the largest complexity and change are traversed, all as seeds of one frontier."""
    from gitstrata.operators import traverse

    prod = changes.filter(~E.is_test_file(F.col("file"))).withColumn("cx", F.coalesce("complexity_after", "complexity_before"))
    prod = prod.withColumn("id", F.expr(traverse.function_id())).orderBy(F.desc(F.col("cx") + F.coalesce(F.abs("delta"), F.lit(0))), "id").limit(pool)
    prod = shared.written(prod.select("id", "file", "name", "container", "status", "cx"))
    back = traverse.reversed_edges(shared.written(traverse.function_edges(calls, tests=False), "edges"))
    near = traverse.reach(back, prod.select(F.col("id").alias("seed")), prepared=True).groupBy(F.col("seed").alias("id")).agg(F.count("*").alias("callers"), F.count_if(F.col("hop") == 1).alias("direct"))
    tested = quality.tested_functions(functions, calls).filter("testers > 0").withColumn("id", F.expr(traverse.function_id())).select("id").distinct().withColumn("_t", F.lit(True))
    out = prod.join(near, "id", "left").join(tested, "id", "left").fillna(0, ["callers", "direct"]).withColumn("untested", F.col("_t").isNull()).drop("_t")
    risk = (1 + F.col("callers")) * (1 + F.col("cx") / 10) * F.when(F.col("untested"), 1.8).otherwise(1.0) * F.when(F.col("status") == "removed", 1.5).otherwise(1.0)
    gone = F.col("status") == "removed"
    read = (
        F.when((F.col("untested") & (F.col("callers") >= 10)) | (gone & (F.col("direct") >= 3)), "HIGH BLAST")
        .when((F.col("untested") & (F.col("callers") >= 3)) | (gone & (F.col("callers") >= 1)), "REVIEW").otherwise("OK")
    )
    return out.withColumn("risk", F.round(risk, 6)).withColumn("read", read)


def replaced(parsed: DataFrame, changed: DataFrame, patch: DataFrame) -> DataFrame:
    """The parse relation after a change: rows of changed files leave, those of the patch come in. Rebuilding a
    graph from it gives what a full analysis of the changed tree would."""
    return parsed.join(changed.select("file").distinct(), "file", "left_anti").unionByName(patch)


def affected_files(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """Files one hop upstream of the changed ones, themselves left out."""
    hit = edges.join(changed.select(F.col("file").alias("dst")), "dst").select(F.col("src").alias("file")).distinct()
    return hit.join(changed.select("file"), "file", "left_anti")


#: The required actions that block a change.
BLOCKING = ("no-guarding-tests", "guarding-tests-will-break", "hollow-tests-added")


def required_actions(blast: DataFrame, tests: DataFrame, affected: DataFrame, base: DataFrame, head: DataFrame, base_suite: DataFrame, head_suite: DataFrame) -> DataFrame:
    """kind, severity, n, blocking: what a change asks for before it goes in.

    blast: the changed files (file, kind, tier, is_test). tests: tests to run (file, test). affected: files that the change
    breaks. base, head: functions; base_suite, head_suite: test suites with ``smoke`` cases."""
    prod = blast.filter("not is_test")
    walls = prod.agg(F.count_if(F.col("tier") == "load-bearing").alias("walls"), F.count_if((F.col("tier") == "load-bearing") & (F.col("kind") == "removed")).alias("gone"))
    guards = tests.join(prod.select("file"), "file").select(F.col("test").alias("file")).distinct().join(blast.select("file", F.lit(True).alias("_c")), "file", "left").agg(F.count("*").alias("guards"), F.count_if("_c").alias("updated"))
    total = lambda t, c, name: t.agg(F.coalesce(F.sum(c), F.lit(0)).alias(name))
    dups = lambda t, name: total(quality.duplicate_groups(t, None), "members", name)
    one = walls
    for row in (guards, affected.agg(F.count("*").alias("broken")), total(base_suite, "smoke", "s0"), total(head_suite, "smoke", "s1"), dups(base, "d0"), dups(head, "d1")):
        one = one.crossJoin(row)  # tables of one row
    hit, c = F.col("walls") > 0, F.col
    whole = c("gone") == c("walls")
    rows = (
        (hit, "load-bearing-touched", "high", c("broken")), (hit & (c("guards") == 0), "no-guarding-tests", "high", c("walls")), (hit & (c("guards") > 0) & whole, "guarding-tests-will-break", "high", c("guards")),
        (hit & (c("guards") > 0) & ~whole & (c("updated") < c("guards")), "update-guarding-tests", "high", c("guards") - c("updated")), (c("s1") > c("s0"), "hollow-tests-added", "medium", c("s1") - c("s0")), (c("d1") > c("d0"), "new-duplicate", "low", c("d1") - c("d0")),
    )
    every = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(v).alias("severity"), n.cast("long").alias("n"), F.lit(k in BLOCKING).alias("blocking"), holds.alias("_on")) for holds, k, v, n in rows))
    return one.select(F.explode(every).alias("x")).select("x.*").filter("_on").drop("_on")


def gate(actions: DataFrame) -> DataFrame:
    """One row: pass, blocking, advisory."""
    return actions.agg(F.count_if("blocking").alias("blocking"), F.count_if(~F.col("blocking")).alias("advisory")).withColumn("pass", F.col("blocking") == 0)
