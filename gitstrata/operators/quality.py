"""Tests, duplicates and the risk of changing a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gitstrata import shared
from gitstrata.functions import exprs as E

KEY = ["file", "name", "container"]


def tested_functions(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """functions of production files with ``testers``: how many test files call them."""
    hits = (
        calls.filter("to_fn is not null").filter(E.is_test_file(F.col("from_file")) & ~E.is_test_file(F.col("to_file")))
        .groupBy(F.col("to_file").alias("file"), F.col("to_fn").alias("name"), F.coalesce("to_container", F.lit("")).alias("_c")).agg(F.count_distinct("from_file").alias("testers"))
    )
    own = functions.filter(~E.is_test_file(F.col("file"))).withColumn("_c", F.coalesce("container", F.lit("")))
    return own.join(hits, ["file", "name", "_c"], "left").drop("_c").withColumn("testers", F.coalesce("testers", F.lit(0)))


def test_coverage(functions: DataFrame, calls: DataFrame) -> DataFrame:
    """For each production file: functions, tested, pct."""
    out = tested_functions(functions, calls).groupBy("file").agg(F.count("*").alias("functions"), F.count_if(F.col("testers") > 0).alias("tested"))
    return out.withColumn("pct", E.percent(F.col("tested"), F.col("functions")))


def untested_hotspots(functions: DataFrame, calls: DataFrame, limit: int = 10) -> DataFrame:
    rows = tested_functions(functions, calls).filter("testers = 0").select("file", "name", "container", "complexity", "start_row")
    return rows.orderBy(F.desc("complexity"), "file", "name", "container", "start_row").limit(limit)


def tested_files(edges: DataFrame) -> DataFrame:
    """Production files that a test file imports or calls."""
    return edges.filter(E.is_test_file(F.col("src")) & ~E.is_test_file(F.col("dst"))).select(F.col("dst").alias("file")).distinct()


def duplicate_groups(functions: DataFrame, limit: int | None = 15) -> DataFrame:
    """body_hash of functions of complexity 2 or more that two or more files share: members, files, max_complexity,
    first (the smallest place), score = members * max_complexity."""
    rows = functions.filter("body_hash is not null and complexity >= 2")
    out = rows.groupBy("body_hash").agg(
        F.count("*").alias("members"), F.count_distinct("file").alias("files"), F.max("complexity").alias("max_complexity"), F.min(F.struct("file", "start_row")).alias("_f"),
    )
    out = out.filter("members >= 2 and files >= 2").select("body_hash", "members", "files", "max_complexity", F.col("_f.file").alias("first"), (F.col("members") * F.col("max_complexity")).alias("score"))
    return out.orderBy(F.desc("score"), F.desc("max_complexity"), F.desc("members"), "first", "body_hash").limit(limit) if limit else out


def duplicate_summary(functions: DataFrame) -> DataFrame:
    return duplicate_groups(functions, None).agg(F.count("*").alias("groups"), F.coalesce(F.sum("members"), F.lit(0)).alias("members"), F.coalesce(F.max("members"), F.lit(0)).alias("largest"))


def weak_suite(test_cases: DataFrame) -> DataFrame:
    """For each test file: cases, density (assertions a case), smoke (cases that prove nothing), ratio, tier, rank."""
    smoke = (F.col("assertions") == 0) | ~F.coalesce("has_meaningful_oracle", F.lit(False))
    out = test_cases.groupBy("file").agg(F.count("*").alias("cases"), F.sum("assertions").alias("_a"), F.count_if(smoke).alias("smoke"))
    out = out.withColumn("density", E.round_to(F.col("_a") / F.col("cases"), 2)).withColumn("ratio", E.round_to(F.col("smoke") / F.col("cases"), 2))
    tier = F.when(F.col("ratio") >= 0.5, "hollow").when((F.col("ratio") >= 0.2) | (F.col("density") < 1), "thin").otherwise("solid")
    out = out.withColumn("tier", tier)
    return out.drop("_a").withColumn("rank", F.when(F.col("tier") == "hollow", 1000).when(F.col("tier") == "thin", 500).otherwise(0) + F.col("smoke"))


def safety_tier(dependents: Column, untested: Column, complexity: Column, duplicated: Column) -> Column:
    wide, some = dependents >= 8, dependents >= 3
    return (
        F.when(wide & ((untested >= 3) | (complexity >= 30)), "load-bearing")
        .when(wide | (some & ((untested >= 1) | (complexity >= 20))) | (duplicated >= 2), "handle-with-care")
        .when((dependents >= 1) | (complexity >= 15) | (duplicated >= 1), "moderate").otherwise("safe")
    )


def refactor_safety(files: DataFrame, functions: DataFrame, edges: DataFrame, prepared: bool = False) -> DataFrame:
    """file, dependents, untested_dependents, complexity, duplicated, tier, rank for production files with any of them.
    prepared: the edges are distinct already, none leads to where it starts."""
    prod = ~E.is_test_file(F.col("file"))
    # each edge is told apart once, as both ends' names are looked at for that
    pairs = edges if prepared else edges.filter("src <> dst").distinct()
    pairs = pairs.withColumn("_src_test", E.is_test_file(F.col("src"))).withColumn("_dst_test", E.is_test_file(F.col("dst")))
    pairs = shared.large(pairs.filter("not _dst_test").drop("_dst_test"), "pairs")
    tested = pairs.filter("_src_test").select(F.col("dst").alias("src"), F.lit(True).alias("_t")).distinct()
    bare = ~F.col("_src_test") & F.col("_t").isNull()
    fans = pairs.join(tested, "src", "left").groupBy(F.col("dst").alias("file")).agg(F.count("*").alias("dependents"), F.count_if(bare).alias("untested_dependents"))
    dups = functions.join(duplicate_groups(functions, None).select("body_hash"), "body_hash").filter("complexity >= 2").groupBy("file").agg(F.count("*").alias("duplicated"))
    every = files.select("file").union(functions.select("file")).filter(prod).union(fans.select("file")).distinct()
    out = every.join(files.select("file", "complexity"), "file", "left").join(fans, "file", "left").join(dups, "file", "left")
    numbers = ("dependents", "untested_dependents", "complexity", "duplicated")
    out = out.select("file", *(F.coalesce(c, F.lit(0)).alias(c) for c in numbers)).filter(" + ".join(numbers) + " > 0")
    d, u, c, dup = map(F.col, numbers)
    return out.withColumn("tier", safety_tier(d, u, c, dup)).withColumn("rank", 2 * d + 3 * u + 0.5 * c + 2 * dup)


#: Tests of a file that are held in one row at most, about.
TESTS_A_ROW = 4096


def _numbered(names: DataFrame) -> DataFrame:
    """names: test, each once. Adds id, from 0 without gaps in the order of the names, and plain, what the test is named after."""
    plain = F.regexp_replace(E.importable_name(F.col("test")), r"^test_|_test$|_spec$|\.(test|spec)$|Tests?$", "")
    out = shared.written(names.orderBy("test").select("test", plain.alias("plain"), F.monotonically_increasing_id().alias("_n")), "tests")
    part, low = F.shiftright("_n", 33), F.col("_n").bitwiseAND(F.lit((1 << 33) - 1))
    counts = {r.p: r.n for r in out.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # a row for each sorted partition
    before = [0]
    for p in range(max(counts, default=0)):
        before.append(before[-1] + counts.get(p, 0))
    return shared.growing(out.select("test", "plain", (F.element_at(F.array(*map(F.lit, before)), (part + 1).cast("int")) + low).cast("long").alias("id")))


def tests_to_run(safety: DataFrame, edges: DataFrame, limit: int = 10) -> DataFrame:
    """For each file of the two upper tiers the runnable tests that guard it and its dependents, the best ``limit``:
    those that reach the file itself, then of a like name, then those that guard most.

    A file has as many pairs of dependents and their tests as it has ways to a test, so these are numbers: a dependent's tests come as one
    list, what their names are like is told where names still are at hand, and lists are dealt by file once, counted and ranked there."""
    top = shared.growing(safety.filter(F.col("tier").isin("load-bearing", "handle-with-care")).select("file").distinct())
    guards = edges.filter("src <> dst").filter(E.is_runnable_test_file(F.col("src"))).select(F.col("src").alias("test"), F.col("dst").alias("hit"))
    names = _numbered(guards.select("test").distinct())
    blocks = F.ceil(F.count("*").over(W.partitionBy("hit")) / TESTS_A_ROW)
    lists = guards.join(names, "test").withColumn("_block", F.pmod("id", blocks)).groupBy("hit", "_block").agg(F.collect_set(F.struct("id", "plain")).alias("tests")).drop("_block")
    # dealt by the file, which is enough to tell pairs apart
    pairs = edges.filter("src <> dst").select(F.col("dst").alias("file"), F.col("src").alias("hit")).repartition("file").distinct()
    near = top.select("file", F.col("file").alias("hit")).unionByName(pairs.join(top, "file", "left_semi"))
    stem = E.importable_name(F.col("file"))
    alike = lambda x: F.when(x["plain"] == stem, 2).when(x["plain"].startswith(stem), 1).otherwise(0)
    kind = "int" if names.count() < 1 << 29 else "bigint"
    ways = near.join(lists, "hit").select("file", (F.col("hit") == F.col("file")).alias("direct"), F.transform("tests", lambda x: (x["id"] * 4 + alike(x)).cast(kind)).alias("tests"))
    got = ways.repartition("file").select("file", "direct", F.explode("tests").alias("_t")).groupBy("file", "_t").agg(F.count("*").alias("guards"), F.max("direct").alias("direct"))
    got = got.select("file", F.shiftright("_t", 2).cast("long").alias("id"), "guards", "direct", F.col("_t").bitwiseAND(F.lit(3)).cast("int").alias("affinity"))
    order = W.partitionBy("file").orderBy(F.desc("direct"), F.desc("affinity"), F.desc("guards"), "id")
    best = got.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= limit)
    return best.join(names.select("id", "test"), "id").select("file", "test", "guards", "direct", "affinity", "place")


def drift_metrics(files: DataFrame, functions: DataFrame, calls: DataFrame) -> DataFrame:
    """One row: files, functions, average and largest file complexity, duplication and coverage in percent, calls a function."""
    f = files.agg(F.count("*").alias("files"), E.round_to(F.avg("complexity"), 2).alias("avg_complexity"), F.max("complexity").alias("max_complexity"))
    n = functions.agg(F.count("*").alias("functions"))
    d = duplicate_summary(functions).select("members")
    c = test_coverage(functions, calls).agg(F.sum("tested").alias("tested"), F.sum("functions").alias("prod"))
    r = calls.agg(F.count_if(F.col("to_file").isNotNull()).alias("resolved"))
    one = f.crossJoin(n).crossJoin(d).crossJoin(c).crossJoin(r)  # five tables of one row
    ratio = lambda a, b, k, digits: F.when(F.col(b) > 0, E.round_to(F.col(a) * k / F.col(b), digits)).otherwise(0.0)
    return one.select(
        "files", "functions", "avg_complexity", "max_complexity", ratio("members", "functions", 100, 1).alias("duplication_pct"),
        ratio("tested", "prod", 100, 1).alias("coverage_pct"), ratio("resolved", "functions", 1, 2).alias("connectivity"),
    )


def complexity_concentration(functions: DataFrame, min_functions: int = 40, share: float = 0.05) -> DataFrame:
    """One row: functions, top (how many are the top 5 percent, at least 3), their share of all complexity, in percent.

    Complexities are counted by value, so the running totals are over values, not functions."""
    prod = functions.filter(~E.is_test_file(F.col("file"))).groupBy("complexity").agg(F.count("*").alias("n"))
    total = prod.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("functions"), F.coalesce(F.sum(F.col("n") * F.col("complexity")), F.lit(0)).alias("all"))
    total = total.withColumn("top", F.greatest(F.lit(3), E.round_half_up(F.col("functions") * share)))
    before = F.coalesce(F.sum("n").over(W.orderBy(F.desc("complexity")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    taken = F.greatest(F.lit(0), F.least(F.col("n"), F.col("top") - F.col("_before")))
    heavy = prod.withColumn("_before", before).crossJoin(F.broadcast(total.select("top"))).agg(F.coalesce(F.sum(taken * F.col("complexity")), F.lit(0)).alias("heavy"))
    out = total.crossJoin(heavy).withColumn("pct", E.percent(F.col("heavy"), F.col("all")))
    return out.select("functions", "top", "pct", ((F.col("functions") >= min_functions) & (F.col("pct") >= 35)).alias("concentrated"))
