"""History mining: hotspots, co-change, activity, authorship, pull-request flow.

Every ranking ends in a unique key, so results don't depend on the order of rows. ``identity`` is the
login, or the name where no login is known.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gitstrata.functions import exprs as E


def hotspots(commits: DataFrame, commit_files: DataFrame, limit: int | None = 120) -> DataFrame:
    """path, churn, authors, last_modified, score = churn * ln(authors + 1); the ``limit`` best."""
    out = (
        commit_files.join(commits.select("sha", "ts", "identity"), "sha").groupBy("path")
        .agg(F.count("*").alias("churn"), F.count_distinct("identity").alias("authors"), F.max("ts").alias("last_modified"))
        .withColumn("score", F.round(F.col("churn") * F.ln(F.col("authors") + 1), 6))
    )
    return out.orderBy(F.desc("score"), "path").limit(limit) if limit else out


def co_change(commit_files: DataFrame, allowed: DataFrame, max_files: int = 15, min_count: int = 2, limit: int = 150) -> DataFrame:
    """a < b: pairs of ``allowed`` paths changed together in commits of 2 to ``max_files`` of them.

    A commit's paths are one bounded array (larger commits are dropped before it is built), so pairs are
    made inside a row and only (a, b, count) is shuffled."""
    mine = commit_files.join(allowed.select("path"), "path", "left_semi").distinct()
    sets = mine.groupBy("sha").agg(F.count("*").alias("n")).filter(F.col("n").between(2, max_files)).select("sha")
    lists = mine.join(sets, "sha").groupBy("sha").agg(F.sort_array(F.collect_list("path")).alias("p"))
    pairs = F.flatten(F.transform("p", lambda x, i: F.transform(F.slice(F.col("p"), i + 2, F.size("p")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    out = lists.select(F.explode(pairs).alias("x")).groupBy("x.a", "x.b").agg(F.count("*").alias("commits")).filter(F.col("commits") >= min_count)
    return out.orderBy(F.desc("commits"), "a", "b").limit(limit)


def weekly_activity(commits: DataFrame) -> DataFrame:
    """week (Monday, UTC) and number of commits."""
    return commits.groupBy(F.date_trunc("week", "ts").cast("date").alias("week")).agg(F.count("*").alias("commits"))


def activity_window(commits: DataFrame, weeks: int = 52) -> DataFrame:
    return weekly_activity(commits).orderBy(F.desc("week")).limit(weeks)


def author_index(commits: DataFrame) -> DataFrame:
    """sha and identity: the login, else the login first seen for the name, else the name."""
    seen = commits.filter("author_login is not null").groupBy("author_name").agg(F.min_by("author_login", F.struct("ts", "sha")).alias("known"))
    return commits.join(seen, "author_name", "left").select("sha", F.coalesce("author_login", "known", "author_name").alias("identity"))


def author_shares(commits: DataFrame) -> DataFrame:
    """identity, commits and percent of all commits by people."""
    people = author_index(commits).filter(~E.is_bot(F.col("identity"))).groupBy("identity").agg(F.count("*").alias("commits"))
    total = people.agg(F.sum("commits").alias("all"))  # one row
    return people.crossJoin(F.broadcast(total)).select("identity", "commits", E.percent(F.col("commits"), F.col("all")).alias("pct"))


def file_authors(commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """path and number of its identities, bots left out."""
    ids = author_index(commits).filter(~E.is_bot(F.col("identity")))
    return commit_files.join(ids, "sha").groupBy("path").agg(F.count_distinct("identity").alias("people"))


def contributor_stats(commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """For each identity: commits, top path, favourite weekday (0 Sunday), peak hour, first commit; ties go to the lowest."""
    rows = commit_files.join(author_index(commits), "sha").join(commits.select("sha", "ts"), "sha")

    def top(value: Column, name: str) -> DataFrame:
        n = rows.select("identity", "sha", value.alias("x")).distinct().groupBy("identity", "x").agg(F.count("*").alias("n"))
        return n.groupBy("identity").agg(F.min_by("x", F.struct(-F.col("n"), "x")).alias(name))

    base = rows.groupBy("identity").agg(F.count_distinct("sha").alias("commits"), F.min("ts").alias("first_commit"))
    for value, name in ((F.col("path"), "top_path"), (F.dayofweek("ts") - 1, "weekday"), (F.hour("ts"), "hour")):
        base = base.join(top(value, name), "identity")
    return base


def bus_factor(spots: DataFrame, limit: int = 10) -> DataFrame:
    """folder, churn and the most authors of any of its files."""
    out = spots.groupBy(E.folder_of(F.col("path")).alias("folder")).agg(F.sum("churn").alias("churn"), F.max("authors").alias("authors"))
    return out.orderBy(F.desc("churn"), "folder").limit(limit)


def churn_tree(spots: DataFrame) -> DataFrame:
    """folder, path, churn, the folder's churn, and the file's author-diversity bucket."""
    folder = E.folder_of(F.col("path"))
    sums = spots.groupBy(folder.alias("folder")).agg(F.sum("churn").alias("folder_churn"))
    return spots.select(folder.alias("folder"), "path", "churn", E.diversity_bucket(F.col("authors")).alias("diversity")).join(sums, "folder")


def pr_flow(pull_requests: DataFrame) -> DataFrame:
    """outcome, bucket (time to merge), number of pull requests of people, and their upper median in hours."""
    hours = (F.unix_timestamp("merged_at") - F.unix_timestamp("created_at")) / 3600
    rows = pull_requests.filter(~E.is_bot(F.col("author_login"))).select(
        "number", F.when(F.col("merged"), "Merged").when(F.col("state") == "closed", "Closed").otherwise("StillOpen").alias("outcome"), F.when(F.col("merged"), hours).alias("h"),
    )
    counts = rows.groupBy("outcome", F.when(F.col("h").isNotNull(), E.duration_bucket(F.col("h"))).alias("bucket")).agg(F.count("*").alias("prs"))
    return counts


def upper_median_hours(pull_requests: DataFrame) -> DataFrame:
    """merged (count) and hours: the value at place floor(n / 2), from 0, of the merged pull requests of people.

    Rows are counted by day of length first; only the day that holds the value is looked at by the second."""
    seconds = F.unix_timestamp("merged_at") - F.unix_timestamp("created_at")
    rows = pull_requests.filter(F.col("merged") & ~E.is_bot(F.col("author_login")) & F.col("merged_at").isNotNull()).select(seconds.alias("s"), F.floor(seconds / 86400).alias("day"))
    days = rows.groupBy("day").agg(F.count("*").alias("n"))
    upto = days.withColumn("upto", F.sum("n").over(W.orderBy("day"))).crossJoin(F.broadcast(days.agg(F.sum("n").alias("all"))))  # a row for each day of length
    day = upto.filter(F.col("upto") > F.floor(F.col("all") / 2)).groupBy("all").agg(F.min(F.struct("day", (F.col("upto") - F.col("n")).alias("before"))).alias("x")).select("all", "x.*")
    inside = rows.join(F.broadcast(day), "day").groupBy("all", "before", "s").agg(F.count("*").alias("n"))  # at most the seconds of a day
    place = F.col("before") + F.sum("n").over(W.orderBy("s"))
    return inside.withColumn("upto", place).filter(F.col("upto") > F.floor(F.col("all") / 2)).groupBy("all").agg((F.min("s") / 3600).alias("hours")).withColumnRenamed("all", "merged")


def history_span(commits: DataFrame) -> DataFrame:
    return commits.agg(F.min("ts").alias("earliest"), F.max("ts").alias("latest"), F.count("*").alias("commits"))


def parse_git_log(lines: DataFrame, message_length: int = 200) -> DataFrame:
    """Lines of ``git log`` with fields split by \\x1f: sha, date, name, email, message. The login comes from
    addresses of the form (digits+)LOGIN@users.noreply.github.com."""
    f = F.split("value", "\x1f")
    login = F.regexp_extract(F.get(f, F.lit(3)), r"^(?:\d+\+)?([^@]+)@users\.noreply\.github\.com$", 1)
    return lines.filter(F.size(f) >= 5).select(
        F.get(f, F.lit(0)).alias("sha"), F.get(f, F.lit(1)).alias("date"), F.get(f, F.lit(2)).alias("author_name"), F.get(f, F.lit(3)).alias("author_email"),
        F.when(login != "", login).alias("author_login"), F.left(F.get(f, F.lit(4)), F.lit(message_length)).alias("message"),
    )
