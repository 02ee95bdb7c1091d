"""Dependencies, software bills of materials, and the hardening of workflows."""

from __future__ import annotations

import json
import tomllib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gitstrata import shared
from gitstrata.functions import exprs as E
from gitstrata.sources import facts

# Known supply-chain incidents as (incident, ecosystem, package, compromised versions).
INCIDENTS = (
    ("eslint-config-prettier-2025", "npm", "eslint-config-prettier", ("8.10.1", "9.1.1", "10.1.6", "10.1.7")),
    ("solana-web3-js-2024", "npm", "@solana/web3.js", ("1.95.6", "1.95.7")),
    ("colors-faker-sabotage-2022", "npm", "colors", ("1.4.1", "1.4.2", "1.4.44-liberty-2")),
    ("colors-faker-sabotage-2022", "npm", "faker", ("6.6.6",)),
    ("ua-parser-js-2021", "npm", "ua-parser-js", ("0.7.29", "0.8.0", "1.0.0")),
    ("event-stream-2018", "npm", "flatmap-stream", ("0.1.1",)),
    ("event-stream-2018", "npm", "event-stream", ("3.3.6",)),
    ("rc-2021", "npm", "rc", ("1.2.9", "1.3.9", "2.3.9")),
    ("node-ipc-protestware-2022", "npm", "node-ipc", ("10.1.1", "10.1.2")),
    ("ctx-pypi-2022", "pypi", "ctx", ("0.2.2", "0.2.6", "0.2.7", "0.2.8")),
    ("rustdecimal-typosquat-2022", "cargo", "rustdecimal", ("1.23.1",)),
    ("lottiefiles-lottie-player-2024", "npm", "@lottiefiles/lottie-player", ("2.0.5", "2.0.6", "2.0.7")),
)
ID = ["ecosystem", "name"]


def incident_table(spark: SparkSession, rows=INCIDENTS) -> DataFrame:
    flat = [(i, e, n, v) for i, e, n, vs in rows for v in vs]
    return spark.createDataFrame(flat, "incident string, ecosystem string, name string, version string")


def declared(deps: DataFrame, own_names: DataFrame | None = None, limit: int | None = 300) -> DataFrame:
    """ecosystem, name, declared, scope, sources (at most 5): one row a declaration. A manifest of examples, docs or
    tests gives dev dependencies only; a runtime declaration wins. Of more than ``limit`` an ecosystem the first stay."""
    from pyspark.sql import Window as W

    if own_names is not None:
        deps = deps.join(own_names, ID, "left_anti")
    shipped = (F.col("scope") == "runtime") & ~F.col("source_path").rlike(E.NON_SHIPPED_RE)
    out = deps.groupBy(*ID, "declared").agg(
        F.when(F.max(shipped), "runtime").otherwise("dev").alias("scope"), F.slice(F.sort_array(F.collect_set("source_path")), 1, 5).alias("sources"),
    )
    if limit is None:
        return out
    order = W.partitionBy("ecosystem").orderBy("name", "declared")
    return out.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= limit).drop("_n")


def resolved(deps: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds current (a concrete version), exact, latest, version (exact pins stay, ranges resolve to the latest)."""
    out = deps.withColumn("current", E.normalized_version(F.col("ecosystem"), F.col("declared"))).withColumn("exact", E.is_exact(F.col("ecosystem"), F.col("declared")))
    out = out.filter("current is not null").join(registry, ID, "left")
    return out.withColumn("version", F.when(F.col("exact"), F.col("current")).otherwise(F.coalesce("latest", "current")))


def outdated(rows: DataFrame, months: int = 6) -> DataFrame:
    """Exact pins behind the latest version by ``months`` of 30 days or more."""
    age = E.round_half_up((F.unix_timestamp("time_of_latest") - F.unix_timestamp("time_of_current")) / (30 * 86400))
    return rows.filter("exact and latest <> current").withColumn("months", age.cast("long")).filter(F.col("months") >= months).select(*ID, "current", "latest", "scope", "months")


def vulnerable(rows: DataFrame, advisories: DataFrame, ids: int = 5) -> DataFrame:
    hit = rows.join(advisories, [*ID, "version"]).groupBy(*ID, "version", "scope").agg(F.sort_array(F.collect_set("cve_id")).alias("_c"))
    return hit.select(*ID, "version", "scope", F.size("_c").cast("long").alias("cves"), F.array_join(F.slice("_c", 1, ids), ",").alias("ids"))


def deprecated(rows: DataFrame) -> DataFrame:
    return rows.filter("deprecated is not null").select(*ID, "current", "scope", "deprecated")


def components(rows: DataFrame) -> DataFrame:
    """purl, name, version, ecosystem, scope: a bill of materials' parts, one row a purl, runtime winning."""
    out = rows.withColumn("purl", E.purl(F.col("ecosystem"), F.col("name"), F.col("version")))
    return out.groupBy("purl").agg(*(F.min(c).alias(c) for c in ("ecosystem", "name", "version")), F.max(F.col("scope")).alias("scope"))


def cyclonedx(parts: DataFrame) -> DataFrame:
    """purl and a CycloneDX 1.5 component as JSON; a document's component list is these in purl order."""
    scope = F.when(F.col("scope") == "runtime", "required").otherwise("optional")
    body = F.struct(F.lit("library").alias("type"), F.col("purl").alias("bom-ref"), "name", "version", "purl", scope.alias("scope"))
    return parts.select("purl", F.to_json(body).alias("component"))


def spdx(parts: DataFrame) -> DataFrame:
    """purl, an SPDX 2.3 package and its relationship to the document, as JSON."""
    ref = F.concat(F.lit("SPDXRef-"), F.left(F.sha2("purl", 256), F.lit(16)))
    package = F.struct(ref.alias("SPDXID"), "name", F.col("version").alias("versionInfo"), F.lit("NOASSERTION").alias("downloadLocation"))
    kind = F.when(F.col("scope") == "runtime", "DEPENDS_ON").otherwise("DEV_DEPENDENCY_OF")
    relation = F.struct(F.lit("SPDXRef-DOCUMENT").alias("spdxElementId"), kind.alias("relationshipType"), ref.alias("relatedSpdxElement"))
    return parts.select("purl", F.to_json(package).alias("package"), F.to_json(relation).alias("relationship"))


def known_incidents(rows: DataFrame, incidents: DataFrame) -> DataFrame:
    """incident, ecosystem, name, current where the current version contains a compromised one. ``incidents`` is the
    fixed table above or one like it."""
    return rows.join(incidents.withColumnRenamed("version", "_bad"), ID).filter(F.contains("current", "_bad")).select("incident", *ID, "current").distinct()


def classified_actions(workflows: DataFrame, owner: str = "") -> DataFrame:
    uses = F.col("uses")
    return workflows.select("workflow", "uses", E.pin_class(uses).alias("pin"), E.is_third_party(uses, F.lit(owner)).alias("third_party"))


def workflow_findings(workflows: DataFrame, owner: str = "") -> DataFrame:
    """finding, severity, count. workflows: workflow, uses, scope, job."""
    acts = classified_actions(workflows, owner)
    loose = acts.filter(F.col("pin").isin("tag", "branch")).agg(F.count("*").alias("count"), F.max("third_party").alias("_t"))
    third = acts.filter("third_party and pin <> 'docker'").agg(F.count_distinct(F.regexp_replace("uses", "@[^@]*$", "")).alias("count"))
    broad = workflows.select("workflow", "scope", "job").distinct().filter("scope = 'write-all' or (job is null and scope = 'unspecified')")
    broad = broad.agg(F.count("*").alias("count"), F.max(F.col("scope") == "write-all").alias("_w"))
    row = lambda t, name, sev: t.filter("count > 0").select(F.lit(name).alias("finding"), sev.alias("severity"), "count")
    return (
        row(loose, "unpinned-actions", F.when(F.col("_t"), "high").otherwise("medium")).unionByName(row(third, "third-party-actions", F.lit("low")))
        .unionByName(row(broad, "broad-permissions", F.when(F.col("_w"), "high").otherwise("medium")))
    )


def posture(findings: DataFrame) -> DataFrame:
    worst = F.when(F.max(F.col("severity") == "high"), "exposed").when(F.max(F.col("severity") == "medium"), "attention").otherwise("hardened")
    return findings.agg(worst.alias("posture"), F.count("*").alias("findings"))


def npm_manifest(manifests: DataFrame) -> DataFrame:
    """path, content of package.json files to ecosystem, name, declared, source_path, scope."""
    sets = (("dependencies", "runtime"), ("peerDependencies", "runtime"), ("devDependencies", "dev"))
    doc = F.from_json("content", ", ".join(f"{k} map<string, string>" for k, _ in sets))
    rows = F.flatten(F.array(*(F.transform(F.map_entries(F.coalesce(F.col(f"_d.{k}"), F.create_map().cast("map<string,string>"))), _entry(s)) for k, s in sets)))
    return manifests.withColumn("_d", doc).select("path", F.explode(rows).alias("x")).select(F.lit("npm").alias("ecosystem"), "x.name", "x.declared", F.col("path").alias("source_path"), "x.scope")


def _entry(scope: str):
    return lambda e: F.struct(e.key.alias("name"), e.value.alias("declared"), F.lit(scope).alias("scope"))


def requirements_manifest(manifests: DataFrame) -> DataFrame:
    """requirements*.txt files; the exact name gives runtime dependencies, others dev ones."""
    line = F.trim(F.regexp_replace("l", r"\s+#.*$|^#.*$", ""))
    rows = manifests.select("path", F.explode(F.split("content", "\n")).alias("l")).select("path", line.alias("l")).filter(F.col("l").rlike(r"^[A-Za-z0-9]"))
    name = F.regexp_replace(F.lower(F.regexp_extract("l", r"^([A-Za-z0-9._-]+)", 1)), "[-_.]+", "-")
    spec = F.trim(F.regexp_extract("l", r"^[A-Za-z0-9._-]+(?:\[[^\]]*\])?\s*([^;]*)", 1))
    scope = F.when(E.basename(F.col("path")) == "requirements.txt", "runtime").otherwise("dev")
    return rows.select(F.lit("pypi").alias("ecosystem"), name.alias("name"), F.when(spec == "", "*").otherwise(spec).alias("declared"), F.col("path").alias("source_path"), scope.alias("scope"))


def toml_json(text: str) -> Column:
    """TOML in a column as JSON; null for null and for what isn't TOML."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> str | None:
            try:
                return json.dumps(tomllib.loads(t), default=str) if isinstance(t, str) else None
            except tomllib.TOMLDecodeError:
                return None

        return pd.Series([one(t) for t in texts], dtype=object)

    return run(F.col(text))


def _listed(manifests: DataFrame, ecosystem: str, *parts: Column) -> DataFrame:
    """The entries (name, declared, scope) of arrays as declarations."""
    rows = F.flatten(F.array(*(F.coalesce(p, F.array().cast("array<struct<name:string,declared:string,scope:string>>")) for p in parts)))
    out = manifests.select("path", F.explode(rows).alias("x")).select(F.lit(ecosystem).alias("ecosystem"), "x.name", "x.declared", F.col("path").alias("source_path"), "x.scope")
    return out.filter("declared is not null")


def _table(values: Column, scope: str, skip: str = "") -> Column:
    """Entries of a table of name to version or to {version, package}; those from git, a path or a workspace have no version."""
    inside = lambda e, k: F.get_json_object(e.value, f"$.{k}")
    given = lambda e: F.when(~e.value.startswith("{"), e.value).when(inside(e, "git").isNull() & inside(e, "path").isNull() & inside(e, "workspace").isNull(), inside(e, "version"))
    name = lambda e: F.when(e.value.startswith("{"), F.coalesce(inside(e, "package"), e.key)).otherwise(e.key)
    return F.transform(F.filter(F.map_entries(values), lambda e: F.lower(e.key) != skip), lambda e: F.struct(name(e).alias("name"), given(e).alias("declared"), F.lit(scope).alias("scope")))


def cargo_manifest(manifests: DataFrame) -> DataFrame:
    """path, content of Cargo.toml files: dependencies and those of the workspace ship, dev and build ones don't."""
    doc = F.from_json(toml_json("content"), "dependencies map<string,string>, `dev-dependencies` map<string,string>, `build-dependencies` map<string,string>, workspace struct<dependencies: map<string,string>>")
    m = manifests.select("path", doc.alias("d"))
    return _listed(m, "cargo", _table(F.col("d.dependencies"), "runtime"), _table(F.col("d.`dev-dependencies`"), "dev"), _table(F.col("d.`build-dependencies`"), "dev"), _table(F.col("d.workspace.dependencies"), "runtime"))


def _required(lines: Column, scope: str) -> Column:
    """Entries of a list of requirements such as ``name[extra] >= 1; marker``."""
    name = lambda x: F.regexp_replace(F.lower(F.regexp_extract(x, r"^\s*([A-Za-z0-9._-]+)", 1)), "[-_.]+", "-")
    spec = lambda x: F.trim(F.regexp_extract(x, r"^\s*[A-Za-z0-9._-]+(?:\[[^\]]*\])?\s*([^;]*)", 1))
    return F.transform(F.filter(lines, lambda x: x.rlike(r"^\s*[A-Za-z0-9]")), lambda x: F.struct(name(x).alias("name"), F.when(spec(x) == "", "*").otherwise(spec(x)).alias("declared"), F.lit(scope).alias("scope")))


def pyproject_manifest(manifests: DataFrame) -> DataFrame:
    """path, content of pyproject.toml files, in the three forms that declare dependencies; optional and group ones are dev."""
    poetry = "dependencies: map<string,string>, `dev-dependencies`: map<string,string>, `group`: map<string, struct<dependencies: map<string,string>>>"
    doc = F.from_json(toml_json("content"), f"project struct<dependencies: array<string>, `optional-dependencies`: map<string, array<string>>>, tool struct<poetry: struct<{poetry}>, flit: struct<metadata: struct<requires: array<string>>>>")
    m = manifests.select("path", doc.alias("d"))
    groups = F.flatten(F.transform(F.map_values("d.tool.poetry.group"), lambda g: F.coalesce(_table(g.dependencies, "dev", "python"), F.array().cast("array<struct<name:string,declared:string,scope:string>>"))))
    return _listed(
        m, "pypi", _required(F.col("d.project.dependencies"), "runtime"), _required(F.flatten(F.map_values(F.col("d.project.`optional-dependencies`"))), "dev"),
        _table(F.col("d.tool.poetry.dependencies"), "runtime", "python"), _table(F.col("d.tool.poetry.`dev-dependencies`"), "dev", "python"), groups, _required(F.col("d.tool.flit.metadata.requires"), "runtime"),
    )


def outline(content: Column) -> Column:
    """The keys of an indented file, in order: structs path (keys above, outermost first), key, value. What a key stands under is the last
    line indented less; a dash counts as indentation. Comments, and the lines of a text that ``|`` or ``>`` opens, are left out.
    A stack of the open keys is carried over the lines, so a file should be of a size that one row may have."""
    entry, row = "struct<col:int,key:string,text:boolean>", "struct<path:array<string>,key:string,value:string>"
    start = F.struct(F.array().cast(f"array<{entry}>").alias("stack"), F.array().cast(f"array<{row}>").alias("out"))

    def step(acc: Column, line: Column) -> Column:
        col = F.char_length(F.regexp_extract(line, r"^( *(?:- +)*)", 1))
        above = F.filter(acc.stack, lambda e: e.col < col)
        inside = F.exists(above, lambda e: e.text)
        key = F.regexp_replace(F.regexp_extract(line, r"^ *(?:- +)*([^\s#:][^:]*?) *:(?: |$)", 1), "^[\"']|[\"']$", "")
        value = F.regexp_replace(F.regexp_extract(line, r"^ *(?:- +)*[^\s#:][^:]*? *: +(.*)$", 1), r"(^|\s+)#.*$", "")
        item = F.struct(F.transform(above, lambda e: e.key).alias("path"), key.alias("key"), F.regexp_replace(F.trim(value), "^[\"']|[\"']$", "").alias("value"))
        now = F.struct(F.concat(above, F.array(F.struct(col.alias("col"), key.alias("key"), F.trim(value).rlike("^[|>][-+0-9]*$").alias("text")))).alias("stack"), F.concat(acc.out, F.array(item)).alias("out"))
        return F.when(inside | (key == "") | F.trim(line).startswith("#"), acc).otherwise(now)

    return F.aggregate(F.split(F.regexp_replace(content, "\r", ""), "\n"), start, step, lambda acc: acc.out)


def permission_scope(value: Column, entries: Column) -> Column:
    """What a ``permissions`` key says; entries: how many keys stand below it."""
    return F.when(value.isin("write-all", "read-all"), value).when((entries > 0) | value.startswith("{"), "granular").otherwise("unspecified")


def workflow_keys(files: DataFrame) -> DataFrame:
    """path, content of workflow files to workflow, path, key, value."""
    return facts.dealt(files.select("path", "content"), "path").select(F.col("path").alias("workflow"), F.explode(outline(F.col("content"))).alias("x")).select("workflow", "x.path", "x.key", "x.value")


def hardening_keys(files: DataFrame) -> DataFrame:
    """Those of ``workflow_keys`` that say what is used and permitted, as a table: outlines cost most, and several steps ask for them."""
    return shared.written(workflow_keys(files).filter(F.col("key").isin("uses", "permissions") | F.array_contains("path", "permissions")), "keys")


def workflow_manifest(files: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """path, content of workflow files to workflow, uses: the ``uses`` of jobs and of their steps. keys: those of the files, if at hand."""
    keys = workflow_keys(files) if keys is None else keys
    level = F.size("path")
    of_step = (level == 3) & (F.get("path", F.lit(2)) == "steps")
    return keys.filter((F.col("key") == "uses") & (F.col("value") != "") & (F.get("path", F.lit(0)) == "jobs") & ((level == 2) | of_step)).select("workflow", F.col("value").alias("uses"))


def workflow_permissions(files: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """workflow, job, scope: of every workflow (job null; unspecified where it has none) and of jobs that have permissions of their own."""
    keys = hardening_keys(files) if keys is None else keys
    job = F.get("path", F.lit(1))
    top = (F.size("path") == 0) & (F.col("key") == "permissions")
    mine = (F.size("path") == 2) & (F.get("path", F.lit(0)) == "jobs") & (F.col("key") == "permissions")
    below = (F.element_at("path", -1) == "permissions") & ((F.size("path") == 1) | (F.size("path") == 3) & (F.get("path", F.lit(0)) == "jobs"))
    said = keys.filter(top | mine).select("workflow", F.when(mine, job).alias("job"), "value")
    entries = keys.filter((F.size("path") > 0) & below).groupBy("workflow", F.when(F.size("path") == 3, job).alias("_job")).agg(F.count("*").alias("entries"))
    entries = entries.withColumnRenamed("workflow", "_w")
    out = said.join(entries, (F.col("workflow") == F.col("_w")) & F.col("job").eqNullSafe(F.col("_job")), "left")
    out = out.select("workflow", "job", permission_scope(F.col("value"), F.coalesce("entries", F.lit(0))).alias("scope"))
    silent = files.select(F.col("path").alias("workflow")).distinct().join(said.filter("job is null").select("workflow"), "workflow", "left_anti")
    return out.unionByName(silent.select("workflow", F.lit(None).cast("string").alias("job"), F.lit("unspecified").alias("scope")))


def workflow_relation(files: DataFrame) -> DataFrame:
    """workflow, uses, scope, job as ``workflow_findings`` reads them: a row for each use and for each scope."""
    none, keys = F.lit(None).cast("string"), hardening_keys(files)
    return workflow_manifest(files, keys).select("workflow", "uses", none.alias("scope"), none.alias("job")).unionByName(workflow_permissions(files, keys).select("workflow", none.alias("uses"), "scope", "job"))


# Manifests of ecosystems that aren't read, by pattern; languages whose sinks have rules; the page of pull requests.
UNREAD = (
    ("Go modules", r"(?:^|/)go\.(mod|sum)$"), ("Maven", r"(?:^|/)pom\.xml$"), ("Gradle", r"(?:^|/)build\.gradle(\.kts)?$"), ("RubyGems", r"(?:^|/)Gemfile$"),
    ("RubyGems", r"(?:^|/)[\w.-]+\.gemspec$"), ("NuGet", r"(?:^|/)[\w.-]+\.csproj$"), ("Composer", r"(?:^|/)composer\.json$"), ("pub", r"(?:^|/)pubspec\.yaml$"),
)
RULED, PR_PAGE = ("python", "javascript"), 200


def unread_manifests(files: DataFrame) -> DataFrame:
    """ecosystem, path of manifests that no reader covers."""
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(UNREAD):
        kind = F.when(F.col("path").rlike(pattern), name).otherwise(kind)
    return files.select(kind.alias("ecosystem"), "path").filter("ecosystem is not null")


def coverage_gaps(session: DataFrame, plugins: DataFrame, declared_deps: DataFrame, files: DataFrame, pull_requests: DataFrame) -> DataFrame:
    """id, surface, kind, subject, n: what an analysis didn't look at. Kind blocking: nothing found there means unchecked;
    bounding: what was looked at is a part.

    session, one row: skip_reason, truncated, subdir, excluded (number of folders). plugins: plugin, files parsed.
    files: path. pull_requests: created_at."""
    text = F.lit(None).cast("string")
    gap = lambda t, name, surface, kind, subject, n: t.select(F.lit(name).alias("id"), F.lit(surface).alias("surface"), F.lit(kind).alias("kind"), subject.cast("string").alias("subject"), n.cast("long").alias("n"))
    parsed = plugins.agg(F.count("*").alias("_p"), F.coalesce(F.sum("files"), F.lit(0)).alias("_f"))
    one = session.crossJoin(parsed)  # tables of one row
    ruled, fallback = F.col("plugin").isin(*RULED), F.col("plugin") == "regex-fallback"
    bare = plugins.agg(F.array_join(F.sort_array(F.collect_set(F.when(~ruled & ~fallback, F.col("plugin")))), ",").alias("s"), F.sum(F.when(~ruled & ~fallback, F.col("files"))).alias("n"))
    none = declared_deps.agg(F.count("*").alias("_d"))
    unread = unread_manifests(files).agg(F.min(F.struct("path", "ecosystem")).alias("x"), F.count("*").alias("n")).crossJoin(none).filter("_d = 0 and n > 0")
    prs = pull_requests.agg(F.count("*").alias("n"), F.datediff(F.max("created_at"), F.min("created_at")).alias("days")).filter(F.col("n") >= PR_PAGE)
    return (
        gap(one.filter("skip_reason is not null"), "code-skipped", "session", "blocking", F.col("skip_reason"), F.lit(None))
        .unionByName(gap(one.filter("skip_reason is null and _p = 0"), "code-not-parsed", "session", "blocking", text, F.lit(None)))
        .unionByName(gap(one.filter("truncated is not null"), "walker-truncated", "code", "bounding", F.col("truncated"), F.col("_f")))
        .unionByName(gap(unread, "deps-no-ecosystem", "packages", "blocking", F.col("x.ecosystem"), F.col("n")))
        .unionByName(gap(bare.filter("s <> ''"), "security-no-rules", "security", "blocking", F.col("s"), F.col("n")))
        .unionByName(gap(one.filter("subdir is not null or excluded > 0"), "scope-narrowed", "session", "bounding", F.col("subdir"), F.col("excluded")))
        .unionByName(gap(prs, "pr-window", "prs", "bounding", F.col("days"), F.col("n")))
    )
