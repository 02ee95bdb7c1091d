"""Column builders: path and text classifiers, rounding, grades. A null path or text gives null or false."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, functions as F

# Directories, suffixes and names that the classifiers look for.
TEST_DIRS = ("test", "tests", "__tests__", "spec", "specs", "__specs__")
TEST_SUFFIXES = (
    ".test.ts", ".test.tsx", ".test.js", ".test.jsx", ".test.mjs", ".test.cjs", ".spec.ts", ".spec.tsx", ".spec.js", ".spec.jsx",
    "_test.go", "_test.py", "_spec.py", "_test.rb", "_spec.rb", "test.java", "tests.java", "test.kt", "tests.kt", "test.cs", "tests.cs", "test.php", "tests.php",
)
#: Of a lowered path: a step called so, or a name that ends or begins so. One search of one lowered text, as every edge is asked for both its ends.
TEST_FILE_RE = rf"(?:^|/)(?:(?:{'|'.join(TEST_DIRS)})(?:/|\z)|test_[^/]*\z)|(?:{'|'.join(s.replace('.', chr(92) + '.') for s in TEST_SUFFIXES)})\z"
TEST_TREE_RE = r"(^|/)(tests?|__tests__|testdata|fixtures?)(/|$)"
SKIP_DIRS = ("node_modules", "vendor", "dist", "build", "target", ".git", ".next", ".nuxt", ".svelte-kit", ".output", ".cache", "out", "coverage", ".venv", "venv", "__pycache__", ".idea", ".vscode")
METADATA_NAMES = (
    "readme.md", "readme", "changelog.md", "changelog", "license", "license.md", "license.txt", "contributing.md", "code_of_conduct.md", "security.md",
    "package.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "bun.lock", "bun.lockb", "cargo.toml", "cargo.lock", "go.mod", "go.sum", "gemfile", "gemfile.lock",
    "pipfile", "pipfile.lock", "requirements.txt", "poetry.lock", "pyproject.toml", ".gitignore", ".gitattributes", ".editorconfig", "dockerfile", "docker-compose.yml", "docker-compose.yaml",
)
METADATA_RE = r"(?i)\.prettierrc($|\.)|\.eslintrc($|\.)|\.stylelintrc($|\.)|tsconfig(\.[^.]+)?\.json$|jsconfig\.json$|\.config\.(js|cjs|mjs|ts)$|^\.github/"
CODE_EXTS = ("ts", "tsx", "js", "jsx", "mjs", "cjs", "py", "rb", "go", "rs", "java", "kt", "scala", "swift", "c", "cc", "cpp", "h", "hpp", "cs", "php", "vue", "svelte", "astro")
OUTPUT_DIRS = ("docs", "dist", "build", "out", "output", "public", "static", "_site", "site", "generated", "gen", "compiled", "bin", "data", "snapshots", "coverage", "assets", "www")
BOT_RE = r"(?i)\[bot\]$|-bot$|^bot-|^dependabot|^renovate|^github-actions|^vercel-release|^mergify|^codecov|^snyk-bot|^greenkeeper|^imgbot"
VENDORED_RE = r"(?i)(^|/)tests?/(assets|fixtures)/|(^|/)(vendor|vendored|third[_-]?party)/|\.min\.(js|mjs|cjs)$|[-.]bundle\.(js|mjs|cjs)$"
ROUTE_PATH_RE = r"(?i)(^|/)(route|handler|controller|endpoint|main|cmd|server|app|index)\.[a-z]+$|/(routes?|controllers?|handlers?|api|cmd|pages)/"
ROUTE_NAME_RE = r"^(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)$|^(handle|serve|on|route|main|run|process)[A-Z_]|Handler$|Controller$|^main$"
NON_PRODUCTION_RE = r"/management/commands/|/migrations/|/factories/|/fixtures/"
NON_PRODUCTION_NAME_RE = r"^(tests|conftest|factories|fixtures)\.py$|^seed([_-].*)?\.py$|^(create_db|check_flows|populate[_a-z]*)\.py$"
RULE_TEST_RE = (
    r"/src/test/|Tests?\.java$|Tests?\.kt$|Tests?\.cs$|(^|/)tests?/|(^|/)test_[^/]+\.py$|_test\.py$|_test\.go$|__tests?__/"
    r"|\.(test|spec)\.(tsx?|jsx?|mts|cts|mjs|cjs)$|Test\.php$|_spec\.rb$|(^|/)spec/"
)
SIGNAL_TEST_RE = r"(?i)\.test\.[jt]sx?$|\.spec\.[jt]sx?$|_test\.go$|_spec\.rb$|^test_.*\.py$|(^|/)tests?/|(^|/)__tests__/|tests?\.[a-z]+$"
RUNNABLE_TEST_RE = r"^test_.*\.py$|_test\.py$|\.(test|spec)\.[cm]?[jt]sx?$|_test\.go$|^Test.*\.(java|kt|cs|php)$|[a-z0-9]Tests?\.(java|kt|cs|php)$|_spec\.rb$|_test\.rb$|^test_.*\.rb$"
NON_SHIPPED_RE = r"(?i)(^|/)(examples?|samples?|demos?|docs?|website|site|e2e|tests?|__tests__|fixtures?|benchmarks?|bench|integration|playground)/"
PLACEHOLDERS = ("example", "placeholder", "your-key", "your_key", "your-token", "your_token", "yourkey", "yourtoken", "dummy", "sample", "fake", "redacted", "hidden", "secret-here", "secret_here")
EXAMPLE_PATH_RE = r"\.example(\.[a-z0-9]+)?$|\.sample(\.[a-z0-9]+)?$|\.template(\.[a-z0-9]+)?$|/(test|tests|__tests__|spec|specs|__specs__)/|/(fixtures?|mocks?|examples?|samples?)/|/docs?/"
GRADES = ((100, "A"), (90, "A-"), (80, "B+"), (75, "B"), (70, "B-"), (65, "C+"), (60, "C"), (55, "C-"), (50, "D+"), (45, "D"))
FIRST_PARTY = ("actions", "github")


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


# rounding as the reference defines it: halves go up
def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def round_to(x: Column, digits: int) -> Column:
    return F.floor(x * 10**digits + 0.5) / 10**digits


def percent(part: Column, whole: Column) -> Column:
    """Whole percents; 0 where the whole is 0."""
    return F.when(whole > 0, round_half_up(100 * part / whole)).otherwise(0).cast("long")


# paths
def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def module_path(path: Column) -> Column:
    """The directory, empty at the root."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def module_key(path: Column) -> Column:
    """The directory after undoing the usual splits of tests and sources."""
    p = F.regexp_replace(path, r"^src/(main|test)/[^/]+/", "")
    p = F.regexp_replace(p, r"^(.*?)/__tests__/", "$1/")  # the first one only
    return module_path(F.regexp_replace(F.regexp_replace(p, r"^tests?/", ""), r"^spec/", ""))


def folder_of(path: Column) -> Column:
    return F.when(path.contains("/"), F.substring_index(path, "/", 1)).otherwise("/")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def module_of(path: Column) -> Column:
    """The file's name without extension."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def in_test_dir(path: Column) -> Column:
    """Whether a folder on the way says test; the file's own name doesn't count."""
    return path.rlike(TEST_TREE_RE)


def importable_name(path: Column) -> Column:
    """The file's name without extension; of an ``__init__`` file its directory's name."""
    stem = F.regexp_replace(basename(path), r"\.[^.]*$", "")
    return F.when(stem == "__init__", basename(module_path(path))).otherwise(stem)


def is_vendored(path: Column) -> Column:
    return path.rlike(VENDORED_RE)


def is_minified(content: Column) -> Column:
    """50,000 characters or more, whose first 10,000 have lines of more than 500 on average."""
    lines = F.regexp_count(F.left(content, F.lit(10_000)), F.lit("\n"))
    return (F.char_length(content) >= 50_000) & ((lines == 0) | (10_000 / (lines + 1) > 500))


def in_skipped_dir(path: Column) -> Column:
    dirs = F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.exists(dirs, lambda d: d.isin(*SKIP_DIRS) | d.startswith("."))


def is_metadata_file(path: Column) -> Column:
    return F.lower(basename(path)).isin(*METADATA_NAMES) | path.rlike(METADATA_RE)


# the test-file predicates differ on purpose; each has its own users
def is_test_file(path: Column) -> Column:
    """For coverage, blast ranking, refactor safety, flow and taint."""
    return F.lower(path).rlike(TEST_FILE_RE)


def is_rule_test_file(path: Column) -> Column:
    """For verification rules."""
    return path.rlike(RULE_TEST_RE)


def is_signal_test_file(path: Column) -> Column:
    """For health signals and ``is_code_file``."""
    return path.rlike(SIGNAL_TEST_RE)


def is_runnable_test_file(path: Column) -> Column:
    """For tests to run."""
    base = basename(path)
    return (base != "conftest.py") & ~base.startswith("__init__") & base.rlike(RUNNABLE_TEST_RE)


def is_code_file(path: Column) -> Column:
    return ~is_metadata_file(path) & ~is_signal_test_file(path) & extension(path).isin(*CODE_EXTS)


def is_source_output_pair(a: Column, b: Column) -> Column:
    return F.lower(a).isin(*OUTPUT_DIRS) | F.lower(b).isin(*OUTPUT_DIRS)


def is_bot(login: Column) -> Column:
    return F.coalesce(login.rlike(BOT_RE), F.lit(False))


def is_non_production(path: Column) -> Column:
    return F.concat(F.lit("/"), F.lower(path), F.lit("/")).rlike(NON_PRODUCTION_RE) | F.lower(basename(path)).rlike(NON_PRODUCTION_NAME_RE)


def looks_like_entry_point(path: Column, name: Column) -> Column:
    return path.rlike(ROUTE_PATH_RE) | name.rlike(ROUTE_NAME_RE)


# buckets
def ladder(x: Column, steps: Iterable[tuple[float, str]], rest: str | None) -> Column:
    """The label of the first step that ``x`` reaches, steps in falling order."""
    out = F.lit(rest)
    for cut, label in reversed(list(steps)):
        out = F.when(x >= cut, label).otherwise(out)
    return out


def duration_bucket(hours: Column) -> Column:
    return F.when(hours < 1, "<1h").when(hours < 24, "<1d").when(hours < 168, "<1w").when(hours < 720, "<30d").otherwise(">30d")


def diversity_bucket(authors: Column) -> Column:
    return F.when(authors <= 1, "1").when(authors <= 3, "2-3").when(authors <= 6, "4-6").otherwise("7+")


def complexity_tone(complexity: Column) -> Column:
    return ladder(complexity, ((15, "high"), (8, "medium"), (2, "low")), None)


def grade(score: Column) -> Column:
    return ladder(score, GRADES, "F")


# versions and packages
def normalized_version(ecosystem: Column, declared: Column) -> Column:
    """The first concrete version of a declared range; null if it has none."""
    npm = F.regexp_extract(F.regexp_replace(F.trim(declared), r"^[\^~>=<\s]+", ""), r"^([^\s|,]+)", 1)
    pypi = F.regexp_extract(F.regexp_replace(F.trim(F.substring_index(declared, ";", 1)), r"^[=<>!~\s]+", ""), r"^([^\s|,]+)", 1)
    return (
        F.when((ecosystem == "npm") & npm.rlike(r"^\d+\.\d+"), npm).when((ecosystem == "cargo") & npm.rlike(r"^\d"), npm)
        .when((ecosystem == "pypi") & pypi.rlike(r"^\d"), pypi)
    )


def is_exact(ecosystem: Column, declared: Column) -> Column:
    d = F.trim(declared)
    npm = d.rlike(r"^\d+\.\d+\.\d+(?:[-+][0-9A-Za-z.-]+)?$")
    return F.when(ecosystem == "npm", npm).when(ecosystem == "cargo", d.startswith("=")).otherwise(d.rlike(r"^===?\s*\d[^,*\s]*$"))


def purl(ecosystem: Column, name: Column, version: Column) -> Column:
    """A package URL; names and versions percent-encoded, a space as %20."""
    enc = lambda c: F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))
    fixed = F.when(ecosystem == "pypi", F.regexp_replace(F.lower(name), "[-_.]+", "-")).otherwise(name)
    kind = F.when(ecosystem.isin("npm", "pypi", "cargo"), ecosystem).otherwise("generic")
    return F.concat(F.lit("pkg:"), kind, F.lit("/"), enc(fixed), F.lit("@"), enc(version))


# workflow pins
def pin_class(uses: Column) -> Column:
    version = F.when(uses.contains("@"), F.substring_index(uses, "@", -1)).otherwise("")
    return (
        F.when(uses.startswith("./") | uses.startswith("../"), "local").when(uses.startswith("docker://"), "docker").when(version == "", "unknown")
        .when(version.rlike("(?i)^[0-9a-f]{40}$"), "sha").when(version.rlike(r"^v?\d+(\.\d+)*$"), "tag").otherwise("branch")
    )


def is_third_party(uses: Column, owner: Column) -> Column:
    path = F.when(uses.contains("@"), F.regexp_replace(uses, "@[^@]*$", "")).otherwise(uses)
    first = F.lower(F.substring_index(path, "/", 1))
    own = first.isin(*FIRST_PARTY) | ((owner != "") & (first == F.lower(owner)))
    return F.when(uses.startswith("./") | uses.startswith("../"), False).when(uses.startswith("docker://"), True).otherwise(~own)


# secrets
def secret_confidence(match: Column, path: Column) -> Column:
    low = F.lower(match)
    text = F.when(any_of(low.contains(p) for p in PLACEHOLDERS) | match.rlike(r"(.)\1{8,}"), 0.05).when(match.rlike("[X0x]{12,}"), 0.1).otherwise(1.0)
    return text * F.when(F.lower(path).rlike(EXAMPLE_PATH_RE), 0.3).otherwise(1.0)


def redacted(match: Column) -> Column:
    return F.when(F.char_length(match) <= 10, match).otherwise(F.concat(F.left(match, F.lit(6)), F.lit("..."), F.right(match, F.lit(4))))


def fuzzy_score(query: str, name: Column) -> Column:
    """1000 for the same, less for a beginning, a part (more at a word's start), or the letters in order; else null."""
    q, n = query.lower(), F.lower(name)
    at = F.instr(n, q) - 1
    boundary = (at == 0) | F.get(F.split(n, ""), at - 1).isin(*"/._- ")
    gaps = r".*?".join("\\" + c if not c.isalnum() else c for c in q)
    span = F.char_length(F.regexp_extract(n, f"({gaps})", 1))
    return (
        F.when(n == q, 1000).when(n.startswith(q), 700 - F.char_length(n)).when(at >= 0, 400 + F.when(boundary, 100).otherwise(0) - F.char_length(n) - at)
        .when(span > 0, 150 - (span - len(q)) - F.char_length(n))
    ).cast("long")


def base36(x: Column) -> Column:
    return F.lower(F.conv(x.cast("string"), 10, 36))
